"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from marginalia import corpus
from marginalia.operators.joins import Stage
from marginalia.plans import pages, search
from marginalia.session import local_session, shared_dir
from marginalia.sources.store import Store
from workload import inputs
from workload.queries import QUERIES


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    posts = corpus.posts(spark, sf_dir)
    sink(posts.select("doc_id"))  # start the executor threads before the clock
    store = Store(spark, shared_dir(spark, "bench"))
    timed("index_build", lambda: store.add(posts))
    index = store.index()
    inputs.use(spark, sf_dir, store)

    batch = inputs.requests(spark, sf_dir)
    timed("ranked_search", lambda: sink(QUERIES["bm25_topk"](spark, sf_dir)))
    timed("phrase_search", lambda: sink(QUERIES["phrase_match"](spark, sf_dir)))
    timed("browse_newest", lambda: sink(QUERIES["browse_newest"](spark, sf_dir)))
    timed("tag_filter", lambda: sink(QUERIES["tag_filter"](spark, sf_dir)))
    timed("search_with_snippets", lambda: sink(QUERIES["search_hits"](spark, sf_dir)))
    timed("batch_search", lambda: sink(search.search(batch, index, stage=Stage(spark)).responses))
    timed("page_cleaning", lambda: sink(pages.clean_pages(corpus.read_table(spark, sf_dir, "pages"))))
    timed("fragments", lambda: sink(QUERIES["fragments"](spark, sf_dir)))
    inputs.labelled_store(spark, sf_dir)  # what was loaded earlier
    timed("load_new_only", lambda: sink(QUERIES["load_new_only"](spark, sf_dir)))
    timed("feed_posts", lambda: sink(QUERIES["feed_posts"](spark, sf_dir)))
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(sf.group(1)) if sf else None,
                "requests": batch.count(),
                "postings": index.postings.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
