"""The stored url keys: bitmaps rule urls out, buckets are read only where one may be known, results are exact."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia import corpus
from marginalia.operators.joins import Stage
from marginalia.plans import ingest
from marginalia.sources import feeds, urls
from marginalia.sources.store import Store

SF = "/root/testdata/sf0.001"


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def build(spark, path, loads, bucket_urls=None):
    """Key tables of several loads: (layouts, urls, bitmaps)."""
    layouts = []
    for load, names in enumerate(loads, 1):
        layout = urls.shape(load, len(names))
        keys = urls.keyed(frame(spark, names), layout)
        keys.write.partitionBy("bucket").parquet(f"{path}/urls/load={load}")
        urls.filters(keys, layout).write.partitionBy("bucket").parquet(f"{path}/bits/load={load}")
        layouts.append(layout)
    return layouts, spark.read.parquet(f"{path}/urls"), spark.read.parquet(f"{path}/bits")


@pytest.mark.parametrize("cell_urls, bucket_urls", [(2048, 1 << 20), (50, 400), (4, 16)])
def test_exactly_the_known_ones(spark, tmp_path, monkeypatch, cell_urls, bucket_urls):
    monkeypatch.setattr(urls, "CELL_URLS", cell_urls)
    monkeypatch.setattr(urls, "BUCKET_URLS", bucket_urls)
    rng = random.Random(1)
    names = [f"https://x.example/{rng.randrange(10**9)}" for _ in range(900)] + ["", "é 日本", "a\nb"]
    loads = [names[:600], names[550:580], names[590:]]
    layouts, keys, bits = build(spark, tmp_path, loads)
    batch = names[::3] + ["", "", names[0], names[0]] + [f"new{i}" for i in range(300)]
    for rows in (200_000, 0):  # broadcast or not
        monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
        got = [r.url for r in urls.known(frame(spark, batch), layouts, keys, bits, Stage(spark)).collect()]
        assert sorted(got) == sorted(set(batch) & set(names))
    assert urls.known(frame(spark, batch), [], keys, bits, Stage(spark)).count() == 0
    assert urls.known(frame(spark, []), layouts, keys, bits, Stage(spark)).count() == 0


def test_bitmaps_rule_nearly_all_new_urls_out(spark, tmp_path):
    layouts, keys, bits = build(spark, tmp_path, [[f"https://x.example/post/{i}" for i in range(20_000)]])
    assert bits.count() == layouts[0].cells == 10
    asked = spark.range(20_000).select(F.concat(F.lit("https://x.example/new/"), F.col("id")).alias("url"))
    asked = asked.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(10)).cast("int"))
    assert asked.join(bits, "cell").where(urls.may_hold()).count() < 100
    stored = keys.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(10)).cast("int"))
    assert stored.join(bits.drop("bucket", "load"), "cell").where(urls.may_hold()).count() == 20_000


class Staged(Stage):
    """Notes the plans of what it writes."""

    def __init__(self, spark):
        super().__init__(spark)
        self.plans = {}

    def __call__(self, df, name):
        self.plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return super().__call__(df, name)


def test_only_the_buckets_asked_for_are_read_and_no_post(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "BUCKET_URLS", 16)
    store = Store(spark, str(tmp_path))
    store.add(corpus.posts(spark, SF))
    stage = Staged(spark)
    new = store.known_urls(frame(spark, ["https://new.example/1"]), stage)
    # one new url: its bitmap alone is read, neither the stored urls nor the posts
    assert "bits#" in stage.plans["likely"] and re.search(r"PartitionFilters: [^\n]*dynamicpruning[^\n]*", stage.plans["likely"])
    assert not any(re.search("doc_id|content", text) for text in stage.plans.values())
    assert "FileScan" not in new._jdf.queryExecution().executedPlan().toString()
    old = store.posts().select("url").first().url
    found = store.known_urls(frame(spark, [old]), Stage(spark))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: [^\n]*dynamicpruning[^\n]*", text) and not re.search("doc_id|content", text)
    assert [r.url for r in found.collect()] == [old]


def test_rebuilds_and_deletions_reach_the_keys_and_the_quarantine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    posts = corpus.posts(spark, SF).drop("doc_id")
    ingest.append_new(store, posts)
    store.set_aside(posts.limit(2), 1)
    ingest.rebuild(store, posts.where("category = 'en'"))
    store.set_aside(posts.limit(3), 2)
    assert store.quarantine().count() == 3
    ingest.vacuum(store)
    assert store.quarantine().count() == 3 == spark.read.parquet(f"{store.path}/quarantine").count()
    kept = store.posts().count()
    assert store.known_urls(posts, Stage(spark)).count() == kept < posts.count()
    ingest.append_new(store, posts)
    assert store.posts().count() == posts.count()


def test_a_repeated_batch_is_recognised_before_any_work(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    body = '<entry><title>t</title><link href="u1"/></entry>'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.xml").write_text(f"<feed>{body}</feed>")
    entries = feeds.read_feeds(spark, str(tmp_path / "f"))
    assert ingest.load_feed(store, entries, source="stream/0") == 1
    monkeypatch.setattr(ingest, "entries_to_posts", None)
    assert ingest.load_feed(store, entries, source="stream/0") is None
    assert [r.added for r in ingest.load_report(store).collect()] == [1]
