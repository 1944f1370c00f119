"""Empty loads, the quarantine's contents, and deleting what no load needs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia import corpus
from marginalia.operators import index as ix
from marginalia.operators import snippet
from marginalia.operators.joins import Stage
from marginalia.plans import ingest
from marginalia.plans.search import search
from marginalia.schema import FEED_ENTRY, REQUESTS
from marginalia.sources import store as stored
from marginalia.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def posts(spark):
    return corpus.posts(spark, SF).where("doc_id < 40").drop("doc_id")


def folders(store, table):
    return sorted(x for x in os.listdir(f"{store.path}/{table}") if x.startswith("load="))


def test_empty_loads_write_a_report_only(spark, tmp_path, posts):
    store = Store(spark, str(tmp_path))
    ingest.append_new(store, posts)
    for _ in range(3):
        ingest.append_new(store, posts)
    assert folders(store, "postings") == ["load=1"] and folders(store, "loads") == [f"load={i}" for i in range(1, 5)]
    assert [r.added for r in ingest.load_report(store).orderBy("load").collect()] == [40, 0, 0, 0]
    more = corpus.posts(spark, SF).where("doc_id between 40 and 49").drop("doc_id")
    assert ingest.append_new(store, more) == 5
    assert store.posts().agg(F.max("doc_id")).first()[0] == 49


def test_nothing_loaded_first(spark, tmp_path, posts):
    store = Store(spark, str(tmp_path))
    ingest.append_new(store, posts.limit(0))
    ingest.append_new(store, posts)
    assert store.posts().count() == 40


def test_vacuum_keeps_what_counts(spark, tmp_path, posts):
    store = Store(spark, str(tmp_path))
    ingest.append_new(store, posts.limit(10))
    ingest.append_new(store, posts)
    ingest.rebuild(store, posts)
    os.makedirs(f"{tmp_path}/posts/load=9")  # a load that died
    before = sorted(map(tuple, store.posts().select("doc_id", "url").collect()))
    assert ingest.vacuum(store) > 0
    assert folders(store, "posts") == folders(store, "postings") == folders(store, "doc_freq") == ["load=3"]
    assert sorted(map(tuple, store.posts().select("doc_id", "url").collect())) == before
    assert store.index().postings.count() > 0 and ingest.vacuum(store) == 0


def test_quarantine_keeps_what_the_feed_said(spark, tmp_path):
    def entry(title=None, url=None, published=None, broken=None):
        return (title, [(url,)] if url else None, None, published, ("text", "html"), broken)

    rows = [entry("a", "u1", "2022-09-15T23:45:08+08:00"), entry("b", "u2", "2022-09-15T23:45:08Z"), entry(broken="<entry><title>a &hellip; b</title></entry>")]
    store = Store(spark, str(tmp_path))
    ingest.load_feed(store, spark.createDataFrame(rows, FEED_ENTRY))
    got = {(r.problem, r.title, r.raw_published, r.raw_entry) for r in store.quarantine().collect()}
    assert got == {("bad publish time", "b", "2022-09-15T23:45:08Z", None), ("broken entry", "", None, rows[2][5])}
    assert store.posts().count() == 1


def test_folding_merges_what_the_loads_have(spark, tmp_path, monkeypatch):
    """Postings are dealt anew, counts added up; nothing is cut or counted again, and the quarantine stays."""
    rows = corpus.posts(spark, SF)
    store = Store(spark, str(tmp_path))
    assert store.add(rows.where("doc_id < 20"), buckets=3) == 1
    store.add(rows.where("doc_id between 20 and 39"))
    store.set_aside(spark.createDataFrame([("bad",)], "problem string"), 2)

    def answers():
        index = store.index()
        found = [sorted(map(str, index.postings.drop("load", "bucket").collect()))]
        found.append(sorted(map(tuple, index.doc_freq.groupBy("field", "token").agg(F.sum("df")).collect())))
        found.append(sorted(map(tuple, index.days.groupBy("day").agg(F.sum("n")).collect())))
        found.append(sorted(map(tuple, index.field_stats.collect())))
        found.append(sorted(map(str, index.posts.drop("load", "slice").collect())))
        return found, index.buckets

    before, few = answers()
    stop = lambda *_: pytest.fail("cut again")
    for module, name in ((ix, "postings"), (ix, "field_sums"), (ix, "day_counts"), (stored, "with_ends")):
        monkeypatch.setattr(module, name, stop)
    assert ingest.compact(store) == 3
    monkeypatch.undo()
    ingest.vacuum(store)
    after, more = answers()
    assert (few, more) == (3, 8) and after == before
    assert folders(store, "postings") == folders(store, "quarantine") == ["load=3"]
    assert [r.problem for r in store.quarantine().collect()] == ["bad"]


def test_folding_an_empty_store(spark, tmp_path, posts):
    store = Store(spark, str(tmp_path))
    ingest.compact(store)
    assert store.posts().count() == 0 and store.index().postings.count() == 0
    assert ingest.append_new(store, posts) == 2 and store.posts().count() == 40


def test_stored_ends_give_the_same_fragments(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", None, "x" * 700, "日本語" * 300, "é" + "a" * 299 + "日", "ab " * 400 + "c" * 301 + "😀" * 90]
    texts += ["".join(rng.choice(["a", "word", " ", "日", "é", "😀", "\n", "Long" * 30]) for _ in range(rng.randrange(400))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(snippet.cut_fragments(F.col("t")).alias("a"), snippet.sliced(F.col("t"), snippet.fragment_ends(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and max(len(r.a or []) for r in got) > 5


def test_searches_do_not_cut_fragments(spark, tmp_path, posts):
    store = Store(spark, str(tmp_path))
    ingest.append_new(store, posts)
    requests = spark.createDataFrame([("r", 1, 5, None, None, ["the"])], REQUESTS)
    index, stage = store.index(), Stage(spark)
    weights = F.create_map(F.lit("the"), F.lit(1.0))
    fields = {"title": "w", "content": "w"}
    take = lambda df: sorted(map(str, snippet.snippets(df.withColumn("w", weights), fields).select("doc_id", "title", "content").collect()))
    assert take(index.posts) == take(store.posts())
    plan = search(requests, index, stage=stage).hits._jdf.queryExecution().optimizedPlan().toString()
    stage.clear()
    assert "{1,300}" not in plan and "content_ends" in plan
