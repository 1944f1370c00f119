"""Feed files to stored posts: batch loads, rebuild, repeats, rejected entries, restart of the stream."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import index as ix
from marginalia.operators.joins import Stage
from marginalia.operators.snippet import with_ends
from marginalia.plans import ingest
from marginalia.sources import feeds
from marginalia.sources.store import Store
from marginalia.streaming.ingest import start_ingest


def entry(url, title="T", cats=("Code", "Rust", "Web"), published="2022-09-15T23:45:08+08:00", content="<p>Python 中的 lambda</p>"):
    links = "".join(f'<link href="{u}"/>' for u in ([url] if isinstance(url, str) else url))
    terms = "".join(f'<category term="{c}"/>' for c in cats)
    date = f"<published>{published}</published>" if published else ""
    return f'<entry><title>{title}</title>{links}{terms}{date}<content type="html"><![CDATA[{content}]]></content></entry>'


def write(folder, name, *entries):
    os.makedirs(folder, exist_ok=True)
    body = "".join(entries)
    with open(f"{folder}/{name}", "w") as f:
        f.write(f'<feed xmlns="http://www.w3.org/2005/Atom"><title>B</title>{body}</feed>')


def posts_of(spark, folder):
    return feeds.entries_to_posts(feeds.read_feeds(spark, str(folder)))


def test_entry_to_post(spark, tmp_path):
    write(tmp_path, "a.xml", entry("https://x.example/1?a=1&amp;b=2", title="Q &amp;amp; A"))
    row = posts_of(spark, tmp_path).withColumn("date", F.unix_timestamp("date")).first()
    assert row.asDict() == {
        "title": "Q &amp; A",
        "content": "Python 中的 lambda",
        "url": "https://x.example/1?a=1&b=2",
        "date": 1663256708,
        "category": "Code",
        "tags": ["rust", "web"],
        "problem": None,
    }


@pytest.mark.parametrize(
    "cats, category, tags",
    [(("Code",), "Code", []), ((), "", []), (("", "A", "B"), "A", ["b"]), (("A", "", "B"), "A", ["", "b"])],
)
def test_categories(spark, tmp_path, cats, category, tags):
    write(tmp_path, "a.xml", entry("u", cats=cats))
    row = posts_of(spark, tmp_path).first()
    assert (row.category, row.tags) == (category, tags)


def test_defaults_and_variants(spark, tmp_path):
    write(tmp_path, "a.xml", entry(["u1", "u2"], published=None), entry("u3", published="2022-09-15T23:45:08Z"))
    rows = {r.url: r for r in posts_of(spark, tmp_path).withColumn("s", F.unix_timestamp("date")).collect()}
    assert rows["u2"].s == 0 and rows["u2"].problem is None
    assert rows["u3"].problem == "bad publish time"
    assert [r.url for r in feeds.loadable(posts_of(spark, tmp_path)).collect()] == ["u2"]


def test_escaped_content_is_taken_too(spark, tmp_path):
    body = '<entry><title>t</title><link href="u"/><content type="html">&lt;p&gt;x&lt;/p&gt;</content></entry>'
    write(tmp_path, "a.xml", body)
    assert posts_of(spark, tmp_path).first().content == "x"


def test_entities_xml_does_not_define(spark, tmp_path):
    write(tmp_path, "a.xml", entry("u1", title="a &hellip; b &amp;hellip; AT&T &foo;", content="x &nbsp; y &lt; &hellip;"), entry("u2"))
    rows = {r.url: r for r in posts_of(spark, tmp_path).collect()}
    assert rows["u1"].title == "a … b &hellip; AT&T &foo;" and rows["u1"].problem is None
    assert rows["u1"].content == "x  y < …"  # CDATA is read as it stands and decoded like any content
    assert rows["u2"].title == "T" and len(rows) == 2


def test_a_broken_entry_costs_no_other(spark, tmp_path):
    bad = "<entry><title>bad<title></entry>"
    write(tmp_path, "a.xml", entry("u1"), bad, entry("u2"), "\n", entry("u3"))
    (tmp_path / "b.xml").write_text("<feed><title>no entries</title></feed>\n")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<feed>" + entry("u4", content="a </entry> b") + entry("u6", content="a <entry> b") + entry("u5")[:40])
    rows = feeds.entries_to_posts(feeds.read_feeds(spark, str(tmp_path)), raw=True).collect()
    assert sorted(r.url for r in rows if r.problem is None) == ["u1", "u2", "u3", "u4", "u6"]
    kept = "".join(sorted((r.raw_entry for r in rows if r.problem), key=len))
    assert bad in kept and entry("u5")[:40] in kept


def test_entries_inside_cdata_belong_to_the_entry_around_them(spark, tmp_path):
    quoted = "Feeds: <entry><title>x</title></entry> and <entry id='2'>"
    write(tmp_path, "a.xml", entry("u1", content=quoted + " end"), entry("u2"), entry("u3", content="<![CDATA[ <entry> " * 3), "<entry-id>7</entry-id>", entry("u4"))
    unclosed = entry("u6", content="a <entry> b").replace("]]>", "")
    write(tmp_path, "b.xml", entry("u5", content="a <!-- <entry> --> b"), unclosed, entry("u7"), entry("u8", content="<entry"))
    write(tmp_path, "c.xml", entry("u9").replace("<published>", "<entry-id>1</entry-id><published>"), entry("u10", content="x <entry>")[:-30])
    rows = {r.url: r for r in feeds.entries_to_posts(feeds.read_feeds(spark, str(tmp_path)), raw=True).collect() if r.problem is None}
    assert sorted(rows) == ["u1", "u2", "u3", "u4", "u5", "u6", "u8", "u9"]
    assert rows["u1"].content == "Feeds: x and end" and rows["u4"].content == rows["u2"].content
    # XML ends a section at the next mark, wherever that is: the entry left open goes on into the one behind it
    assert "Python" in rows["u6"].content


@pytest.mark.parametrize("size", ["300", "1000", "134217728"])
def test_sections_across_stretches_of_a_file(spark, tmp_path, size):
    """Cuts inside sections are undone wherever the stretches that tasks read begin."""
    noise = "<entry> " * 40
    posts = [entry(f"u{i}", content=f"{i} {noise if i % 3 == 0 else ''} {'x' * (i * 17 % 400)} end") for i in range(60)]
    write(tmp_path, "a.xml", *posts)
    write(tmp_path, "b.xml", *[p.replace('"u', '"v') for p in posts[:9]])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, size)
        df = feeds.entries_to_posts(feeds.read_feeds(spark, str(tmp_path)))
        got = {r.url: (r.problem, r.content[:3].split()[0], r.content[-3:]) for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {f"{c}{i}": (None, str(i), "end") for c, n in (("u", 60), ("v", 9)) for i in range(n)}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    write(tmp_path, "a.xml", *[entry(f"u{i}", content="x" * 5000) for i in range(300)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
        df = feeds.read_feeds(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        assert df.select(F.get("link._href", F.lit(0)).alias("u")).distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def load(store, spark, folder, **kw):
    return ingest.load_feed(store, feeds.read_feeds(spark, str(folder)), **kw)


def urls(store):
    return sorted(r.url for r in store.posts().select("url").collect())


def test_loads_add_only_new_posts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "f1", "a.xml", entry("1"), entry("2"), entry("2", title="again"), entry("z", published="x"))
    write(tmp_path / "f2", "a.xml", entry("2", title="changed"), entry("3"))
    load(store, spark, tmp_path / "f1")
    assert urls(store) == ["1", "2", "2"]
    load(store, spark, tmp_path / "f2")
    load(store, spark, tmp_path / "f2")
    assert urls(store) == ["1", "2", "2", "3"]
    assert sorted(r.doc_id for r in store.posts().collect()) == [0, 1, 2, 3]
    assert {r.title for r in store.posts().where("url = '2'").collect()} == {"T", "again"}
    assert [r.added for r in ingest.load_report(store).orderBy("load").collect()] == [3, 1, 0]
    assert spark.read.parquet(f"{store.path}/quarantine/load=1").select("url").first().url == "z"


def test_one_post_per_url_on_request(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "f", "a.xml", entry("1"), entry("2"), entry("2", title="again"))
    load(store, spark, tmp_path / "f", dedupe_batch=True)
    assert urls(store) == ["1", "2"]


def test_rebuild_replaces_everything(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "f1", "a.xml", entry("1"), entry("2"))
    write(tmp_path / "f2", "a.xml", entry("3"))
    load(store, spark, tmp_path / "f1")
    load(store, spark, tmp_path / "f2", from_scratch=True)
    assert urls(store) == ["3"]
    assert store.index().field_stats.where("field = 'title'").first().n_docs == 1
    load(store, spark, tmp_path / "f1")
    assert urls(store) == ["1", "2", "3"]


def same(a, b):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(a) == key(b)


def test_index_of_several_loads_equals_index_of_one(spark, tmp_path):
    parts, whole = Store(spark, str(tmp_path / "parts")), Store(spark, str(tmp_path / "whole"))
    texts = ["a b a", "the cat, the dog", "数据 the 数据", "b"]
    for i, t in enumerate(texts):
        write(tmp_path / f"f{i}", "a.xml", entry(f"u{i}", content=t))
        load(parts, spark, tmp_path / f"f{i}")
    write(tmp_path / "all", "a.xml", *[entry(f"u{i}", content=t) for i, t in enumerate(texts)])
    load(whole, spark, tmp_path / "all")
    cols = ["field", "token", "doc_id", "dl", "tf", "positions"]
    same(parts.index().postings.select(cols), whole.index().postings.select(cols))
    total = lambda store: store.index().doc_freq.groupBy("field", "token").agg(F.sum("df"))
    same(total(parts), total(whole))
    same(parts.index().field_stats, whole.index().field_stats)
    days = lambda store: store.index().days.groupBy("day").agg(F.sum("n"))
    same(days(parts), days(whole))
    before = parts.posts().select("doc_id", "url").collect()
    ingest.compact(parts)
    assert sorted(before) == sorted(parts.posts().select("doc_id", "url").collect())
    same(parts.index().postings.select(cols), whole.index().postings.select(cols))
    assert parts.posts().select("load").distinct().count() == 1
    derived = ix.from_posts(whole.posts())
    same(derived.postings.select(cols), whole.index().postings.select(cols))
    same(derived.field_stats, whole.index().field_stats)


def test_unfinished_load_is_invisible_and_overwritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "f1", "a.xml", entry("1"))
    write(tmp_path / "f2", "a.xml", entry("2"))
    load(store, spark, tmp_path / "f1")
    posts = ingest.number(feeds.loadable(posts_of(spark, tmp_path / "f2")), 0, Stage(spark))
    store._write_posts(with_ends(posts), 2)
    assert urls(store) == ["1"]
    load(store, spark, tmp_path / "f2")
    assert urls(store) == ["1", "2"]


def test_numbering_follows_url_order(spark, tmp_path):
    rows = [(f"t{i}", "c", f"u{i:03d}", 0, "k", ["x"]) for i in range(200)]
    df = spark.createDataFrame(rows, "title string, content string, url string, s long, category string, tags array<string>")
    got = ingest.number(df.withColumn("date", F.timestamp_seconds("s")), 9, Stage(spark)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.url) for r in got] == [(10 + i, f"u{i:03d}") for i in range(200)]


def test_stream_restart_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    feed, state = tmp_path / "feed", str(tmp_path / "state")

    def run(checkpoint=state):
        query = start_ingest(store, str(feed), checkpoint)
        query.awaitTermination()

    write(feed, "a.xml", entry("1"), entry("2"), entry("3"))
    run()
    assert urls(store) == ["1", "2", "3"]
    write(feed, "b.xml", entry("2"), entry("3"), entry("4"))
    run()
    assert urls(store) == ["1", "2", "3", "4"]
    run()
    run(str(tmp_path / "state-lost"))
    assert urls(store) == ["1", "2", "3", "4"]
    lambdas = store.index().doc_freq.where("field = 'content' AND token = 'lambda'")
    assert lambdas.agg(F.sum("df")).first()[0] == 4


def test_numbering_moves_posts_once(spark):
    """A range of urls is numbered as it is written: nothing is grouped by range again."""
    rows = spark.range(500).select(
        F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("url"), F.timestamp_seconds("id").alias("date"),
        F.lit("t").alias("title"), F.col("id").cast("string").alias("content"), F.lit("en").alias("category"), F.array(F.lit("a")).alias("tags"),
    )
    done = ingest.number(rows.repartition(7, "content"), 9, Stage(spark))
    assert [r.doc_id for r in done.orderBy("url").collect()] == list(range(10, 510))
    assert "row_number" not in done._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", [ingest.append_new, ingest.rebuild])
def test_numbered_posts_are_stored_where_they_lie(spark, tmp_path, monkeypatch, how):
    """They come in ranges of doc_id: no text is shuffled to bring a slice together, and every post is in its slice."""
    from marginalia.sources import store as stored

    monkeypatch.setattr(stored, "SLICE_DOCS", 7)
    dealt, write = [], Store._write

    def seen(self, table, load, df, by):
        if table == "posts":
            dealt.append("RebalancePartitions" in df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, table, load, df, by)

    monkeypatch.setattr(Store, "_write", seen)
    rows = [(f"u{i * 37 % 100:02}", f"t{i}", "a b " * i, "c", ["x"]) for i in range(100)]
    batch = spark.createDataFrame(rows, "url string, title string, content string, category string, tags array<string>").repartition(5)
    batch = batch.withColumn("date", F.timestamp_seconds(F.length("content")))
    store = Store(spark, str(tmp_path / "s"))
    how(store, batch)
    got = store.table("posts").orderBy("doc_id").collect()
    assert [(r.url, r.title, r.content) for r in got] == sorted((u, t, c) for u, t, c, *_ in rows)
    assert all(r.slice == r.doc_id // 7 for r in got) and [r.doc_id for r in got] == list(range(got[0].doc_id, got[0].doc_id + 100))
    store.add(batch.withColumn("doc_id", F.lit(500) + F.length("content")))
    assert dealt == [False, True]
