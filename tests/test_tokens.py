"""Tokens and their byte spans against a plain cutter."""

import random

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import cutting, index, snippet, tokens


def cut_by_hand(s):
    out = []
    for ch in s:
        letter = ch.isascii() and ch.isalpha()
        if letter and out and out[-1][-1].isascii() and out[-1][-1].isalpha():
            out[-1] += ch
        else:
            out.append(ch)
    return out


def posts_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string")
    return df.withColumn("title", F.lit(""))


TEXTS = ["Hello, World 2022", "café😀a", "", "a", "1", "\n\n", "Ünïcode İstanbul ß", "数据A库b", "don't", "x" * 400]


def random_texts():
    rng = random.Random(3)
    return ["".join(rng.choice("abZ 1,é你😀\nİK") for _ in range(rng.randint(0, 30))) for _ in range(300)]


def test_cut(spark):
    texts = TEXTS + random_texts()
    df = posts_of(spark, texts).orderBy("doc_id")
    assert [r[0] for r in df.select(text.cut(F.col("content"))).collect()] == [cut_by_hand(t) for t in texts]
    assert [r[0] for r in df.select(text.token_count(F.col("content"))).collect()] == [len(cut_by_hand(t)) for t in texts]


def test_offsets(spark):
    texts = TEXTS + random_texts()
    got = {}
    for r in tokens.token_offsets(posts_of(spark, texts)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.byte_from, r.byte_to))
        assert r.field == "content" and r.dl == len(cut_by_hand(texts[r.doc_id]))
    for i, t in enumerate(texts):
        at, want = 0, []
        for tok in cut_by_hand(t):
            end = at + len(tok.encode())
            want.append((at, end))
            at = end
        assert got.get(i, []) == want


def test_accented_letters_are_single_tokens(spark):
    rows = tokens.token_offsets(posts_of(spark, ["café😀a"])).orderBy("ord").collect()
    assert [(r.token, r.byte_from) for r in rows] == [("caf", 0), ("é", 3), ("😀", 5), ("a", 9)]


def test_order_of_cutting_and_lowering(spark):
    df = spark.sql("SELECT * FROM VALUES ('İ'), ('K') AS t(c)")
    rows = df.select(text.index_tokens(F.col("c")).alias("i"), text.search_tokens(F.col("c")).alias("s")).collect()
    assert rows[0].i == ["i̇"] and rows[0].s == ["i", "̇"]
    assert rows[1].i == ["k"] and rows[1].s == ["k"]


def sizes_by_hand(t):
    return [len(w.encode()) for w in cut_by_hand(t)]


def test_postings_are_put_together_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(cutting, "PIECE_BYTES", 40)  # documents span pieces
    texts = TEXTS + random_texts()
    entries = index.text_postings(posts_of(spark, texts).withColumn("date", F.lit(0).cast("timestamp")))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan  # no row per token is sorted or grouped by Spark
    got = {(r.doc_id, r.token): (r.tf, r.dl, r.positions) for r in entries.collect()}
    lower = tokens.lower_cased(spark)
    want = {}
    for i, t in enumerate(texts):
        at = 0
        for w in cut_by_hand(t):
            want.setdefault((i, w.lower() if w.isascii() else lower.get(w, w)), []).append(at)
            at += len(w.encode())
    assert got == {(i, w): (len(p), len(cut_by_hand(texts[i])), p) for (i, w), p in want.items()}


def test_lower_casing_is_that_of_spark(spark):
    lower = tokens.lower_cased(spark)
    assert lower["İ"] == "i̇" and lower["\u212a"] == "k" and "é" not in lower and len(lower) < 3000


def test_rows_that_share_a_doc_id_take_turns(spark):
    rows = [(1, "a bc", ""), (1, "a bc", ""), (None, "x", ""), (None, "x", ""), (2, None, "t"), (3, "", "")]
    got = tokens.token_offsets(spark.createDataFrame(rows, "doc_id bigint, content string, title string")).collect()
    at = {}
    for r in got:
        at.setdefault((r.doc_id, r.field), []).append((r.byte_from, r.byte_to, r.token, r.ord))
    assert {k: sorted(v) for k, v in at.items()} == {
        (1, "content"): [(0, 1, "a", 0), (1, 2, "a", 0), (2, 3, " ", 1), (3, 4, " ", 1), (4, 6, "bc", 2), (6, 8, "bc", 2)],
        (None, "content"): [(0, 1, "x", 0), (1, 2, "x", 0)],
        (2, "title"): [(0, 1, "t", 0)],
    }


def test_stored_ends_are_those_of_the_cut(spark):
    rng = random.Random(5)
    texts = [*TEXTS, None, "", "y" * 900, *["".join(rng.choice(["a" * rng.randint(1, 400), " ", "é", "你", "😀", "."]) for _ in range(rng.randint(0, 40))) for _ in range(100)]]
    df = snippet.with_ends(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string").withColumn("title", F.col("content")))
    for r in df.select("content_ends", "title_ends", snippet.fragment_ends(F.col("content")).alias("want")).collect():
        assert r.content_ends == r.title_ends == r.want


def test_packed_postings_are_the_postings(spark, monkeypatch):
    """Packed, brought together by bucket and unpacked, postings are those put together row by row; their rows are not shuffled, nor are texts that stand alone."""
    from pyspark.sql import functions as F

    from marginalia.operators import cutting, tokens
    from marginalia.operators.match import bucket

    monkeypatch.setattr(cutting, "PACK_ROWS", 50)
    texts = [None, "", "That that THE, the.", "naïve Café ÀÉ — 日本 日本", "a" * 400 + " b", "x\x00y <z> & " * 30]
    rows = [(i, f"Title {i} the", texts[i % len(texts)]) for i in range(40)]
    kind = "doc_id long, title string, content string"
    for data, alone in ((rows, True), ([*rows, *rows[:9], (None, "n", "n n"), (None, "m", "n")], False)):
        posts = spark.createDataFrame(data, kind).repartition(3).withColumn("date", F.timestamp_seconds("doc_id"))
        packs = tokens.token_packs(posts, 5, alone, "date")
        columns = ["field", "token", "doc_id", "date", "dl", "tf", "positions"]
        want = tokens.token_groups(posts, "date").select(*columns, bucket(F.col("token"), 5).alias("bucket"))
        assert sorted(map(repr, packs.select(*columns, "bucket").collect())) == sorted(map(repr, want.collect()))
        plan = packs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RebalancePartitions") == 1 and ("RepartitionByExpression [doc_id" in plan) != alone
    assert tokens.token_packs(spark.createDataFrame([], kind).withColumn("date", F.timestamp_seconds("doc_id")), 5, True, "date").count() == 0


def test_packs_of_counted_tokens_come_sorted_in_small_pieces(spark, monkeypatch):
    """With the tokens counted, packs are dealt over pieces of bounded size, and a task gives out its rows in sorted runs."""
    from pyspark.sql import functions as F

    from marginalia.operators import cutting, tokens

    monkeypatch.setattr(cutting, "PACK_ROWS", 60)
    rows = [(i if i % 5 else None, f"Title {i} the", "That that THE, the. naïve 日本 " * (i % 7)) for i in range(60)]
    posts = spark.createDataFrame(rows, "doc_id long, title string, content string").withColumn("date", F.timestamp_seconds("doc_id"))
    columns = ["field", "token", "doc_id", "date", "dl", "tf", "positions"]
    want = tokens.token_groups(posts, "date").select(*columns)
    totals = {r.field: r.n for r in tokens.token_groups(posts).groupBy("field").agg(F.sum("tf").alias("n")).collect()}
    plain = tokens.token_packs(posts, 3, False, "date", totals=totals)
    assert sorted(map(repr, plain.select(*columns).collect())) == sorted(map(repr, want.collect()))
    tasks = plain.select(F.spark_partition_id().alias("task"), "field", "bucket", "token", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).collect()
    assert all([r for r in tasks if r.task == t] == sorted(r for r in tasks if r.task == t) for t in {r.task for r in tasks})
    monkeypatch.setattr(tokens, "TASK_TOKENS", 20)
    plain = tokens.token_packs(posts, 3, False, "date", totals=totals)
    monkeypatch.setattr(cutting, "SORTED_BYTES", 4000)
    small = tokens.token_packs(posts, 3, False, "date", totals=totals)
    assert sorted(map(repr, small.select(*columns).collect())) == sorted(map(repr, want.collect()))
    most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert most(small) < most(plain)


def test_sums_of_stored_posts_are_the_field_sums(spark):
    """Tokens of stored posts are counted inside tasks; rows without text, tags or anything count as they do in columns."""
    texts = [*TEXTS, None, *random_texts()]
    rows = [(t, t and t[::-1], None if i % 5 == 0 else ["a"] * (i % 3)) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "title string, content string, tags array<string>")
    for some in (posts, posts.where("title is null"), posts.where("false")):
        summed = index.stored_sums(some)
        assert summed.schema.names == index.field_sums(some).schema.names and summed.collect() == index.field_sums(some).collect()
    assert "regexp" not in index.stored_sums(posts)._jdf.queryExecution().executedPlan().toString()


def test_lower_cased_names_meet(spark):
    """A character beyond ASCII that is lower-cased to another one's token is that token."""
    rows = index.text_postings(posts_of(spark, ["\u212a k K \u00c9\u00e9"]).withColumn("date", F.lit(0).cast("timestamp"))).collect()
    assert {r.token: r.positions for r in rows} == {"k": [0, 4, 6], " ": [3, 5, 7], "\u00e9": [8, 10]}


def test_stable_order():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (1, 9, 1 << 20, 1 << 61):
        key = rng.integers(0, top, 1000)
        assert (cutting._stable(key) == np.argsort(key, kind="stable")).all()
    assert len(cutting._stable(np.zeros(0, np.int64))) == 0
