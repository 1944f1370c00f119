"""Requests evaluated by document slot: no row per request and document leaves a slot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import batch
from marginalia.plans import search


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(2000) * 9, np.arange(1, 400) / 1e5 * 5, [0.0, 1.00005, 2.00015, 0.12345]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4)).collect()]
    assert batch.rounded(x).tolist() == want


@pytest.mark.parametrize("exclude", ["all", "any"])
def test_slots_hand_on_pages_and_counts_only(spark, monkeypatch, exclude):
    """Every request matches every document, and still few rows are shuffled by request."""
    monkeypatch.setattr(batch, "SLOT_ROWS", 300)
    monkeypatch.setattr(batch, "BLOCK_REQUESTS", 7)
    docs = spark.range(400).select(F.when(F.col("id") < 399, F.col("id")).alias("doc_id"), F.timestamp_seconds(F.col("id") % 50).alias("date"))
    word = lambda w, kind, rows, score: docs.where(rows).select(F.lit(kind).alias("kind"), F.lit(w).alias("word"), "doc_id", "date", F.expr(score).alias("score"))
    matched = word("a", "text", "true", "doc_id % 7 / 3.0").unionByName(word("b", "text", "doc_id % 3 = 0", "0.5D")).unionByName(word("t", "tags", "doc_id % 2 = 0", "0.25D"))
    matched = matched.withColumn("score", F.coalesce("score", F.lit(0.1)))
    clauses = [
        ("must", "text", "a"),
        *[("excluded", "text", w) for w in ("b", "nosuchword")],
        ("filter", "tags", "t"),
    ]
    rows = [(f"r{i}", 1, 2, 1, 3 if i % 2 else None, 40, i % 3 == 0, 1 + i % 2, 4, *c) for i in range(20) for c in clauses]
    parts = spark.createDataFrame(rows, "request_id string, w_must int, w_excluded int, w_filter int, lo long, hi long, ranged boolean, page long, size long, role string, kind string, word string")
    best = batch.best_in_slots(parts, matched, exclude, 1000, 20)
    assert best.count() <= 20 * 4 * 8  # requests, slots, rows down to the page's end
    plain = matched.join(parts, ["kind", "word"]).where("coalesce(unix_seconds(date) >= lo, true) and unix_seconds(date) <= hi")
    plain = plain.groupBy("request_id", "page", "size", "ranged", "doc_id").agg(F.count_if(F.col("role") == "excluded").alias("e"), F.count_if(F.col("role") != "excluded").alias("n"), F.sum(F.when(F.col("role") != "excluded", F.col("score"))).alias("s"))
    plain = plain.where((F.col("n") == 2) & (F.col("e") < (2 if exclude == "all" else 1))).withColumn("s", F.round(F.col("s") + F.col("ranged").cast("double"), 4))
    want = {}
    for r in plain.collect():
        want.setdefault((r.request_id, r.page), []).append((-r.s, -1 if r.doc_id is None else r.doc_id))
    got = {}
    for r in search.batch_pages(parts, matched, exclude, 1000, 20).where("rank is not null").collect():
        got.setdefault(r.request_id, []).append((r.rank, -1 if r.doc_id is None else r.doc_id, r.score, r.total))
    for (request, page), found in want.items():
        shown = sorted(found)[(page - 1) * 4 : page * 4]
        assert sorted(got[request]) == [((page - 1) * 4 + 1 + k, d, -s, len(found)) for k, (s, d) in enumerate(shown)]


def test_texts_meet_hits_last(spark):
    """Hits have their words' weights before they meet the texts, so no text is moved once per hit."""
    pages = spark.createDataFrame([(f"r{i}", 1, i % 3, 1.0, 1) for i in range(9)], "request_id string, rank long, doc_id long, score double, total long")
    posts = spark.createDataFrame([(i, f"t{i}", f"some text {i}", f"u{i}", "en", ["a"]) for i in range(3)], "doc_id long, title string, content string, url string, category string, tags array<string>")
    posts = posts.withColumn("date", F.timestamp_seconds("doc_id"))
    weights = spark.createDataFrame([("r1", {}, {"text": 0.5}), ("r2", None, {"some": 0.5})], "request_id string, title_weights map<string,double>, content_weights map<string,double>")
    shown = search.hits(pages, posts, weights)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")  # the upper one comes first
    got = {r.request_id: r.snippet for r in shown.collect()}
    assert len(got) == 9 and got["r1"] == "some <b>text</b> 1" and got["r2"] == "<b>some</b> text 2" and got["r0"] == "some text 0"


def test_fields_of_a_word_add_up_in_a_slot(spark):
    matched = spark.createDataFrame([("text", "a", d, 0.25) for d in (1, 1, 2)], "kind string, word string, doc_id long, score double").withColumn("date", F.timestamp_seconds(F.lit(5)))
    row = ("r", 1, 0, 0, None, None, False, 1, 4, "must", "text", "a")
    parts = spark.createDataFrame([row], "request_id string, w_must int, w_excluded int, w_filter int, lo long, hi long, ranged boolean, page long, size long, role string, kind string, word string")
    got = batch.best_in_slots(parts, matched, "all", 10, 1).orderBy("doc_id").collect()
    assert [(r.doc_id, r.score, r._size) for r in got] == [(1, 0.5, 2), (2, 0.25, 2)]


def test_phrases_meet_the_positions_of_their_tokens_once(spark, monkeypatch):
    """However many phrases name a token, its postings go to their slot once; what stands there is what plain searching finds."""
    from marginalia.operators import index as ix
    from marginalia.operators import match, phrases

    monkeypatch.setattr(phrases, "LEAST_SLOTS", 3)
    texts = ["of the of the of the", "of theof the", "a a a, a a", "the of 日日日 of", "x of", "", None, "THE OF the, of the"]
    rows = [(i if i != 11 else None, texts[i % len(texts)]) for i in range(24)]
    posts = spark.createDataFrame(rows, "doc_id long, content string").select(
        "doc_id", F.lit("t").alias("title"), "content", F.timestamp_seconds(F.coalesce("doc_id", F.lit(0))).alias("date"), F.lit("c").alias("category"), F.array().cast("array<string>").alias("tags")
    )
    words = ["of the", "the of", "a a", "日日", "of the of", "no such", "the, of", "f the", " of", "a a a"]
    asked = spark.createDataFrame([("text", w) for w in words], "kind string, word string")
    index = ix.from_posts(posts)
    got = match.field_matches(index, match.lookups(asked, index), fits=True).where("field = 'content'")
    want = {}
    for doc, text in rows:
        for w in words:
            low = (text or "").lower()
            ends = lambda a, z: not (low[a - 1 : a + 1].isascii() and a and low[a - 1 : a + 1].isalpha()) and not (low[z - 1 : z + 1].isascii() and len(low[z - 1 : z + 1]) == 2 and low[z - 1 : z + 1].isalpha())
            n = sum(low.startswith(w, a) and ends(a, a + len(w)) for a in range(len(low)))
            if n and (doc is not None or len(set(w)) == 1):
                want[doc, w] = n
    assert {(r.doc_id, r.word): r.tf for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list(CASE" not in plan  # no row per phrase, document and token is grouped


PARTS = "request_id string, w_must int, w_excluded int, w_filter int, lo long, hi long, ranged boolean, page long, size long, role string, kind string, word string"


def test_slots_do_not_grow_with_an_upper_bound_of_matches(spark):
    """The bound counts a phrase by its rarest token and may be far above what matches; every request goes to every slot."""
    matched = spark.range(400).select(F.lit("text").alias("kind"), F.lit("a").alias("word"), F.col("id").alias("doc_id"), F.timestamp_seconds("id").alias("date"), F.lit(0.5).alias("score"))
    parts = spark.createDataFrame([(f"r{i}", 1, 0, 0, None, None, False, 1, 4, "must", "text", "a") for i in range(20)], PARTS)
    best = batch.best_in_slots(parts, matched, "all", 200_000_000, 20)
    assert best.count() <= 20 * 4 * 3
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and plan.count("MapInArrow") >= 3  # matches and requests are packed before they are dealt


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("exclude", ["all", "any"])
def test_parts_of_a_slot_give_the_same_pages(spark, monkeypatch, exclude, small):
    """Many parts and slots, best rows handed on early, documents without number or date, ids far apart and below zero."""
    if small:
        monkeypatch.setattr(batch, "SLOT_ROWS", 90)
        monkeypatch.setattr(batch, "SLOTS", 3)
        monkeypatch.setattr(batch, "PACK_ROWS", 200)
        monkeypatch.setattr(batch, "BEST_ROWS", 40)
        monkeypatch.setattr(batch, "BEST_REQUESTS", 5)
        monkeypatch.setattr(batch, "BLOCK_REQUESTS", 7)
    rng = np.random.default_rng(3)
    docs = [None, -5000, *[int(i) * 173 for i in range(298)]]
    date = {d: None if i % 9 == 4 else int(rng.integers(0, 60)) for i, d in enumerate(docs)}
    words = [("text", "a", 0.9), ("text", "b", 0.5), ("text", "c", 0.1), ("text", "d", 0.01), ("category", "t", 0.4)]
    score = {(k, w, d): float(rng.choice([0.1, 0.25, 0.30004, 0.30006, 1.5])) for k, w, share in words for d in docs if rng.random() < share}
    rows = [(k, w, d, date[d], s) for (k, w, d), s in score.items()]
    matched = spark.createDataFrame(rows, "kind string, word string, doc_id long, at long, score double").select("kind", "word", "doc_id", F.timestamp_seconds("at").alias("date"), "score")
    clauses, want = [], {}
    for i in range(40):
        must = [words[j][:2] for j in rng.choice(4, 1 + i % 2, replace=i % 7 == 0)] if i % 5 else []
        excluded = [("text", w) for w in rng.choice(["b", "c", "d", "nosuch"], i % 3, replace=False)] if must else []
        exact = [("category", "t")] if i % 4 == 0 or not must else []
        lo, hi = [(None, None), (10, None), (None, 40), (10, 40)][i % 4]
        page, size = 1 + i % 3, [1, 4, 30][i % 3]
        head = (f"r{i}", len(must), len(excluded), len(exact), lo, hi, i % 2 == 0, page, size)
        clauses += [(*head, role, k, w) for role, some in (("must", must), ("excluded", excluded), ("filter", exact)) for k, w in some]
        found = []
        for d in docs:
            at = date[d]
            if any((*c, d) not in score for c in must + exact) or (at is not None and ((lo is not None and at < lo) or (hi is not None and at > hi))):
                continue
            gone = sum((*c, d) in score for c in excluded)
            if excluded and gone >= (len(excluded) if exclude == "all" else 1):
                continue
            key = round(sum(score[*c, d] for c in must + exact) + (i % 2 == 0), 4) if must else at
            found.append(((key is None, -(key or 0)), -(1 << 62) if d is None else d, key if must else None))
        shown = sorted(found)[(page - 1) * size : page * size]
        want[f"r{i}"] = [((page - 1) * size + 1 + n, None if d == -(1 << 62) else d, s, len(found)) for n, (_, d, s) in enumerate(shown)]
    pages = search.batch_pages(spark.createDataFrame(clauses, PARTS), matched, exclude, len(rows), 40).collect()
    got = {r: [] for r in want}
    for r in pages:
        if r.rank is not None:
            got[r.request_id].append((r.rank, r.doc_id, None if r.score is None else round(r.score, 4), r.total))
    for r, found in want.items():
        assert sorted(got[r]) == found, r
    later = [r for r in pages if r.rank is None]
    assert all(r.doc_id is None and r.score is None and r.total > 0 for r in later) and len({r.request_id for r in later}) == len(later)


def test_postings_of_phrases_travel_packed(spark):
    """What is dealt to a phrase's slots are packs, not a row per token and document."""
    from marginalia.operators import index as ix
    from marginalia.operators import match

    posts = spark.range(600).select(
        F.col("id").alias("doc_id"), F.lit("of the").alias("title"), F.lit("of the of the").alias("content"), F.timestamp_seconds("id").alias("date"), F.lit("c").alias("category"), F.array().cast("array<string>").alias("tags")
    )
    index = ix.from_posts(posts)
    asked = spark.createDataFrame([("text", "of the")], "kind string, word string")
    found = match.field_matches(index, match.lookups(asked, index), fits=True)
    left = found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[1]
    assert left.index("MapInArrow") < left.index("positions")  # packed above what has positions
    assert {(r.field, r.tf) for r in found.select("field", "tf").distinct().collect()} == {("title", 1), ("content", 2)} and found.count() == 1200


def test_postings_are_not_shuffled_for_many_requests(spark, monkeypatch):
    """Beyond BROADCAST_CLAUSES the clauses are not broadcast, but what postings are joined with still is."""
    from marginalia.operators import index as ix
    from marginalia.operators.joins import Stage

    posts = spark.range(50).select(
        F.col("id").alias("doc_id"), F.lit("of the").alias("title"), F.concat_ws(" ", F.lit("of the"), F.col("id").cast("string"), F.lit("x")).alias("content"), F.lit("u").alias("url"), F.timestamp_seconds("id").alias("date"), F.lit("c").alias("category"), F.array().cast("array<string>").alias("tags")
    )
    index, none = ix.from_posts(posts), F.array().cast("array<string>")
    words = spark.createDataFrame([("1", ["of the"]), ("2", ["x", "-of"]), ("3", ["the", "x"])], "request_id string, q array<string>")
    requests = words.select("request_id", F.lit(1).cast("bigint").alias("page"), F.lit(4).cast("bigint").alias("size"), F.array().cast("array<bigint>").alias("range"), none.alias("terms"), "q")
    fits, plain = [], search.field_matches
    monkeypatch.setattr(search, "field_matches", lambda index, wanted, joins, *more: (fits.append(joins), plain(index, wanted, joins, *more))[1])
    answer = lambda: sorted(map(tuple, search.search(requests, index, stage=Stage(spark)).pages.collect()))
    few = answer()
    monkeypatch.setattr(search, "BROADCAST_CLAUSES", 0)
    assert answer() == few and len(few) == 8 and fits == [True, True]
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert answer() == few and fits == [True, True, False]
