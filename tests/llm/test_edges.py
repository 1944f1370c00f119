"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import gzip
import math
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import archive, chat, minhash, packing, quality, spans, suffix, tiling, tokens, toxicity
from marginalia.llm.base import text_key

LONG = " ".join(f"Word{i % 977} and{i % 13}." for i in range(30_000))
PASSAGE = "The first of many words stands here with others. Then another one follows it closely, and more. At last a third sentence ends it all."
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, None),
    (4, PASSAGE, "en", "a", 1),
    (5, "Before it. " + PASSAGE + " After it.", "en", None, 1),
    (6, PASSAGE, None, "b", 1),
    (6, PASSAGE, None, "b", 1),
    (None, PASSAGE, "en", "a", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "b", 1),
    (8, "é日本語 " * 40, "fr", "b", 1),
    (9, "x", "fr", "b", 1),
]
CLASHING = ["n_words", "kept", "th", "doc", "bucket", "_slot", "k", "rank", "matches", "b", "e", "n", "sig", "component", "cell", "h", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (None, PASSAGE)], "item_id bigint, text string")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))


ALL = ids([type("R", (), {"doc_id": r[0]}) for r in ROWS])


def test_quality(docs):
    rows = quality.judge(docs).collect()
    assert ids(rows) == ALL
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if not (r.text or "").strip())
    assert quality.judge(docs.limit(0)).count() == 0


def test_fences_follow_language_and_source(spark):
    """Long words are usual in one group and odd in another; a group of one document is judged by its language."""
    text = lambda n, i: " ".join("abcdefghijklmnopqrstuvwxyz"[(i * 7 + j * j) % 26] * (n + (i + j) % 3) for j in range(40))
    rows = [(i, text(4, i), "en", "web") for i in range(400)] + [(1000 + i, text(14, i), "en", "chem") for i in range(400)]
    rows += [(2000 + i, text(7, i), "de", "web") for i in range(400)]
    rows += [(5000, text(14, 1), "en", "web"), (5001, text(14, 1), "en", "chem"), (5002, text(14, 1), "de", "new"), (5003, text(7, 1), "de", "new2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert all(kept[d] for d in kept if d < 5000)
    assert (kept[5000], kept[5001], kept[5002], kept[5003]) == (False, True, False, True)
    limits = {(r._lang, r._source): r._fence_chars_per_word for r in quality.fences(quality.sketches(quality.measure(df))).collect()}
    assert limits["en", "web"] < 14 < limits["en", "chem"] and limits["de", "web"] < 14


def test_spans(docs):
    rows = spans.remove_repeats(docs, ["lang"]).collect()
    assert ids(rows) == ALL
    # 4 has the first copy; what follows it and stands in 5 and 6 goes, 6's repeated rows alike
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.kept.decode(), r.n_spans))
    assert by[4] == {(PASSAGE, 0)} and by[6] == {("", 1)} and len(by[5]) == 1
    assert "many words" not in next(iter(by[5]))[0]
    assert by[1] == by[2] == {("", 0)}
    assert spans.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_bytes(docs):
    rows = suffix.remove_repeated_bytes(docs).collect()
    assert ids(rows) == ALL
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed))
    n = len(PASSAGE)
    assert by[4] == {(n, 0)} and by[6] == {(n, n)} and by[1] == {(0, 0)}
    # a document repeats itself: all but the first period goes
    raw = ("é日本語 " * 40).encode()
    assert by[8] == {(len(raw), len(raw) - 12)}
    assert suffix.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_anchors_split_by_whole_strings_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    core = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(20)) + core + " ".join(word() for _ in range(20))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    take = lambda: sorted(tuple(r) for r in suffix.remove_repeated_bytes(df).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect())
    plain = take()
    monkeypatch.setattr(suffix, "LARGE", 5)
    assert take() == plain
    assert all(r[1] >= len(core) for r in plain[1:])


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert ids(rows) == ALL
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[4] == {(4, True)} and by[6] == {(4, False)} and by[1] == {(1, True)} and by[9] == {(9, True)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_a_doc_id_are_documents_of_their_own(spark):
    base = [f"w{i}" for i in range(60)]
    a, a1, b = " ".join(base), " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(60))
    rows = [(3, a), (5, a1), (5, b), (9, b + " x"), (9, a + " y"), (9, "alone " + " ".join(f"u{i}" for i in range(30))), (9, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_text = {t: i for i, (_, t) in enumerate(rows)}
    keyed = df.withColumn("th", text_key(df)).distinct()
    got = minhash.near_duplicates(df).join(keyed.select("th", "text"), "th").collect()
    assert {(by_text[r.text], r.doc_id): (r.component_id, r.kept) for r in got} == {
        (7, 3): (3, True), (1, 5): (3, False), (2, 5): (5, True), (3, 9): (5, False), (4, 9): (3, False), (5, 9): (9, True), (6, 9): (9, True), (7, None): (3, False),
    }


def test_the_pipeline_drops_rows_not_numbers(spark):
    base = [f"w{i}" for i in range(60)]
    a, a1, b = " ".join(base), " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(60))
    rows = [(3, a), (5, a1), (5, b), (6, b), (7, "c c"), (7, "c c"), (8, a), (8, a1), (2, a), (2, a + " z"), (None, a), (None, None), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.near_duplicates(spark, df, "").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = sorted(((r.doc_id, r.text) for r in left), key=key)
    # one of the two texts of document 2 stands for its group, whichever hashes lower
    two = [t for d, t in got if d == 2]
    assert len(two) == 1 and two[0] in (a, a + " z")
    assert [r for r in got if r[0] != 2] == [(None, None), (None, None), (5, b), (7, "c c")]


def test_near_duplicates_keep_no_sets_or_minima(docs, tmp_path, monkeypatch):
    """Minima, sets and differences are deleted once pairs and links are known."""
    from marginalia.llm import base

    monkeypatch.setattr(base, "shared_dir", lambda spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    assert minhash.near_duplicates(docs).count() == docs.count()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "signed" in left and not left & {"signatures", "sets", "members"}


def test_crossing_sends_a_set_to_few_size_classes(spark):
    """Links between differences of every fitting size, each set in three classes at most."""
    rows = [(n, 7, n, n, 300, list(range(n, 300)), []) for n in range(200, 300)]
    members = spark.createDataFrame(rows, "node long, centre long, component long, n long, held long, lacks array<long>, beside array<long>")
    for percent in (80, 85, 100):
        links = minhash.crossing(members, percent)
        want = {(a, b) for a in range(200, 300) for b in range(200, a) if 100 * b >= percent * a}
        assert {tuple(r) for r in links.collect()} == want
    text = minhash.crossing(members.limit(1), 85)._jdf.queryExecution().optimizedPlan().toString()
    width = float(text.split("/ 0.0")[1][:6].split(")")[0].join(("0.0", "")))
    assert -math.log(0.85) / width <= 2.01


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 90)]
        for _ in range(int(rng.integers(1, 25))):
            own = list(base)
            for p in rng.integers(0, 90, int(rng.integers(0, 8))):
                own[p] = f"w{rng.integers(0, 5000)}"
            rows.append((n, " ".join(own)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for i in range(n):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in range(n)}


def test_tiling(docs, items):
    rows = tiling.contaminated(docs, items).collect()
    assert ids(rows) == ALL
    assert {r.doc_id for r in rows if r.contaminated} == {4, 5, 6, None}
    assert tiling.contaminated(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in tiling.contaminated(docs, items.limit(0)).collect())


def test_tiling_finds_reordered_passages_and_counts_no_word_twice(spark):
    parts = PASSAGE.split(". ")
    moved = "Other words come. " + ". ".join([parts[2].rstrip("."), parts[0], parts[1]]) + ". Nothing else."
    df = spark.createDataFrame([(1, moved), (2, "The first of many words stands alone.")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    got = {r.doc_id: r for r in tiling.contaminated(df, items).collect()}
    assert got[1].contaminated and got[1].coverage == 1.0 and not got[2].contaminated
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64)
    b = np.array([6, 7, 8, 9, 10, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5], np.uint64)
    assert sorted(tiling.tile(a, b, 5)) == [(0, 6, 5), (5, 0, 5)] or sorted(tiling.tile(a, b, 5)) == [(0, 12, 5), (5, 0, 5)]


def plain_tiles(a, b, least):
    """The longest free common run by trying all places, the first in the text and then in the item, until none is left."""
    free_a, free_b, tiles = [True] * len(a), [x != 0 for x in b], []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least or not n:
            return tiles
        tiles.append((i, j, n))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


def test_tiles_against_all_places():
    rng = np.random.default_rng(11)
    for _ in range(150):
        a = rng.integers(1, 4, rng.integers(1, 14)).astype(np.uint64)
        b = rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64)
        least = int(rng.integers(1, 5))
        assert tiling.tile(a, b, least) == plain_tiles(a.tolist(), b.tolist(), least)


def test_tiling_of_a_periodic_text_is_quick():
    import time

    a, b = np.tile(np.array([5, 6], np.uint64), 200), np.tile(np.array([5, 6], np.uint64), 20_000)
    began = time.perf_counter()
    assert tiling.tile(a, b, 5) == [(0, 0, 400)]
    assert time.perf_counter() - began < 0.5


def test_contamination_against_brute_force(spark):
    """Every document and item compared whole: short items, items with equal texts, shared openings, reordered parts, copies."""
    rng = np.random.default_rng(17)
    word = lambda: "abcdefghij"[rng.integers(0, 10)] * int(rng.integers(1, 4))
    opening = "which of these is right then"
    items = [(i, opening + " " + " ".join(word() for _ in range(rng.integers(4, 20)))) for i in range(25)]
    items += [(90, "zig zag"), (91, "Zig, ZAG!"), (92, "lone"), (93, " .. "), (94, None), (95, ""), (3, items[3][1])]
    docs = []
    for d in range(60):
        picks = [items[int(x)][1].split() for x in rng.integers(0, 25, 2)]
        cut = int(rng.integers(0, len(picks[0])))
        parts = [picks[0][cut:] + picks[0][:cut], [word() for _ in range(15)], picks[1][: int(rng.integers(0, len(picks[1])))]]
        docs.append((d, " ".join(w for p in parts for w in p) + [" zig zag", " zigzag", " Lone."][d % 3]))
    docs += [(5, docs[5][1]), (None, docs[6][1]), (70, opening), (71, None), (72, "")]
    seen = tiling.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = []
    for d, text in docs:
        shares = {}
        for i, t in items:
            a = words(t)
            if a:
                n = sum(x[2] for x in plain_tiles(a, words(text), min(5, len(a))))
                if n >= 0.6 * len(a):
                    shares[i] = n / len(a)
        want.append((d, bool(shares), max(shares.values(), default=0.0), sorted(shares)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted([(r.doc_id, r.contaminated, r.coverage, r.item_ids) for r in seen], key=key) == sorted(want, key=key)
    assert 10 < sum(r[1] for r in want) and any(r[1] and not set(r[3]) & {90, 91, 92} for r in want)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert ids(rows) == ALL
    assert all(r.padding >= 0 and r.n_tokens <= r.bucket_length for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_batches_of_sparse_and_equal_ids(spark):
    """Hashed ids, and one row that makes a third of the table."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("w "), (F.col("id") % 700).cast("int"))).alias("text"),
    )
    rows = packing.pack(df, buckets=3, budget=2000).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.batch)):
        by.setdefault((r.bucket, r.bucket_length), []).append(r.batch)
    assert len(rows) == 3000 and len(by) == 3
    for (_, bound), batches in by.items():
        per = max(1, 2000 // bound)
        assert batches == [i // per for i in range(len(batches))]


def test_archive(spark, tmp_path):
    rows = [
        (1, "u", "x"), (2, None, None), (3, "http://a/%0A\n", "x"), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "x"), (5, "u", ""),
        (6, "https://a.example/x%20y", "long " * 40_000),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit("clash"))
    index = archive.write(pages, str(tmp_path / "warc"))
    got = archive.fetch(index).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload) for r in got), key=key) == [
        (None, "revisit", 3, None), (1, "revisit", 3, None), (2, "revisit", 5, None), (3, "response", None, "x"),
        (4, "response", None, rows[3][2]), (4, "response", None, rows[3][2]), (5, "response", None, ""), (6, "response", None, rows[7][2]),
    ]
    assert {r.url for r in got if r.page_id == 3} == {"http://a/%0A\n"}
    assert [r.page_id for r in archive.fetch(index.where("page_id = 6")).collect()] == [6]
    assert archive.fetch(archive.write(pages.limit(0))).count() == 0
    # a reader that knows no index sees plain records, and targets as they were
    seen = {}
    for name in {r.path for r in index.collect()}:
        with gzip.open(name.removeprefix("file://")) as f:
            while line := f.readline():
                assert line == b"WARC/1.1\r\n"
                fields = dict(x.decode().rstrip("\r\n").split(": ", 1) for x in iter(f.readline, b"\r\n"))
                body = f.read(int(fields["Content-Length"]))
                assert f.read(4) == b"\r\n\r\n"
                seen[fields["WARC-Record-ID"]] = (fields["WARC-Target-URI"], body)
    assert seen["<urn:page:6>"] == (rows[7][1], rows[7][2].encode()) and seen["<urn:page:3>"] == ("http://a/%0A%0A", b"x") and len(seen) == 7
    assert sum(r.length for r in index.collect()) == sum(os.path.getsize(p.path.removeprefix("file://")) for p in index.select("path").distinct().collect())


def test_archives_keep_bytes_that_are_not_text(spark):
    odd = F.unhex(F.lit("FF00C3")).cast("string")
    pages = spark.range(3).select(F.col("id").alias("page_id"), odd.alias("url"), F.when(F.col("id") > 0, odd).alias("html"))
    got = archive.fetch(archive.write(pages)).select("page_id", F.hex("url"), F.hex("payload"), "payload_bytes").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, "FF00C3", "", 0), (1, "FF00C3", None, 3), (2, "FF00C3", "FF00C3", 3)]


def test_toxicity(spark, docs):
    texts = [(i, f"plain words here {i} and more") if i % 2 else (i, f"you id1оt number {i} go away") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = df.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic")).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic bigint"))
    lexicon = toxicity.learn(df, labels)
    scores = {r.doc_id: r.score for r in toxicity.scored(df, lexicon).collect()}
    assert min(scores[i] for i in range(0, 40, 2)) > max(scores[i] for i in range(1, 40, 2))
    assert ids(toxicity.scored(docs, lexicon).collect()) == ALL
    spared = toxicity.Lexicon({"idiot ": 3.0}, ["village idiot"])
    assert spared.density("The village IDIOT sang") == 0 < spared.density("an 1d10t sang")
    assert toxicity.Lexicon({"idiot ": 3.0}, ["village idiot", "the village"]).density("the village idiot and the idiot") == 300 / 6
    empty = toxicity.learn(df.limit(0), labels)
    assert toxicity.scored(df, empty).count() == 40


def test_exception_phrases_are_learnt(spark):
    texts = [(i, f"the village idiot sang song {i}" if i % 4 == 0 else f"you are an idiot {i}" if i % 4 == 1 else f"plain text {i}") for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 1).cast("int").alias("toxic"))
    lexicon = toxicity.Lexicon({"idiot ": 3.0}, [])
    labelled = df.join(labels, "doc_id").select("text", "toxic")
    assert sorted(toxicity._innocent(labelled, lexicon, 30, 90, 10)) == ["idiot sang", "village idiot"]
    assert toxicity._innocent(labelled.limit(0), lexicon, 30, 90, 10) == []


def test_chat(spark):
    parts = "array<struct<kind: string, text: string, ref: string, size: bigint>>"
    rows = [
        (1, 0, "user", [("text", "look <|turn|> ~a", None, None), ("image", None, "i.png", 2048), ("audio", None, "s.wav", 80)]),
        (1, 1, "assistant", [("text", "a</s>", None, None), ("document", None, "d.pdf", None), ("text", None, None, None)]),
        (1, 1, "assistant", None),
        (None, None, None, [("odd", "kept", None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {parts}").withColumn("loss", F.lit(0))
    done = chat.saved_format(df)
    one = {r.conv_id: r for r in done.collect()}
    # the turn without parts stands before its equal
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in one[1].attachments] == [(0, 0, "image", "i.png", 87), (1, 0, "audio", "s.wav", 3), (2, 2, "document", "d.pdf", 1)]
    back = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert back[1].turns[0].text.startswith("look <|turn|> ~a") and "a</s>" in back[1].learnt
    assert [(t.role, t.text) for t in back[None].turns] == [("", "kept")]
    assert chat.read_back(chat.saved_format(df.limit(0))).count() == 0


def test_tokens(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.read(tokens.write(docs, path, 50257, 2)).collect()
    assert ids(got) == ALL
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert tokens.read(tokens.write(docs.limit(0), path, 50257, 2)).count() == 0


def test_code_lengths():
    counts = np.array([2**i for i in range(30)] + [0])
    free, tight = tokens.code_lengths(counts, 30), tokens.code_lengths(counts, 6)
    for lengths in (free, tight):
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1
    assert tight.max() == 6 and free.max() == 29 and free[30] == 0
    assert list(tokens.code_lengths(np.array([0, 5, 0]))) == [0, 1, 0]
    # no shorter code of four symbols exists
    assert list(tokens.code_lengths(np.array([1, 1, 2, 4]))) == [3, 3, 2, 1]


@pytest.mark.parametrize("many", [None, 0])
def test_pipeline_stages(spark, docs, items, tmp_path, many):
    pq.write_table(items.toArrow(), f"{tmp_path}/benchmark.parquet")
    rows = docs if many is None else docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == (0 if many == 0 else len(ROWS))


def test_pipeline_stages_take_effect(spark, docs, items, tmp_path):
    pq.write_table(items.toArrow(), f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert set(ids(stage["near_duplicates"](spark, docs, "").collect())) == {None, 1, 2, 3, 4, 7, 8, 9}
    assert set(ids(stage["benchmark_passages"](spark, docs, str(tmp_path)).collect())) == {None, 1, 2, 3, 7, 8, 9}
    left = {r.doc_id: r.text for r in stage["repeated_passages"](spark, docs, "").collect()}
    assert left[4] == PASSAGE and 6 not in left and "many words" not in left[5]


def test_a_bitmap_lets_wanted_rows_through_and_few_others(spark):
    from marginalia.llm import base

    rows = spark.range(20000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), (F.col("id") * 3).alias("th"))
    keys = rows.where("th % 77 = 0").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    met = base.flagged(rows, keys, ["doc_id", "th"], ["_id", "_th"])
    assert met.count() == 20000 and met.columns == ["doc_id", "th", "_likely"]
    assert met.where("th % 77 = 0 and not _likely").isEmpty()
    assert met.where("_likely").count() <= keys.count() + 5
    assert base.among(rows, keys.limit(0), ["doc_id", "th"], ["_id", "_th"]).isEmpty()
