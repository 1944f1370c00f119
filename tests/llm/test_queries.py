"""Every registered query of these operators against its SQL, or against plain Python, on the smallest tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from marginalia.llm import oracles, packing, queries, spans, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows(spark, name):
    assert difference(spark, connect(SF), SF, queries.QUERIES[name], oracles.ORACLES[name]) is None


def test_all_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def repeated_bytes(texts: dict, length: int = 100) -> dict:
    """What a dictionary of all strings says."""
    seen, out = set(), {}
    for doc in sorted(texts):
        raw = texts[doc].encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = [True] * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_repeated_bytes(spark, SF).collect()}
    assert got == repeated_bytes(docs)


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_ids(spark, SF).collect()}
    start = 0
    for doc in sorted(docs):
        ids = t.encode(docs[doc], add_special_tokens=False).ids + [2]
        assert got[doc] == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert tokens.BLOCK % tokens.STEP == 0


def test_packing(spark, docs):
    rows = queries.op7_packing(spark, SF).collect()
    n = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == n
    # the least padding over all lengths, by plain dynamic programming
    cells = {}
    for x in n.values():
        cells.setdefault(x, []).append(x)
    groups = sorted(cells.values(), key=max)
    best = {0: 0}
    for _ in range(8):
        new = dict(best)
        for j in range(1, len(groups) + 1):
            top = max(groups[j - 1])
            for i in range(j):
                if i in best:
                    cost = best[i] + sum(top - x for g in groups[i:j] for x in g)
                    if cost < new.get(j, 1e18):
                        new[j] = cost
        best = new
    assert sum(r.padding for r in rows) == best[len(groups)]
    by = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        by.setdefault((r.bucket, r.bucket_length), []).append(r.batch)
    for (_, bound), batches in by.items():
        per = max(1, 16384 // max(1, bound))
        assert batches == [i // per for i in range(len(batches))]


def test_bounds_of_ties_and_few_cells():
    assert packing.bounds([], 4) == []
    assert packing.bounds([(5, 2, 10)], 4) == [5]
    assert packing.bounds([(1, 1, 1), (2, 1, 2), (9, 1, 9)], 2) == [2, 9]


def test_bounds_are_the_best_of_all():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(0, 60, rng.integers(1, 12))})
        cells = [(x, int(rng.integers(1, 30))) for x in lengths]
        waste = lambda tops: sum((min(t for t in tops if t >= x) - x) * n for x, n in cells)
        for k in (1, 2, 3, 5):
            got = packing.bounds([(x, n, x * n) for x, n in cells], k)
            tries = itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1)
            assert got[-1] == lengths[-1] and waste(got) == min(waste((*t, lengths[-1])) for t in tries)


def plain_runs(text: str, sentences: int = 2, words: int = 12):
    """(words of the run, from, to in bytes) by the definition."""
    raw = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    units = [i for i, (a, _) in enumerate(found) if i == 0 or raw[found[i - 1][1] - 1 : found[i - 1][1]] in (b".", b"!", b"?") or b"\n" in raw[found[i - 1][1] : a]]
    ends = units[1:] + [len(found)]
    for u in range(len(units)):
        v = u + sentences - 1
        while v < len(units) and ends[v] - units[u] < words:
            v += 1
        if v < len(units):
            run = tuple(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[a:z]) for a, z in found[units[u] : ends[v]])
            yield run, found[units[u]][0], found[ends[v] - 1][1]


def test_sentence_spans(spark, docs):
    first, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        for run, a, z in plain_runs(docs[d]):
            if run in first:
                gone[d].update(range(a, z))
            first.add(run)
    rows = queries.op2_sentence_spans(spark, SF).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {d: len(g) for d, g in gone.items()}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r.text.encode() == bytes(b for i, b in enumerate(raw) if i not in gone[r.doc_id])


def test_benchmark_items_are_found(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_decontamination(spark, SF).collect()}
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {i: {tuple(word(t)[j : j + 5]) for j in range(len(word(t)) - 4)} for i, t in items.items()}
    for d, t in docs.items():
        w = word(t)
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        whole = {i for i, t in items.items() if t in docs[d]}
        assert whole <= set(got[d].item_ids)
        # an item that shares no run cannot be named
        assert all(runs[i] & own for i in got[d].item_ids)
        assert got[d].contaminated == bool(got[d].item_ids)


def test_toxicity_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    right = Counter((r.toxic, r.predicted) for r in held)
    assert right[1, 1] / max(1, right[1, 0] + right[1, 1]) > 0.75
    assert right[0, 1] / (right[0, 0] + right[0, 1]) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_a_long_sentence_and_capitals_inside_it_are_one_unit():
    import numpy as np

    from marginalia.llm.base import Words

    text = " ".join(f"{'W' if i % 3 else 'w'}ord{i}" for i in range(100)) + ". Another one! And a third"
    data = np.frombuffer(text.encode(), np.uint8)
    assert list(spans.units(data, Words(data, np.array([0, len(data)])))) == [0, 100, 102]


def test_only_whole_sentences_go(spark):
    german = "Gestern war es so: der alte Mann geht mit der kleinen Tochter am Montag nach Berlin und kauft dort ein neues Fahrrad fuer den Sohn."
    inner = "der alte Mann geht mit der kleinen Tochter am Montag nach Berlin und kauft dort ein neues"
    long = " ".join(f"Wort{i}" for i in range(100)) + "."
    rows = [
        (1, f"{inner} Auto. {long} {inner} Haus."),
        (2, german),
        (3, f"Ganz anders hier. {long} {inner} Haus. Und Schluss."),
        (4, f"Nur der eine Satz. {long} Mehr nicht."),
    ]
    done = spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept = {r.doc_id: r.kept.decode() for r in done.collect()}
    assert kept[1] == rows[0][1] and kept[2] == german and kept[4] == rows[3][1]
    assert kept[3].split() == "Ganz anders hier. Und Schluss.".split()
