"""Filter interactions against plain counting."""

import itertools

import pytest
from pyspark.sql import functions as F

from marginalia.llm import audit, queries

SF = "/root/testdata/sf0.001"


def by_counting(masks: dict, names: str) -> dict:
    out = {}
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order):
            bit = 1 << f
            pick = lambda ok, i=0: sum(c[i] for m, c in masks.items() if ok(m))
            gone = lambda m, b=before, bit=bit: m & b == 0 and m & bit
            out["".join(names[x] for x in order), step + 1] = (
                pick(lambda m: m & (before | bit) == 0), pick(gone), pick(lambda m: m & before and m & bit), pick(lambda m: m == bit), pick(gone, 1), pick(gone, 2),
            )
            before |= bit
    shared = {f: sum(v[1] for (o, s), v in out.items() if o[s - 1] == f) for f in names}
    return {k: (*v, shared[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("masks", [{}, {0: (5, 1, 0)}, {31: (2, 0, 2)}, {m: (m * 7 % 5 + 1, m % 2, m % 3) for m in range(0, 32, 3)}, {m: (1, 1, 1) for m in range(32)}])
def test_diagrams_count_right(masks):
    got = {(r[0], r[1]): tuple(r[2:]) for r in audit.audited(masks, "ABCDE")}
    assert got == by_counting(masks, "ABCDE") and len(got) == 600


def test_swaps_run_through_all_orders_and_equal_parts_are_one_node():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        for level in [None, *audit.swaps(n)]:
            if level is not None:
                order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(audit.swaps(n)) + 1 == len(list(itertools.permutations(range(n))))
    # all masks alike: one node per level and one leaf
    d = audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert len(d.nodes) == 1 + 1 + 5
    d.swap(2)
    assert d.order == [0, 1, 3, 2, 4] and d.total(d.root) == (32, 0, 0)


def failures(text: str) -> int:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return (
        (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        + 8 * any(c in "#$%&*|" for c in text)
    )


def test_masks_at_the_edges(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, None, None), (2, "", "en"), (3, many, "en"), (4, many, "en"), (4, many, "en"), (3, many, "en"), (5, many, None), (None, many, "en"), (None, None, ""),
        (6, "LOUD #1", "fr"), (7, "é" * 10, "fr"), (8, "a " * 150, "fr"), (9, many * 200, "fr"), (10, "Loud #1", "fr"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", *[F.lit("x").alias(c) for c in ("key", "part", "bits", "n", "good")])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (6, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    want = {}
    for d, t, part in rows:
        mask = failures(t or "") + 16 * (d is not None and d > first[t or ""])
        c = want.setdefault((part or "", mask), [0, 0, 0])
        c[0] += 1
        c[1] += d == 3
        c[2] += d in (3, 6)
    got = {(r.part, r["mask"]): [r.n, r.good, r.toxic] for r in audit.masks(docs, labels).collect()}
    assert got == want
    done = audit.interactions(audit.masks(docs, labels)).collect()
    assert len(done) == 600 * 3 and {r.part for r in done} == {"", "en", "fr"}
    assert audit.interactions(audit.masks(docs.limit(0), labels)).count() == 0
    assert audit.interactions(audit.masks(docs, labels.limit(0))).count() == 1800


def test_query_against_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    marks = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first, parts = {}, {}
    for r in docs:
        first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    for r in docs:
        c = parts.setdefault(r.lang or "", {}).setdefault(failures(r.text or "") + 16 * (r.doc_id > first[r.text or ""]), [0, 0, 0])
        good, toxic = marks.get(r.doc_id, (False, False))
        c[0], c[1], c[2] = c[0] + 1, c[1] + good, c[2] + toxic
    want = {(p, *k): v for p, m in parts.items() for k, v in by_counting(m, "ABCDE").items()}
    assert {tuple(r[:3]): tuple(r[3:]) for r in queries.op11_filter_audit(spark, SF).collect()} == want
