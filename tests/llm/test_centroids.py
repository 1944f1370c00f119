"""Clustering in whole numbers against a plain loop."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import centroids

NAN, INF = float("nan"), float("inf")


def plainly(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(x) // len(got) for x in zip(*got)] if (got := [v for (_, v), o in zip(kept, own) if o == i]) else c for i, c in enumerate(cs)]
    done = [(i, *near(v)) for i, v in kept]
    of = {c: sum(d for _, d, x in done if x == c) for _, _, c in done}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    return sorted(((i, c, d, of[c], sum(of.values()), digest[c]) for i, d, c in done), key=key), cs


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in ("v", "cluster", "lead", "x")])
    done, cs = centroids.cluster(df, **options)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    return sorted((tuple(r) for r in done.collect()), key=key), cs


@pytest.mark.parametrize("spread", [0.02, 1.0, 300.0])
def test_against_a_plain_loop(spark, spread):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (7, 8)) * spread
    rows = [(i, (base[i % 7] + rng.normal(0, 0.3, 8) * spread).astype(np.float32).tolist()) for i in range(300)]
    assert run(spark, rows, k=12, rounds=4, dims=8, lead=3) == plainly(rows, 12, 4, 8)


def test_edges(spark):
    same = [0.25] * 4
    rows = [(1, same), (1, same), (2, same), (3, [-0.25] * 4), (None, [1.0, 2.0, 3.0, 4.0]), (4, None), (5, []), (6, [1.0] * 5), (7, [1.0, None, 1.0, 1.0]), (8, [NAN] * 4), (9, [INF, 0.0, 0.0, 0.0])]
    for k in (1, 3, 40):  # fewer vectors than centroids, centroids that coincide (ties) and stay empty
        assert run(spark, rows, k=k, rounds=3, dims=4, lead=2) == plainly(rows, k, 3, 4)
    assert run(spark, rows[5:], k=3, dims=4) == ([], [])
    assert run(spark, [], k=3, dims=4) == ([], [])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9] * 4)], k=1, dims=4)


def test_the_bound_never_exceeds_the_distance_and_spares_measuring():
    rng = np.random.default_rng(9)
    v = np.floor(256 * (rng.normal(0, 1, (2000, 64)) * np.geomspace(1, 0.01, 64))).astype(np.int64)
    mean = v.mean(0)
    main = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :16]
    cs = centroids.Centroids(v[:40].tolist(), mean, main)
    measured = []
    exact = cs._exact
    cs._exact = lambda a, rows, c: measured.append(len(rows)) or exact(a, rows, c)
    own, d = cs.nearest(v, *centroids.rotated(v.astype(float), mean, main))
    every = ((v[:, None] - v[None, :40]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (d == every.min(1)).all()
    assert measured[1] < 3 * len(v)  # of 40 centroids each
