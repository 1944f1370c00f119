"""Centroid clustering in whole numbers, with distances ruled out in a few rotated coordinates.

Vectors become integers once. Their main axes come from summed products of components; each vector is stored with its leading rotated
coordinates and the length of the rest. The distance of two points' leading coordinates and the difference of the two
rests together never exceed their distance, so this bound rules centroids out; those left are measured in integers, and ties go
to the smaller number. Rounding in the rotation only widens the bound, it cannot change a result.

Only centroids (k x dims) and the products (dims x dims) pass through the driver. A round's sums are taken per task, then added up by Spark.

Vectors of another length, or with a null or non-finite component, are left out. Repeated rows are vectors of their own; equal hashes
start in the order of their components; a null vec_id hashes as no digits. Fewer vectors than k: each starts a centroid. No vectors: an empty result. Components beyond
LARGEST cannot be squared in 64 bits and are an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import saved

#: Scaled components stay below this, so that 64 squared differences fit 64 bits.
LARGEST = 1 << 27


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each kept vector's components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select("vec_id", x.alias("x")).where((F.size("x") == dims) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    large = F.exists("x", lambda e: F.abs(scale * e) >= LARGEST - 1)
    whole = F.transform("x", lambda e: F.floor(scale * e).cast("int"))
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit("a component is too large to be squared in 64 bits"))).otherwise(whole).alias("v"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, width)


def axes(whole: DataFrame, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the `lead` main axes (dims x lead) of all vectors: sums of products are taken per task and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            v = _matrix(batch["v"], dims, np.float64)
            v = np.hstack([v, np.ones((len(v), 1))])
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    sums = whole.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # (dims + 1) ** 2 rows
    total = np.zeros((dims + 1) ** 2)
    for r in sums:
        total[r["at"]] = r["x"]
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, :lead]


def rotated(v: np.ndarray, mean: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the length of what they leave over."""
    c = v - mean
    lead = c @ main
    return lead, np.sqrt(np.maximum((c * c).sum(1) - (lead * lead).sum(1), 0.0))


def with_rotation(whole: DataFrame, mean: np.ndarray, main: np.ndarray) -> DataFrame:
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(_matrix(batch["v"], dims, np.float64), mean, main)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1) * main.shape[1], pa.int32()), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists, pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {kind}, v array<int>, lead array<double>, rest double")


class Centroids:
    """Centroids with their rotation, ready to be asked for the nearest."""

    def __init__(self, whole: list[list[int]], mean: np.ndarray, main: np.ndarray):
        self.whole = np.array(whole, np.int64)
        self.lead, self.rest = rotated(self.whole.astype(np.float64), mean, main)

    def _exact(self, v: np.ndarray, rows: np.ndarray, cs: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 1 << 15):
            d = v[rows[a : a + (1 << 15)]] - self.whole[cs[a : a + (1 << 15)]]
            out[a : a + (1 << 15)] = (d * d).sum(1)
        return out

    def nearest(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centroid and squared distance."""
        size = (lead * lead).sum(1)[:, None] + (self.lead * self.lead).sum(1)
        bound = size - 2 * lead @ self.lead.T + (rest[:, None] - self.rest) ** 2
        bound -= 1e-9 * (size + rest[:, None] ** 2 + self.rest**2) + 1e-6  # more than rounding can add
        every = np.arange(len(v))
        guess = bound.argmin(1)
        survives = bound <= self._exact(v, every, guess)[:, None]
        survives[every, guess] = True
        rows, cs = np.nonzero(survives)
        d = self._exact(v, rows, cs)
        best = np.minimum.reduceat(d, np.searchsorted(rows, every)) if len(v) else d
        at = np.flatnonzero(d == best[rows])
        first = at[np.unique(rows[at], return_index=True)[1]]  # rows are sorted, then centroids: the smaller number comes first
        return cs[first], best

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.whole[i].tolist())).encode()).hexdigest()


def _read(batch: pa.RecordBatch, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(batch["v"], dims, np.int64), _matrix(batch["lead"], lead, np.float64), batch["rest"].to_numpy()


def moved(points: DataFrame, centroids: Centroids) -> list[list[int]]:
    """The next centroids: floor of the mean of what is nearest to each; one that nothing is nearest to stays."""
    k, dims = centroids.whole.shape
    width = centroids.lead.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v, lead, rest = _read(batch, dims, width)
            own, _ = centroids.nearest(v, lead, rest)
            order = np.argsort(own, kind="stable")
            if len(order):
                here, at = np.unique(own[order], return_index=True)
                sums[here] += np.add.reduceat(v[order], at)
            n += np.bincount(own, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = points.select("v", "lead", "rest").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    out = centroids.whole.tolist()
    for r in added.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def assigned(points: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, its cluster and its squared distance."""
    dims, width = centroids.whole.shape[1], centroids.lead.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, d = centroids.nearest(*_read(batch, dims, width))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(own, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, lead: int = 16) -> tuple[DataFrame, list[list[int]]]:
    """Vectors (vec_id, embedding) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the final centroids."""
    spark = vectors.sparkSession
    whole = saved(integers(vectors, dims, scale), "vectors")
    chosen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [list(r["v"]) for r in whole.orderBy(chosen, "v").limit(k).collect()]
    if not start:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"), []
    mean, main = axes(whole, dims, lead)
    points = saved(with_rotation(whole, mean, main), "rotated")
    centroids = Centroids(start, mean, main)
    for _ in range(rounds):
        centroids = Centroids(moved(points, centroids), mean, main)
    placed = saved(assigned(points, centroids), "clusters")
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = spark.createDataFrame([(c, s, sum(sums.values()), centroids.digest(c)) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # at most k rows
    done = placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return done, centroids.whole.tolist()
