"""Near-duplicate documents: MinHash signatures, banding, verification on signatures and on full shingle sets, components.

A document's set holds its distinct runs of `k` words (A-Z in lower case); with fewer words the whole sequence is its one
shingle; a document without words is linked with nothing. Two documents are linked if the sets' intersection is at least
`percent` hundredths of their union.

Equal sets become one class first, so any number of copies costs one row. Representatives get many universal hash minima; bands of them
key buckets. Pairs are formed in two rounds. First each bucket member meets the bucket's centre, the member with most company over all bands.
Then, only where a bucket still spans several components, members of different
components meet. Each is written as its differences from the bucket's centre, what it lacks and what it has beside it; two members'
intersection follows exactly from these short lists, so the join gives out links alone, and their lengths rule most pairs out.
Every pair is confirmed on whole sets. Components come from alternating large-star and small-star steps.

At similarity 0.85 a pair shares none of 30 bands of 4 with probability 2e-10, at 0.8 with 2e-7.

Null texts are empty texts. Rows with the same doc_id and text are one document, returned per row; texts that share a doc_id are documents
of their own, linked by their sets alone, and a component's name is the smallest doc_id among them. Rows with a null
doc_id keep a null component unless they equal a document that has one. Empty tables give empty results. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import Words, among, done_with, lowered, mix, saved, slices, text_bytes, text_key

BANDS, ROWS = 30, 4
_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    data, where = text_bytes(batch)
    words = Words(lowered(data), where)
    at, h = words.runs(k)
    ends = np.searchsorted(words.row[at], np.arange(batch.num_rows + 1))
    out = []
    for i in range(batch.num_rows):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(h[ends[i] : ends[i + 1]]))
        elif b > a:
            one = np.uint64(b - a)
            for x in words.hash[a:b]:
                one = mix(one * np.uint64(3) + x)
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row doc_id, th (text_key), n (set size), two halves of the set's fingerprint, and the minima; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                n, one, two, sig = [], [], [], []
                for s in _sets(batch, k):
                    n.append(len(s))
                    if not len(s):
                        one.append(None), two.append(None), sig.append(None)
                        continue
                    one.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                    two.append(int(np.add.reduce(mix(s ^ _B[0])).view(np.int64)))
                    low = np.full(len(_A), np.iinfo(np.uint64).max)
                    for part in np.array_split(s, len(s) // 2048 + 1):
                        low = np.minimum(low, (_A[:, None] * part + _B[:, None]).min(axis=1))
                    sig.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), batch["th"], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                    ["doc_id", "th", "n", "d1", "d2", "sig"],
                )

    rows = docs.select("doc_id", text_key(docs).alias("th"), "text")
    return rows.mapInArrow(run, "doc_id bigint, th bigint, n bigint, d1 bigint, d2 bigint, sig array<int>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = [s.view(np.int64) for s in _sets(batch, k)]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, node): one row per band, only buckets with company."""
    band = lambda b: F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * ROWS + r)) for r in range(ROWS)])
    rows = reps.select("node", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("bucket"))
    return rows


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and minima do not rule out; the minima's margin is over six deviations."""
    sig = among(reps.select("node", "n", "sig"), pairs.select(F.explode(F.array("a", "b")).alias("node")), ["node"], ["node"])
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    p = percent / 100
    least = int(BANDS * ROWS * (p - 6.5 * (p * (1 - p) / (BANDS * ROWS)) ** 0.5))
    return saved(
        pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (agree >= least))
        .select("a", "b", "na", "nb"),
        "likely",
    )


def sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The sets of nodes, from the texts that stand for them. Of other texts only the few go on that a bitmap of the wanted ones lets through."""
    own = saved(among(reps, nodes, ["node"], ["node"]).join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "owners")  # of known size
    rows = among(docs.withColumn("th", text_key(docs)), own, ["doc_id", "th"], ["_id", "_th"])
    return saved(shingle_sets(rows.join(own, (rows["doc_id"] == own["_id"]) & (rows["th"] == own["_th"])), k), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b, na, nb), decided on whole sets."""
    both = F.size(F.array_intersect("xa", "xb"))
    return saved(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
        .where(100 * both >= percent * (F.col("na") + F.col("nb") - both))
        .select("a", "b"),
        "links",
    )


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, centre, n, held, lacks, beside): a set as its differences from the centre's set, which has `held` shingles."""
    return (
        pairs.join(sets.select("node", F.col("shingles").alias("x")), "node")
        .join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("c")), "centre")
        .select(
            "node", "centre", F.size("x").cast("bigint").alias("n"), F.size("c").cast("bigint").alias("held"),
            F.array_except("c", "x").alias("lacks"), F.array_except("x", "c").alias("beside"),
        )
    )


def crossing(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (differences and component) of one centre and of different components.

    The larger set is exploded to its partners' size classes, so that only sets of fitting sizes are compared. Sizes of linked sets span two classes,
    so a set travels three times.
    """
    width = max(0.03, float(np.log(100 / percent)) / 2)
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")
    low = F.ceil(F.col("n") * percent / 100)
    classes = F.explode(F.sequence(size_class(low), size_class(F.col("n")))).alias("class")
    x = members.select("centre", classes, F.col("node").alias("a"), F.col("component").alias("ca"), "n", "held", "lacks", "beside")
    y = members.select(
        F.col("centre").alias("centre_y"), size_class(F.col("n")).alias("class_y"), F.col("node").alias("b"), F.col("component").alias("cb"),
        F.col("n").alias("m"), F.col("lacks").alias("lacks_y"), F.col("beside").alias("beside_y"),
    )
    once = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    enough = lambda common: 100 * common >= percent * (F.col("n") + F.col("m") - common)
    most = F.col("held") - F.greatest(F.size("lacks"), F.size("lacks_y")) + F.least(F.size("beside"), F.size("beside_y"))
    lacked = F.size("lacks") + F.size("lacks_y") - F.size(F.array_intersect("lacks", "lacks_y"))
    common = F.col("held") - lacked + F.size(F.array_intersect("beside", "beside_y"))
    same = (F.col("centre") == F.col("centre_y")) & (F.col("class") == F.col("class_y"))
    return x.join(y, same & (F.col("ca") != F.col("cb")) & once & enough(most) & enough(common)).select("a", "b")


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, component) for every node in `links` (a, b): the smallest one reachable. Each step ends in files; `most` steps double that many times."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    for _ in range(most):
        # large star: each node links its larger neighbours to the smallest of its neighbourhood
        twice = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = twice.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = twice.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        small = small.union(joined.where("v != m").select("u", F.col("m").alias("v")))
        edges = saved(small.where("u > v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select("u", "v")
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(nodes.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept, th (text_key of its text)."""
    rows = docs.select("doc_id", "text")
    minima = saved(signatures(rows, k), "signatures")
    first = F.min("doc_id").alias("doc_id"), F.min_by("th", "doc_id").alias("th"), F.min_by("sig", "doc_id").alias("sig")
    found = minima.where("n > 0").groupBy("d1", "d2", "n").agg(*first)
    # a class is a node of the graph under a number of its own: doc_ids need not tell texts apart
    found = saved(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    signed = saved(minima.drop("sig"), "signed")  # minima are only needed until pairs are formed
    done_with(minima)
    reps = found.where("doc_id is not null")
    members = buckets(reps)
    by_bucket = saved(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    # most buckets have one member: a bitmap leaves them out before the join
    shared = saved(among(members, by_bucket, ["bucket"], ["bucket"]).join(by_bucket, "bucket"), "buckets")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    centre = shared.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("node")))["node"].alias("centre"))
    shared = saved(shared.join(centre.select("bucket", (-F.col("centre")).alias("centre")), "bucket").select("bucket", "node", "centre"), "centres")
    star = saved(shared.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "star")
    near = likely(star, reps, percent)
    classes = saved(found.drop("sig"), "classes")
    done_with(found)
    reps = classes.where("doc_id is not null")
    sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), reps, rows, k)
    links = confirmed(near, sets, percent)
    done_with(sets)
    part = saved(components(links), "components")

    # what is left: buckets that still span several components
    placed = shared.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    span = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = saved(placed.join(span, "bucket").select("node", "component", "centre").distinct(), "left")
    sets = sets_of(left.select("node").distinct(), reps, rows, k)
    members = saved(differences(left.select("node", "centre"), sets).join(left, ["node", "centre"]), "members")
    done_with(sets)
    more = saved(crossing(members, percent), "links")
    done_with(members)
    whole = saved(components(links.union(more)), "components")

    # a component is named by its smallest doc_id; one that stands alone by its own
    owned = classes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")).where("classes > 1")
    linked = owned.join(names.select("component", "component_id"), "component", "left")
    linked = linked.select("d1", "d2", F.col("n").alias("_n"), F.coalesce("component_id", F.col("doc_id")).alias("component_id"))
    same = (signed["d1"] == linked["d1"]) & (signed["d2"] == linked["d2"]) & (signed["n"] == linked["_n"])
    out = signed.join(linked, same, "left").select(
        signed["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, signed["doc_id"])).alias("component_id"), signed["th"]
    )
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th")
