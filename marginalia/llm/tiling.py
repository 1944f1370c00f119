"""Benchmark passages in training documents, found by greedy string tiling.

Texts become words: letters and digits in lower case, anything else separates. Runs of `seed` words shared by a document and a
benchmark item join the two; an item of fewer words is its own seed. For each such pair the longest common run of words not yet
marked is marked again and again, found by running Karp-Rabin, until no run of a seed's length is left. The tiles' share of
the item's words is its coverage; sentences in another order are still covered. A document is contaminated if an item's
coverage reaches `least`.

Seeds of both sides are rows and Spark joins them. Tasks that read documents hold a bitmap of the benchmark's seeds, of fixed size, and
hand on only runs whose bit is set; the join decides. A tiling that reaches the coverage holds a certain number of an item's seeds, so
as many but one of its most frequent seeds need not bring pairs together: a phrase that opens every item joins nothing by itself.
Equal texts, and items with equal texts, are worked out once.

Null and empty texts match nothing, nor do items without a word; repeated rows and items are all reported, null ids are carried. Empty
tables give uncontaminated or empty results. Equal hashes of 64 bits are taken as equal words and runs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import ALNUM, Words, _powers, mix, saved, slices, text_bytes, text_key
from marginalia.operators.joins import spread_join

#: The bitmap of the benchmark's seeds has 2 ** BITS bits (8 MB), in cells of CELL bits.
BITS, CELL = 26, 32768
#: Tables of the benchmark's seeds, items or found pairs up to this many rows are broadcast.
SMALL = 500_000


def _words(batch: pa.RecordBatch) -> Words:
    at = batch.schema.get_field_index("text")
    data, where = text_bytes(batch.set_column(at, "text", pc.utf8_lower(batch["text"])))
    return Words(data, where, ALNUM)


class _Side:
    """The words of one text as hashes, which of them are free, and the hash of any window."""

    def __init__(self, values: np.ndarray):
        self.values, self.free = values, values != 0
        power, self.back = _powers(len(values))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of n free words."""
        taken = np.concatenate((np.zeros(1, np.int64), np.cumsum(~self.free)))
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, mix((self.total[at + n] - self.total[at]) * self.back[at])


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first, none overlapping in either. 0 in `text` matches nothing.

    Of equally long ones the first in the text goes first, to its first free place in the item. A round finds the longest length
    by halving and marks all tiles of that length, so the work grows with the words and the number of different lengths, not with
    how often something occurs.
    """
    a, b = _Side(item), _Side(text)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(item), len(text))
    common = lambda n: bool(np.isin(b.windows(n)[1], a.windows(n)[1]).any())
    while top >= least:
        if common(top):
            length = top
        else:
            length, over = least - 1, top
            while over - length > 1:
                middle = (length + over) // 2
                if common(middle):
                    length = middle
                else:
                    over = middle
            if length < least:
                break
        places: dict[int, list[int]] = defaultdict(list)
        for i, h in zip(*(x.tolist()[::-1] for x in a.windows(length))):
            places[h].append(i)
        # a mark of this round, like all before it, is no shorter than a window, so it covers an end of each window it meets
        open_at = lambda side, i: side.free[i] and side.free[i + length - 1]
        starts, hashes = b.windows(length)
        for j, h in zip(starts.tolist(), hashes.tolist()):
            if h not in places or not open_at(b, j):
                continue
            while places[h] and not open_at(a, places[h][-1]):
                places[h].pop()
            if places[h]:
                i = places[h].pop()
                a.free[i : i + length] = b.free[j : j + length] = False
                tiles.append((i, j, length))
        top = length - 1
    return tiles


def prepared(items: DataFrame, seed: int) -> DataFrame:
    """Per distinct item text with a word: ik (its hash), size (words of its seeds), words, seeds (hashes, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                w = _words(batch)
                out = []
                for ik, a, z in zip(batch["ik"].to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                    if z > a:
                        one = _part(w, a, z)
                        size = min(seed, z - a)
                        out.append({"ik": ik, "size": size, "words": one.hash.view(np.int64), "seeds": one.runs(size)[1].view(np.int64)})
                kind = pa.schema([("ik", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_pylist(out, kind)

    texts = items.where("text is not null").select(text_key(items).alias("ik"), "text").dropDuplicates(["ik"])
    return texts.mapInArrow(run, "ik bigint, size int, words array<bigint>, seeds array<bigint>")


def _part(w: Words, a: int, z: int) -> Words:
    """The words a to z - 1 alone."""
    one = object.__new__(Words)
    one.hash, one.row = w.hash[a:z], w.row[a:z]
    return one


def shared_runs(docs: DataFrame, seeds: DataFrame, sizes: list[int]) -> DataFrame:
    """Runs of the documents' words whose bit is set in the bitmap of seeds: th, h, at (first word), b and e (bytes)."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    cells = seeds.groupBy(F.floor(bit / CELL).alias("cell")).agg(F.bitmap_construct_agg(bit % CELL).alias("bits")).collect()
    marks = np.zeros(2**BITS // 8, np.uint8)
    for r in cells:
        marks[r.cell * CELL // 8 : (r.cell + 1) * CELL // 8] = np.frombuffer(r.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(marks.tobytes())  # 8 MB, whatever the benchmark's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                w = _words(batch)
                th = batch["th"].to_numpy()
                for size in sizes:
                    at, h = w.runs(size)
                    place = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    if not len(hit):
                        continue
                    at, h = at[hit], h[hit]
                    row = w.row[at]
                    zero = w.where[row]
                    cols = [th[row], h.view(np.int64), at - w.first[row], w.start[at] - zero, w.end[at + size - 1] - zero]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["th", "h", "at", "b", "e"])

    rows = docs.where("text is not null").select(text_key(docs).alias("th"), "text")
    return rows.mapInArrow(run, "th bigint, h bigint, at bigint, b bigint, e bigint")


def makers(items: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """(h, ik): the seeds that bring pairs together. A tiling that reaches the coverage holds at least words x least / size seeds of the
    item; the most frequent ones, one fewer than that in all, are left out."""
    often = seeds.groupBy("h").agg(F.count("*").alias("often"))
    needed = items.select("ik", F.ceil(F.ceil(F.size("words") * F.lit(least) - 1e-9) / F.col("size")).alias("needed"))
    upto = Window.partitionBy("ik").orderBy(F.desc("often"), "h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seeds.join(often, "h").withColumn("upto", F.sum("times").over(upto))
    return ranked.join(needed, "ik").where("upto >= needed").select("h", "ik")


def tilings(docs: DataFrame, items: DataFrame, seed: int = 5, least: float = 0.6) -> DataFrame:
    """(th, ik, coverage, tiles) for each text and item text whose coverage reaches `least`; tiles are (item word, text byte from, to)."""
    items = saved(prepared(items, seed), "items")
    seeds = saved(items.select("ik", F.explode("seeds").alias("h")).groupBy("ik", "h").agg(F.count("*").alias("times")), "seeds")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `seed` of them
    few = seeds.count() <= SMALL
    hits = saved(shared_runs(docs, seeds, sizes), "hits").dropDuplicates(["th", "h", "at"])
    known = saved(spread_join(seeds.select("h").distinct(), hits, ["h"], "th", few, _many(hits, "h")), "known")
    once = known.select("th", "h").distinct()
    pairs = spread_join(makers(items, seeds, least), once, ["h"], "th", few, _many(once, "h")).select("th", "ik").distinct()
    pairs = saved(pairs, "pairs")
    wanted = spread_join(seeds.select("ik", "h"), pairs, ["ik"], "th", few, _many(pairs, "ik"))
    found = known.join(wanted, ["th", "h"]).groupBy("th", "ik").agg(F.collect_list(F.struct("at", "h", "b", "e")).alias("runs"))
    words = items.select("ik", "size", "words", "seeds")
    short = few and (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= SMALL
    return spread_join(words, found, ["ik"], "th", short, _many(pairs, "ik")).mapInArrow(
        _tiler(least), "th bigint, ik bigint, coverage double, tiles array<struct<at: bigint, b: bigint, e: bigint>>"
    )


def _many(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows"))


def _tiler(least: float):
    kind = pa.schema(
        [("th", pa.int64()), ("ik", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("at", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                th, ik, size = (batch[c][i].as_py() for c in ("th", "ik", "size"))
                words, seeds = (batch[c][i].values.to_numpy() for c in ("words", "seeds"))
                runs = batch["runs"][i].values
                at, h, b, e = (pc.struct_field(runs, c).to_numpy() for c in ("at", "h", "b", "e"))
                order = np.argsort(at)
                spans = _one(words, seeds, size, at[order], h[order])
                if sum(n for _, _, n in spans) < math.ceil(least * len(words) - 1e-9):
                    continue
                where = dict(zip(at.tolist(), zip(b.tolist(), e.tolist())))
                tiles = [{"at": a, "b": where[j][0], "e": where[j + n - size][1]} for a, j, n in spans]
                out.append({"th": th, "ik": ik, "coverage": sum(n for _, _, n in spans) / len(words), "tiles": tiles})
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _one(words: np.ndarray, seeds: np.ndarray, size: int, at: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """Tile an item over the words of a text that stand in a shared run; no other word can be in a tile, and what these words are the item says."""
    order = np.argsort(seeds, kind="stable")
    start = order[np.searchsorted(seeds[order], h)]
    place, first = np.unique(at[:, None] + np.arange(size), return_index=True)
    value = words[(start[:, None] + np.arange(size)).ravel()[first]]
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    place, value = np.insert(place, gap, -1), np.insert(value, gap, 0)
    return [(i, int(place[j]), n) for i, j, n in tile(words.view(np.uint64), value.view(np.uint64), size)]


def contaminated(docs: DataFrame, items: DataFrame, seed: int = 5, least: float = 0.6) -> DataFrame:
    """Per row doc_id, th (hash of its text), contaminated, coverage (the largest), item_ids (sorted)."""
    found = saved(tilings(docs, items, seed, least), "tilings")
    names = items.where("text is not null").select("item_id", text_key(items).alias("ik")).distinct()
    hits = found.join(names, "ik").groupBy("th").agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select("doc_id", text_key(docs).alias("th"))
    both = rows.join(F.broadcast(hits) if found.count() <= SMALL else hits, "th", "left")
    none = F.array().cast("array<bigint>")
    return both.select(
        "doc_id", "th", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", none).alias("item_ids")
    )
