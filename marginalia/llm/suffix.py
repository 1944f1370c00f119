"""Repeated byte strings: every byte covered by a `length`-byte string that also starts earlier is removed.

"Earlier" is a smaller doc_id, or an earlier start in the same document; strings are judged on the input.

A longest-previous-factor array says for each start how far its string also runs from an earlier start; a factor of `length`
and more removes its bytes. The array is built where it can be non-trivial only. In every string of `length` bytes the GRAM-byte piece with the
smallest hash is its anchor, so equal strings have equal anchors. Neighbouring starts with one anchor share a context, the
bytes they cover. Contexts are sorted by anchor and content over all documents:
 - an anchor seen once has no earlier match;
 - of equal contexts all but the first are removed whole, settled by hash: they need no array;
 - different contexts of one anchor go to a block: suffix order by prefix doubling, the bytes shared with the neighbour in that order,
   the previous and the next smaller position of every suffix, and the factor as the larger of what it shares with these two;
 - anchors with very many different contexts are split by the whole string, each start a row of its own, and sorted again: starts with
   an equal string are neighbours in suffix order, and all but the first have an earlier match.

Null and short texts lose nothing. doc_id names a text: rows repeated with one doc_id and text are one document; rows with a null doc_id
are ordered by a hash of their text. Empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import mix, polynomial, saved, slices, text_bytes, text_key
from marginalia.llm.copies import ROW, first_here, rows_of, sort_out
from marginalia.llm.cut import cut

GRAM = 32
#: Contexts of one anchor above which it is split by whole strings, and bytes of contexts ranked together.
LARGE, BLOCK = 2_000, 1 << 20
_PLACE = np.uint64((1 << 30) - 1)


def _anchors(data: np.ndarray, where: np.ndarray, length: int):
    """For every context: row, first byte, size (within the text), hash of the anchor, hash of the context."""
    width = length - GRAM + 1
    n = len(data) - GRAM + 1
    total, back = polynomial(data)
    at = np.arange(n, dtype=np.uint64)
    h = mix((total[GRAM:] - total[:n]) * back[:n])
    low = (h & ~_PLACE) | at
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    first, last = where[:-1], where[1:] - length
    some = last >= first
    size = (last - first + 1)[some]
    row = np.repeat(np.flatnonzero(some), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[row]
    place = (low[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    a, z = start[head], start[tail] + length
    same = mix((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64) + (place[head] - a).astype(np.uint64) * np.uint64(977))
    return row[head], a - where[row[head]], z - a, h[place[head]], same


def _packed(anchor: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys: 40 bits of the anchor before 24 of the content, and 32 more of the content."""
    low = np.uint64((1 << 24) - 1)
    return ((anchor & ~low) | (same & low)).view(np.int64), (same >> np.uint64(32)).astype(np.uint32).view(np.int32)


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """All contexts of (doc, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, 1 << 20):
                data, where = text_bytes(batch)
                if len(data) < length:
                    continue
                row, at, size, anchor, same = _anchors(data, where, length)
                if not len(row):
                    continue
                k, c = _packed(anchor, same)
                doc = batch["doc"].to_numpy()[row]
                th = batch["th"].to_numpy()[row]
                yield first_here(k, c, doc, th, at, size)

    return rows.mapInArrow(run, ROW)


def _with_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, th, text, w: array of (anchor, b, e)) for the documents that have contexts to compare."""
    own = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "b", "e", "large")).alias("w"))
    return rows.join(own, ["doc", "th"])


def cut_out(texts: DataFrame) -> DataFrame:
    """The bytes of every context: anchor, doc, th, b, bytes, large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, th, text, w in zip(batch["doc"].to_pylist(), batch["th"].to_pylist(), batch["text"], batch["w"].to_pylist()):
                raw = (text.as_py() or "").encode()
                for x in {(x["anchor"], x["b"], x["e"], x["large"]) for x in w}:
                    for column, v in zip(out, (x[0], doc, th, x[1], raw[x[1] : x[2]], x[3])):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["anchor", "doc", "th", "b", "bytes", "large"])

    return texts.mapInArrow(run, "anchor bigint, doc bigint, th bigint, b bigint, bytes binary, large boolean")


def suffix_order(data: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of texts laid end to end, and the bytes each suffix shares with the one before it (0 for the first).

    `rest` says for each place how many bytes its own text still has; a suffix ends with its text. Ranks of 7 bytes are doubled until
    they tell whole suffixes apart; the ranks of every step then give the shared bytes, longest step first.
    """
    n = len(data)
    wide = np.zeros(n, np.uint64)
    for j in range(7):
        at = np.minimum(np.arange(n) + j, n - 1)
        wide = (wide << np.uint64(9)) | np.where(rest > j, data[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
    rank = np.unique(wide, return_inverse=True)[1].astype(np.int64)
    steps = [(7, rank.astype(np.int32))]
    span = 7
    while span < rest.max():
        after = np.where(rest[: n - span] > span, rank[span:] + 1, 0)
        pair = rank * (n + 1)
        pair[: n - span] += after
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
        steps.append((span, rank.astype(np.int32)))
    order = np.argsort(rank, kind="stable")
    one, two = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for span, ranks in reversed(steps):
        shared += span * (ranks[np.minimum(one + shared, n - 1)] == ranks[np.minimum(two + shared, n - 1)])
    differ = wide[np.minimum(one + shared, n - 1)] ^ wide[np.minimum(two + shared, n - 1)]
    for j in range(1, 7):
        shared += differ < np.uint64(1 << (63 - 9 * j))
    return order, np.concatenate(([0], np.minimum(shared, np.minimum(rest[one], rest[two]))))


def _shared_with_smaller(place: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each entry the bytes shared with the nearest entry before it that has a smaller place; 0 where these are under `least`.

    An entry whose neighbour is not smaller takes over what that neighbour points to: all between are no smaller either.
    """
    to, shared = np.arange(len(place)) - 1, shared.copy()
    going = np.flatnonzero(shared >= least)
    while len(going):
        going = going[place[to[going]] >= place[going]]
        near = to[going]
        shared[going], to[going] = np.minimum(shared[going], shared[near]), to[near]
        going = going[shared[going] >= least]
    return np.where(shared >= least, shared, 0)


def previous_factors(data: np.ndarray, rest: np.ndarray, place: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors: for each suffix the most bytes it shares with one of smaller `place`; 0 where that is under `least`.

    Of all suffixes with smaller places those nearest before and after it in suffix order share most. Equal places are one and the same.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    order, shared = suffix_order(data, rest)
    at = place[order]
    before = _shared_with_smaller(at, shared, least)
    after = _shared_with_smaller(at[::-1], np.concatenate(([0], shared[1:][::-1])), least)[::-1]
    factor = np.empty(len(data), np.int64)
    factor[order] = np.maximum(before, after)
    return factor


def _block_spans(texts: list[bytes], doc: np.ndarray, th: np.ndarray, b: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans removed by the factor array of a block of contexts, neighbouring ones joined."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    context = np.repeat(np.arange(len(texts)), size)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    start = b[context] + offset
    by_place = np.lexsort((start, doc[context]))
    new = np.zeros(len(data), np.int64)
    new[1:] = (np.diff(doc[context][by_place]) != 0) | (np.diff(start[by_place]) != 0)
    place = np.empty(len(data), np.int64)
    place[by_place] = np.cumsum(new)
    factor = previous_factors(data, size[context] - offset, place, length)
    hit = np.flatnonzero(factor)
    c, begin = context[hit], start[hit]
    end = begin + factor[hit]
    # start + factor never falls within a context, so the last start of a run has its end
    head = np.ones(len(hit), bool)
    head[1:] = (c[1:] != c[:-1]) | (begin[1:] > end[:-1])
    tail = np.append(head[1:], True)[: len(hit)]
    columns = [doc[c[head]], th[c[head]], begin[head], end[tail]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc", "th", "b", "e"])


def factor_spans(cut: DataFrame, length: int) -> DataFrame:
    """Spans (doc, th, b, e) removed by the factor arrays of contexts that share an anchor."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return _block_spans(t["bytes"].to_pylist(), *[t[x].to_numpy() for x in ("doc", "th", "b")], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch["anchor"].to_numpy()
            edges = np.flatnonzero(np.concatenate((anchor[1:] != anchor[:-1], [False]))) + 1
            at = 0
            bytes_to = np.cumsum(np.asarray(pc.binary_length(batch["bytes"])))
            for edge in edges:
                # whole anchors only; a block ends behind one
                if size + bytes_to[edge - 1] - (bytes_to[at - 1] if at else 0) > BLOCK:
                    held.append(batch.slice(at, edge - at))
                    yield solve(held)
                    held, size, at = [], 0, edge
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += int(bytes_to[-1] - (bytes_to[at - 1] if at else 0))
        if held:
            yield solve(held)

    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.select("anchor", "doc", "th", "b", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc bigint, th bigint, b bigint, e bigint")


def whole_strings(cut: DataFrame, length: int) -> DataFrame:
    """Contexts of anchors that have very many, as a row for each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    texts = part["bytes"].to_pylist()
                    data = np.frombuffer(b"".join(texts), np.uint8)
                    size = np.array([len(t) for t in texts])
                    many = size - length + 1
                    context = np.repeat(np.arange(len(texts)), many)
                    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    start = (np.cumsum(size) - size)[context] + offset
                    total, back = polynomial(data)
                    h = mix((total[start + length] - total[start]) * back[start])
                    # the whole 64 bits of one hash as the key, 32 of another beside it
                    k, c = h.view(np.int64), (mix(h ^ mix(total[start + length // 2] * back[start] - total[start] * back[start])) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    doc, th, place = part["doc"].to_numpy()[context], part["th"].to_numpy()[context], part["b"].to_numpy()[context] + offset
                    yield rows_of(k, c, doc, th, place, np.full(len(k), length), np.zeros(len(k), bool))

    return cut.select("doc", "th", "b", "bytes").mapInArrow(run, ROW)


def repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """Spans (doc_id, th, b, e), overlapping, that together are the bytes to remove."""
    th = text_key(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), th).alias("doc"), th.alias("th"), "text")
    out = saved(sort_out(contexts(rows, length)), "contexts")
    spans = out.where("kind = 1").select("doc", "th", "b", "e")
    wanted = out.where("kind = 0")
    # few anchors have very many; once they are saved Spark knows their size, and the join need not bring an anchor's contexts together
    many = wanted.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("anchor", F.lit(True).alias("large"))
    wanted = wanted.join(saved(many, "large-anchors"), "anchor", "left")
    wanted = wanted.select("anchor", "doc", "th", "b", "e", F.coalesce("large", F.lit(False)).alias("large"))
    cut = saved(cut_out(_with_bytes(rows, wanted)), "differing")
    spans = spans.union(factor_spans(cut.where("not large"), length))
    large = sort_out(whole_strings(cut.where("large"), length)).where("kind = 1")
    return spans.union(large.select("doc", "th", "b", "e"))


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """Each row with doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_bytes(docs, length)
    keyed = docs.select("text", F.col("doc_id").alias("_own"), F.coalesce(F.col("doc_id").cast("bigint"), text_key(docs)).alias("doc_id"))
    done = cut(keyed, spans.withColumnRenamed("doc", "doc_id"), ["_own"])
    return done.drop("doc_id").withColumnRenamed("_own", "doc_id")
