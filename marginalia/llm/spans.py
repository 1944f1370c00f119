"""Repeated passages: every run of consecutive sentences is hashed, runs are joined over the whole corpus, and sentences covered by a
run that occurs earlier (smaller doc_id, or earlier in the document) are removed. The first copy of each run stays.

A sentence ends at . ! ? before a gap, or at a line break, however long it is. A run is the shortest one from
a sentence on that has at least `sentences` sentences and `words` words.

Null texts are empty; texts with fewer sentences or words than a run have none. Rows that share doc_id and text are one
document, each returned cut alike; rows with a null doc_id are ordered by a hash of their text. Empty tables give empty results. Columns beside
doc_id and text are carried only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import Words, lowered, mix, slices, text_bytes, text_key
from marginalia.llm.copies import ROW, first_here, sort_out
from marginalia.llm.cut import cut

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def units(data: np.ndarray, words: Words) -> np.ndarray:
    """The index of the first word of every sentence."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    new[1:] = (words.row[1:] != words.row[:-1]) | _ENDS[data[words.end[:-1] - 1]] | (lines[words.start[1:]] > lines[words.end[:-1]])
    return np.flatnonzero(new)


def runs(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """Every run as a row of copies.ROW: its hash and its byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                data, where = text_bytes(batch)
                w = Words(lowered(data), where)
                first = units(data, w)
                m = len(first)
                if not m:
                    continue
                row, end = w.row[first], np.append(first[1:], len(w.start))
                # the last sentence of each run: far enough in sentences and in words
                by_words = np.searchsorted(end, first + words, "left")
                last = np.maximum(np.arange(m) + sentences - 1, by_words)
                ok = last < m
                ok[ok] &= row[last[ok]] == row[ok]
                a, z, r = first[ok], end[last[ok]], row[ok]
                # polynomial over word hashes, comparable between places after a shift
                power = np.full(len(w.hash), np.uint64(_STEP))
                power[0] = 1
                np.cumprod(power, out=power)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * power[::-1])))
                raw = (total[z] - total[a]) * _inverse(len(w.hash) - z)
                h = mix(raw + (z - a).astype(np.uint64))
                begin, size = w.start[a] - where[r], w.end[z - 1] - w.start[a]
                more = (mix(raw ^ h) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield first_here(h.view(np.int64), more, batch["doc"].to_numpy()[r], batch["th"].to_numpy()[r], begin, size)

    return docs.mapInArrow(run, ROW)


_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


def _inverse(n: np.ndarray) -> np.ndarray:
    """The polynomial's inverse power for each n."""
    out, step, n = np.ones(len(n), np.uint64), _BACK, n.astype(np.int64)
    for bit in range(int(n.max(initial=0)).bit_length()):
        out = np.where((n >> bit) & 1, out * np.uint64(step), out)
        step = step * step % (1 << 64)
    return out


def repeated(docs: DataFrame, sentences: int = 2, words: int = 12) -> DataFrame:
    """Byte spans (doc_id, th, b, e) of all runs that occur earlier. Runs are joined by sorting: of equal ones all but the first are given out."""
    th = text_key(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), th).alias("doc"), th.alias("th"), "text")
    return sort_out(runs(rows, sentences, words)).where("kind = 1").select(F.col("doc").alias("doc_id"), "th", "b", "e")


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, sentences: int = 2, words: int = 12) -> DataFrame:
    """Each row with doc_id, `columns`, the kept text (`kept`, UTF-8), n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = docs.withColumn("_own", F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), text_key(docs)))
    done = cut(keyed, repeated(docs, sentences, words), ["_own", *(columns or [])])
    return done.drop("doc_id").withColumnRenamed("_own", "doc_id")
