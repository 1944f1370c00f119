"""Equal contents brought together over the whole corpus: which are the first, which are later copies.

A row is a place (doc, th, at, size) with its content's hash: k, of which the upper 40 bits may name a group of contents, and
c, 32 bits more. Within a piece of the table all but the first of equal contents are known to be later copies at once, so a content that stands
everywhere travels once per piece. Repeated rows of one document are no copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "k bigint, c int, doc bigint, th bigint, at bigint, size int"


def rows_of(k, c, doc, th, at, size, gone) -> pa.RecordBatch:
    """`k` null marks a span that is known to go."""
    return pa.RecordBatch.from_arrays(
        [pa.array(k, pa.int64(), mask=gone), pa.array(c, pa.int32()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int64()), pa.array(size.astype(np.int32), pa.int32())],
        ["k", "c", "doc", "th", "at", "size"],
    )


def first_here(k, c, doc, th, at, size) -> pa.RecordBatch:
    """The rows of one piece, later copies within it marked, rows of one and the same place but once."""
    order = np.lexsort((at, doc, c, k))
    k, c, doc, th, at, size = (x[order] for x in (k, c, doc, th, at, size))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = new | (doc != doc[lead]) | (at != at[lead])
    return rows_of(*[x[keep] for x in (k, c, doc, th, at, size)], ~new[keep])


def sort_out(rows: DataFrame) -> DataFrame:
    """Rows of equal key brought together in order: kind 1 is a span to remove, kind 0 a context that differs from another of its anchor.

    Sorted rows stream through, one batch at a time, so a key of any size needs no more memory than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "c", "doc", "th", "at", "size"]
        lead = None  # the first row of the content that goes on, and whether it was given out
        for batch in batches:
            known = batch.filter(pc.is_null(batch["k"]))
            if known.num_rows:
                yield _found(known["k"].fill_null(0).to_numpy(), *[known[x].to_numpy() for x in names[2:]], np.ones(known.num_rows, np.int32))
            batch = batch.filter(pc.is_valid(batch["k"]))
            if not batch.num_rows:
                continue
            x = [batch[y].to_numpy() for y in names]
            given = False
            if lead is not None:
                x = [np.concatenate((p, y)) for p, y in zip(lead[0], x)]
                given = lead[1]
            k, c, doc, th, at, size = x
            n = len(k)
            content = np.ones(n, bool)
            content[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            head = np.flatnonzero(content)
            own = head[np.cumsum(content) - 1]
            later = ~content & ((doc != doc[own]) | (at != at[own]))
            group = k[head] >> 24
            differs = np.zeros(len(head), bool)
            if len(head) > 1:
                near = group[1:] == group[:-1]
                differs[1:] |= near
                differs[:-1] |= near
            last = (differs[-1] or (given and len(head) == 1))
            if given:
                differs[0] = False
            out = np.concatenate((np.flatnonzero(later), head[differs]))
            kind = np.concatenate((np.ones(later.sum(), np.int32), np.zeros(differs.sum(), np.int32)))
            if len(out):
                yield _found(k[out], doc[out], th[out], at[out], size[out], kind)
            lead = ([y[head[-1] : head[-1] + 1] for y in x], bool(last))

    dealt = F.coalesce(F.shiftright("k", 24), F.xxhash64("doc", "at"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(n, dealt).sortWithinPartitions("k", "c", "doc", "at").mapInArrow(run, "anchor bigint, doc bigint, th bigint, b bigint, e bigint, kind int")
    )


def _found(k, doc, th, at, size, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k >> 24, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int64()), pa.array(at + size, pa.int64()), pa.array(kind, pa.int32())],
        ["anchor", "doc", "th", "b", "e", "kind"],
    )
