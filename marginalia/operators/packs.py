"""Rows packed into compressed binaries where they lie, so that no row of its own is shuffled."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from marginalia.operators.cutting import _ordered as ordered
from marginalia.operators.cutting import _small as small

__all__ = ["chunks", "numbers", "ordered", "packed_columns", "part_of", "runs", "small", "unpacked_columns"]

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_DOCS = 8  # documents whose ids differ in the last so many bits only lie in one part: small differences

_NULL = np.iinfo(np.int64).min


def numbers(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whole numbers; a null one is the least there is."""
    return np.asarray(pc.fill_null(a.cast(pa.int64()), int(_NULL)), dtype=np.int64)


def packed_columns(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed binary."""
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_columns(pack: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(pack).read_next_batch()
    return {c: batch[c].flatten() for c in batch.schema.names}


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document: blocks of neighbouring ids, spread evenly."""
    block = (docs >> BLOCK_DOCS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((block >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int = 256 << 20) -> Iterator[pa.Table]:
    """The rows of several batches together, some `rows` or `size` bytes at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
