"""Cutting byte spans out of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import text_key


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans joined."""
    order = np.argsort(begins, kind="stable")
    b, e = begins[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(b), bool)
    new[1:] = b[1:] > e[:-1]
    last = np.append(new[1:], True)
    return b[new], e[last]


def cut(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of `docs` (doc_id, text, `columns`) with its text freed of the bytes in `spans` (doc_id, th, b, e).

    th is text_key() of the text.

    Adds kept (binary), n_bytes, n_removed, n_spans (maximal runs) and kept_sha256. A document's spans are gathered
    together, so their number is bounded by its own length. Rows that share doc_id and text are cut alike.
    """
    own = spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("b", "e")).alias("_spans")
    )
    rows = docs.select("doc_id", "text", *columns).withColumn("th", text_key(docs))
    both = rows.join(own, rows["doc_id"].eqNullSafe(own["_id"]) & (rows["th"] == own["_th"]), "left")
    both = both.select("doc_id", "text", *columns, F.col("_spans.b").alias("_b"), F.col("_spans.e").alias("_e"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *columns).schema)
    schema = f"{kinds}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, runs, digest = [], [], [], [], []
            for text, b, e in zip(batch["text"], batch["_b"], batch["_e"]):
                raw = (text.as_py() or "").encode()
                size.append(len(raw))
                gone.append(0)
                runs.append(0)
                if b.is_valid:
                    bs, es = merged(b.values.to_numpy(), e.values.to_numpy())
                    keep_from, keep_to = np.append(0, es), np.append(bs, len(raw))
                    raw = b"".join(raw[x:y] for x, y in zip(keep_from, keep_to))
                    gone[-1], runs[-1] = int((es - bs).sum()), len(bs)
                kept.append(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
            made = [pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ["doc_id", *columns]] + made,
                ["doc_id", *columns, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return both.mapInArrow(run, schema)
