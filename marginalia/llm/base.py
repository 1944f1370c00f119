"""Reading tables, saving middle results, and vectorised word hashing shared by the operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from marginalia.session import shared_dir

#: A word is a run of bytes other than space, tab, newline, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
#: Letters, digits and all bytes beyond ASCII; what stands between them only separates.
ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends in files every executor can reach."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def done_with(*tables: DataFrame) -> None:
    """Delete the files of saved() tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `most` bytes of text (or of another column), so that work arrays stay small; a longer text is one piece."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a piece as one byte array, and where each begins (one more entry than rows); null is empty."""
    column = pc.fill_null(batch["text"].cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or where[-1] == where[0]:
        return np.zeros(0, np.uint8), where - where[0]
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept by the worker process, as every piece needs the same."""
    held = sys.modules.setdefault("_marginalia_powers", type(sys)("_marginalia_powers"))
    if len(getattr(held, "power", ())) < n:
        held.power, held.back = np.full(n, _BASE), np.full(n, _INVERSE)
        held.power[0] = held.back[0] = 1
        np.cumprod(held.power, out=held.power)
        np.cumprod(held.back, out=held.back)
    return held.power[:n], held.back[:n]


def polynomial(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and inverse powers: the bytes from a to b hash to mix((total[b] - total[a]) * back[a])."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    if not n:
        return total, np.zeros(0, np.uint64)
    power, back = _powers(n)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    return total, back


class Words:
    """The words of a piece: `start`, `end` (bytes within the piece), `row`, `hash`, and `first` (row -> its first word)."""

    def __init__(self, data: np.ndarray, where: np.ndarray, is_word: np.ndarray = _IS_WORD):
        self.data, self.where = data, where
        n = len(data)
        word = is_word[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cut = where[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = word[cut]
        ends[cut - 1] = word[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(where, self.start, "right") - 1
        self.first = np.searchsorted(self.start, where)
        total, back = polynomial(data)
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + size)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every run of k words inside one text: index of its first word, and its hash."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(3) + self.hash[j : j + m])
        at = np.flatnonzero(self.row[:m] == self.row[k - 1 :])
        return at, h[at]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def text_key(df: DataFrame):
    """Rows are told apart by doc_id and text: this hash of the text goes along with doc_id in joins."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.coalesce("text", F.lit("")))


#: A bitmap of keys has 2 ** KEY_BITS bits (8 MB), in cells of KEY_CELL bits (fixed by Spark's bitmap functions).
KEY_BITS, KEY_CELL = 26, 32768


def flagged(rows: DataFrame, keys: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    """The rows with `_likely`: whether a bit is set that `columns` share with some row's `own` columns in `keys`. False means not among them.

    A bitmap of fixed size is all that is broadcast, however many keys there are; a join decides about the likely rows, and the others need not be shuffled.
    """
    from pyspark.sql import functions as F

    place = lambda names: F.shiftrightunsigned(F.xxhash64(*names), 64 - KEY_BITS)
    cells = keys.select(place(own).alias("_p")).groupBy(F.floor(F.col("_p") / KEY_CELL).alias("_cell")).agg(F.bitmap_construct_agg(F.col("_p") % KEY_CELL).alias("_bits"))
    bit = place(columns) % KEY_CELL
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_cell", F.floor(place(columns) / KEY_CELL)).join(F.broadcast(cells), "_cell", "left")
    return met.withColumn("_likely", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_cell", "_bits")


def among(rows: DataFrame, keys: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    """The rows that may have their `columns` among the keys' `own` ones: all that have, and few others."""
    return flagged(rows, keys, columns, own).where("_likely").drop("_likely")
