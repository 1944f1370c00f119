"""Token ids in files of canonical, length-limited Huffman codes.

Texts are encoded once, their ids counted over the whole corpus; package-merge gives the best code of at most LIMIT bits, and its lengths alone
define it. Each document's ids are coded where they lie, with the bit offset of every STEP-th id; then the coded documents are
dealt by ranges of doc_id and each range is one file in ascending order. A file has a head with the code lengths,
independent blocks of whole documents (BLOCK ids or more, each document beginning with a byte) with their checkpoints, and a foot with the
place of each block and each document's id and size. A reader decodes all checkpoints of many blocks at once, bits to id by one
table look-up.

Files are named by attempt; the saved manifest lists those of the attempts that counted. Null texts are empty and hold the
end id only; equal doc_ids stand next to each other, null ids first; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import mix, polynomial, saved, slices, text_bytes
from marginalia.session import shared_dir

LIMIT, BLOCK, STEP = 20, 1 << 16, 512
MAGIC = b"HUFFIDS1"
#: Distinct pieces whose ids a task keeps.
KEPT = 3_000_000

# a byte that surely is no white space, nor the first of a longer one
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True


class Encoder:
    """A byte-level tokenizer that encodes every distinct piece of text once.

    Such a tokenizer splits before every space that a solid character follows, and what follows a split does not change the ids before
    it, so a text's ids are those of its pieces between such spaces. Pieces are told apart by 64-bit hashes. Unknown pieces are
    encoded joined; the bytes of each id say where a piece ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every piece."""
        first = np.zeros(len(data), bool)
        first[:-1] = (data[:-1] == 32) & _SOLID[data[1:]]
        first[where[:-1][where[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        total, back = polynomial(data)
        return start, end, mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Take in new pieces, their hashes ascending and distinct."""
        # pieces that begin with a split may be joined; a text's first piece may not, unless it begins like one
        after = data[np.minimum(start + 1, len(data) - 1)]
        free = (data[start] == 32) & _SOLID[after] & (end - start > 1)
        order = np.concatenate((np.flatnonzero(free), np.flatnonzero(~free)))
        size = (end - start)[order]
        begin = start[order]
        cuts = [*range(0, int(free.sum()), 4096), *range(int(free.sum()), len(order) + 1)]
        joined = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            s, n = begin[a:z], size[a:z]
            joined.append(data[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes().decode())
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        new = np.concatenate(ids)
        ends = np.cumsum(self.bytes_of[new])
        upto = np.searchsorted(ends, np.cumsum(size), "right")
        if upto[-1] != len(new) or not np.array_equal(ends[upto - 1], np.cumsum(size)):
            raise ValueError("an id crosses a split: this is no byte-level tokenizer")
        many, first = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        many[order], first[order] = np.diff(upto, prepend=0), upto - np.diff(upto, prepend=0)
        place = np.searchsorted(self.hash, h)
        self.hash = np.insert(self.hash, place, h)
        self.at = np.insert(self.at, place, first + len(self.ids))
        self.size = np.insert(self.size, place, many)
        self.ids = np.concatenate((self.ids, new))

    def _known(self, data: np.ndarray, where: np.ndarray):
        """Pieces' starts, and per piece the place of its entry among the known ones."""
        start, end, h = self._pieces(data, where)
        distinct, one, own = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > KEPT:
            self._forget()
        place = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        new = self.hash[place] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(data, start[one[new]], end[one[new]], distinct[new])
        return start, np.searchsorted(self.hash, distinct), own

    def encode(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece of the table, and how many each row has."""
        data, where = text_bytes(batch)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(batch.num_rows, np.int64)
        start, entry, own = self._known(data, where)
        size, at = self.size[entry][own], self.at[entry][own]
        ids = self.ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(upto[np.searchsorted(start, where)])


def _encoder(path: str) -> Encoder:
    """One tokenizer per worker process, which outlives the task."""
    import os
    import sys

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
    held = sys.modules.setdefault("_marginalia_encoders", type(sys)("_marginalia_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): little-endian ids of every text with the end id behind, two bytes each where that holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, n = _encoder(path).encode(batch)
            wide = 2 if len(_encoder(path).bytes_of) <= 1 << 16 else 4
            raw = np.insert(ids, np.cumsum(n), end).astype(f"<u{wide}").tobytes()
            cut = np.concatenate(([0], np.cumsum(n + 1))) * wide
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.full(batch.num_rows, wide, np.int32)), column], ["doc_id", "wide", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, wide int, text binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a piece of encoded(), and how many each row has."""
    column = batch["text"]
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    where = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    wide = batch["wide"][0].as_py()
    return np.frombuffer(data, f"<u{wide}", (where[-1] - where[0]) // wide, where[0]), np.diff(where) // wide


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids. Tasks hand on one row per id that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches):
            total += np.bincount(_flat(batch)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("wide", "text").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of at most `limit` bits, by package-merge; 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n < 2:
        lengths[ids] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.int64)
    level, leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    taken = 2 * n - 2
    own = np.zeros(n, np.int64)
    for is_leaf in reversed(leaf):
        c = int(is_leaf[:taken].sum())
        own[:c] += 1
        taken = 2 * (taken - c)
    lengths[ids] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    code, before = 0, 0
    for i in order:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of n ids each as bits, each from a new byte: bytes, where each document begins, the bit offsets in
    its document of every STEP-th id, and how many of those each has."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    first = np.cumsum(n) - n
    begin = (end - size)[first]
    room = (np.append(begin[1:], end[-1]) - begin + 7) >> 3
    place = np.concatenate(([0], np.cumsum(room)))
    own = np.repeat(np.arange(len(n)), n)
    within = end - size - begin[own]
    at = within + 8 * place[own]
    word, stop = at >> 6, (at & 63) + size
    code = codes[ids]
    over = stop > 64
    left = np.where(over, 0, 64 - stop).astype(np.uint64)
    right = np.where(over, stop - 64, 0).astype(np.uint64)
    out = np.zeros(int(place[-1] >> 3) + 2, np.uint64)
    lead = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[lead]] = np.add.reduceat((code << left) >> right, lead)
    out[word[over] + 1] |= code[over] << (np.uint64(64) - right[over])
    index = np.arange(len(ids)) - first[own]
    mark = index % STEP == 0
    return out.astype(">u8").tobytes()[: place[-1]], place, within[mark], (n + STEP - 1) // STEP


def unpack_bits(bits: bytes, offsets: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """STEP ids from each checkpoint on: all step forward together."""
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((STEP, len(at)), np.uint32)
    top = len(window) - 1
    for j in range(STEP):
        look = (window[np.minimum(at >> 3, top)] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[j] = symbol[look]
        at += length[look]
    return out.T


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT bits the id they begin with, and its length."""
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    times = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    filled = np.repeat(order, times)
    symbol[: len(filled)], length[: len(filled)] = filled, lengths[filled]
    return symbol, length


class _Writer:
    """One file: documents are added in order."""

    def __init__(self, folder: str, lengths: np.ndarray):
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.ids"
        self.file = store.open_output_stream(f"{at}/{self.path.rsplit('/', 1)[1]}")
        head = zlib.compress(lengths.tobytes())
        self.file.write(MAGIC + struct.pack("<II", len(lengths), len(head)) + head)
        self.at, self.blocks, self.docs, self.tokens = len(MAGIC) + 8 + len(head), [], [], 0
        self.held, self.marks, self.n, self.size = [], [], 0, 0

    def add(self, doc: int | None, n: int, bits: bytes, marks: bytes) -> None:
        self.docs.append((0 if doc is None else doc, doc is not None, n))
        self.marks.append(np.frombuffer(marks, "<i8") + 8 * self.size)
        self.held.append(bits)
        self.size += len(bits)
        self.n += n
        self.tokens += n
        if self.n >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            marks, bits = np.concatenate(self.marks).astype("<u8").tobytes(), b"".join(self.held)
            self.blocks.append((self.at, len(marks), len(bits), len(self.held)))
            self.file.write(marks + bits)
            self.at += len(marks) + len(bits)
        self.held, self.marks, self.n, self.size = [], [], 0, 0

    def close(self) -> None:
        self._flush()
        foot = [zlib.compress(np.array(x, "<i8").tobytes()) for x in (self.blocks, self.docs)]
        self.file.write(foot[0] + foot[1] + struct.pack("<QQ", len(foot[0]), len(foot[1])) + MAGIC)
        self.file.close()


def write(docs: DataFrame, path: str, size: int, end: int, folder: str | None = None) -> DataFrame:
    """Encode and write; returns the manifest: part (ascending), path, n_docs, n_tokens, start (ids in earlier files)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "ids")
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    ids = saved(encoded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path, end), "encoded")
    lengths = code_lengths(count_ids(ids, size))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in slices(batches, 2 << 20):
            flat, n = _flat(batch)
            bits, place, marks, many = pack_bits(flat, n, codes, lengths)
            upto = np.concatenate(([0], np.cumsum(many)))
            part = np.searchsorted(bounds, batch["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(), "left")
            raw = [bits[a:z] for a, z in zip(place[:-1], place[1:])]
            marks = [marks[a:z].astype("<i8").tobytes() for a, z in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch["doc_id"], pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(marks, pa.binary())], ["part", "doc_id", "n", "bits", "marks"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, own, made = None, None, []

        def close() -> None:
            if writer is not None:
                writer.close()
                made.append((own, writer.path, len(writer.docs), writer.tokens))

        for batch in batches:
            for part, doc, n, bits, marks in zip(*[batch[c].to_pylist() for c in ("part", "doc_id", "n", "bits", "marks")]):
                if part != own:
                    close()
                    writer, own = _Writer(uri, lengths), part
                writer.add(doc, n, bits, marks)
        close()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*made)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "path", "n_docs", "n_tokens"])

    coded = ids.mapInArrow(code, "part bigint, doc_id bigint, n bigint, bits binary, marks binary")
    ordered = coded.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    manifest = saved(ordered.mapInArrow(put, "part bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_file(uri: str, at_once: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents' rows, their ids) for every `at_once` blocks: rows are doc_id, whether it is known, size."""
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as f:
        total = f.size()
        a, b, _ = struct.unpack("<QQ8s", f.read_at(24, total - 24))
        blocks = np.frombuffer(zlib.decompress(f.read_at(a, total - 24 - a - b)), "<i8").reshape(-1, 4)
        docs = np.frombuffer(zlib.decompress(f.read_at(b, total - 24 - b)), "<i8").reshape(-1, 3)
        _, head = struct.unpack("<II", f.read_at(8, len(MAGIC)))
        symbol, length = decode_table(np.frombuffer(zlib.decompress(f.read_at(head, len(MAGIC) + 8)), np.uint8))
        done = 0
        for i in range(0, len(blocks), at_once):
            bits, marks, size = [], [], 0
            group = blocks[i : i + at_once]
            for place, m, n, _ in group.tolist():
                raw = f.read_at(m + n, place)
                marks.append(np.frombuffer(raw[:m], "<u8").astype(np.int64) + 8 * size)
                bits.append(raw[m:])
                size += n
            rows = docs[done : done + int(group[:, 3].sum())]
            done += len(rows)
            steps = unpack_bits(b"".join(bits), np.concatenate(marks), symbol, length)
            # a document's last checkpoint may stand for fewer ids
            many = (rows[:, 2] + STEP - 1) // STEP
            left = np.full(len(steps), STEP)
            left[np.cumsum(many)[many > 0] - 1] = (rows[:, 2] - (many - 1) * STEP)[many > 0]
            yield rows, steps[np.arange(STEP) < left[:, None]]


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (all as stored), in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                for docs, ids in read_file(uri):
                    n = docs[:, 2]
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cut = 4 * np.concatenate(([0], np.cumsum(n)))
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 0), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(files).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
