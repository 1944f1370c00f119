"""Texts cut into tokens inside tasks, a piece of about a megabyte at a time: Arrow batches in, Arrow batches out.

The tokens of a text tile it, so a piece's bytes and the places where tokens begin are an Arrow string array already. No row per token is
sorted or grouped by Spark: what a document has of a token is put together where its text lies. Rows come sorted by doc_id; those that
share one are one document, their tokens taken in turns: first tokens first, in the order of the rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 1 << 20
PACK_ROWS = 1 << 20  # postings packed together: some hundred megabytes of a task
ROW_BYTES, SORTED_BYTES = 104, 100 << 20  # a posting without its positions as a row of Spark's, and what is unpacked and sorted together

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _pieces(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about PIECE_BYTES of text; a longer text is one piece."""
    for batch in batches:
        size = sum(np.asarray(pc.fill_null(pc.binary_length(batch[f]), 0), dtype=np.int64) for f in fields)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _new_id(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows have another doc_id than the one before; null is an id like others."""
    ids = batch["doc_id"]
    null = np.asarray(pc.is_null(ids))
    value = np.asarray(pc.fill_null(ids, 0))
    new = np.ones(batch.num_rows, bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def _documents(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that hold all rows of every document they hold a row of."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for piece in pieces:
        last = int(np.flatnonzero(_new_id(piece))[-1])
        if held and not last and held[0]["doc_id"][0].as_py() == piece["doc_id"][0].as_py():
            held.append(piece)
            continue
        done = [*held, piece.slice(0, last)] if last else held
        if done:
            yield joined(done)
        held = [piece.slice(last)]
    if held:
        yield joined(held)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry than rows); null is empty."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or where[-1] == where[0]:
        return np.zeros(0, np.uint8), where - where[0]
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def _starts(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where tokens begin: runs of ASCII letters, and every other character."""
    begins = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[where[:-1][where[:-1] < where[1:]]] = True
    return np.flatnonzero(begins)


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 up: they are sorted together with their places, where both fit."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> (62 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


class _Tokens:
    """The tokens of one field of a piece, in order: `row`, `ord`, `size` and `at` (bytes from the document's start), `code` into `names`."""

    def __init__(self, texts: pa.Array, document: np.ndarray, lowered: dict[str, str]):
        data, where = _bytes(texts)
        start = _starts(data, where)
        ends = np.append(start[1:], len(data)) if len(start) else start
        first = np.searchsorted(start, where)
        self.count = np.diff(first)
        self.row = np.repeat(np.arange(len(texts)), self.count)
        self.ord = np.arange(len(start)) - np.repeat(first[:-1], self.count)
        self.size = ends - start
        bounds = np.append(start, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data])).dictionary_encode()
        self.code, self.names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        if (data >= 128).any():
            wide = pc.invert(pc.string_is_ascii(self.names))
            lower = pa.array([lowered.get(n, n) for n in self.names.filter(wide).to_pylist()], pa.large_string())
            again = pc.replace_with_mask(self.names, wide, lower).dictionary_encode()
            self.code, self.names = np.asarray(again.indices, dtype=np.int64)[self.code], again.dictionary
        if len(document) and document[-1] + 1 < len(document):  # some rows are one document
            turn = np.lexsort((self.row, self.ord, document[self.row]))
            self.row, self.ord, self.size, self.code = (a[turn] for a in (self.row, self.ord, self.size, self.code))
            self.document = document[self.row]
            before = np.cumsum(self.size) - self.size
            self.at = before - before[np.searchsorted(self.document, self.document)] if len(before) else before
        else:
            self.document = np.repeat(document, self.count)
            self.at = start - np.repeat(where[:-1], self.count)


def _taken(piece: pa.RecordBatch, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    return [piece[n].take(pa.array(rows)) for n in names]


def token_rows(fields: tuple[str, ...], carry: list[str], lowered: dict[str, str]) -> Callable:
    """One row per token: doc_id, what is carried, field, dl, ord, token, byte_from, byte_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _documents(_pieces(batches, fields)):
            document = np.cumsum(_new_id(piece)) - 1
            for field in fields:
                t = _Tokens(piece[field], document, lowered)
                columns = _taken(piece, ["doc_id", *carry], t.row)
                columns += [pa.repeat(field, len(t.row)), pa.array(t.count[t.row]), pa.array(t.ord, pa.int32())]
                columns += [t.names.take(pa.array(t.code)).cast(pa.string()), pa.array(t.at), pa.array(t.at + t.size)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *carry, "field", "dl", "ord", "token", "byte_from", "byte_to"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...], lowered: dict[str, str]) -> Iterator[tuple]:
    """A field and its postings, one per document and token of a piece: field, piece, dl of the piece's rows, token (as a dictionary), row, tf, positions end to end."""
    for piece in _documents(_pieces(batches, fields)):
        document = np.cumsum(_new_id(piece)) - 1
        for field in fields:
            t = _Tokens(piece[field], document, lowered)
            key = t.document * max(1, len(t.names)) + t.code
            order = _stable(key)
            key = key[order]
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
            one = order[opens]
            token = pa.DictionaryArray.from_arrays(pa.array(t.code[one], pa.int32()), t.names.cast(pa.string()))
            yield field, piece, t.count, token, t.row[one], np.diff(np.append(opens, len(key))), t.at[order]


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def grouped(fields: tuple[str, ...], carry: list[str], lowered: dict[str, str]) -> Callable:
    """One row per document, field and token: field, token, doc_id, what is carried, dl, tf, positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for field, piece, count, token, row, tf, at in _groups(batches, fields, lowered):
            columns = [pa.repeat(field, len(token)), token.cast(pa.string()), *_taken(piece, ["doc_id", *carry], row)]
            columns += [pa.array(count[row]), pa.array(tf), _lists(tf, at)]
            yield pa.RecordBatch.from_arrays(columns, ["field", "token", "doc_id", *carry, "dl", "tf", "positions"])

    return run


def _ordered(sizes: np.ndarray, values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lists that lie end to end, put in another order."""
    begins = np.cumsum(sizes) - sizes
    sizes = sizes[order]
    return values[np.repeat(begins[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _small(values: np.ndarray) -> pa.Array:
    """Whole numbers in the smallest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return pa.array(values, next(t for t, bits in ((pa.int8(), 7), (pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)) if -(1 << bits) <= low and high < 1 << bits))


def _sorted_names(names: pa.Array) -> np.ndarray:
    """Each name's place in the order of their bytes."""
    rank = np.empty(len(names), np.int64)
    rank[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
    return rank


def packed(fields: tuple[str, ...], carry: list[str], lowered: dict[str, str], buckets: int, totals: dict[str, int]) -> Callable:
    """Postings as grouped() gives them, those of a field and token bucket packed into one binary: field, bucket, piece, postings.

    A pack has its tokens in order with their numbers of postings, the texts' rows it needs once, and per posting the row, tf and the gaps between
    positions, all as differences: a fraction of what rows of their own take in a shuffle. The bucket is that of operators.match.bucket().
    `piece`: a bucket's packs are dealt over as many pieces as its share of all tokens (`totals` per field) asks for, each some SORTED_BYTES when unpacked.
    """

    def pack(field: str, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = pa.table({"token": pa.chunked_array([p[0] for p in parts])}).unify_dictionaries().combine_chunks()["token"].chunk(0)
        sources = pa.Table.from_batches([p[4] for p in parts]).combine_chunks()
        first = np.cumsum([0, *[p[4].num_rows for p in parts]])
        row = np.concatenate([p[1] + f for p, f in zip(parts, first)])
        tf, at = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        bucket_of = np.array([zlib.crc32(t.encode()) % buckets for t in tokens.dictionary.to_pylist()], np.int64)
        code = np.asarray(tokens.indices, dtype=np.int64)
        turn = np.empty(len(bucket_of), np.int64)
        turn[np.lexsort((_sorted_names(tokens.dictionary), bucket_of))] = np.arange(len(bucket_of))
        order = _stable(turn[code])  # the rows of a token ascend already
        at = _ordered(tf, at, order)
        code, row, tf = code[order], row[order], tf[order]
        begins = np.append(0, np.cumsum(tf))
        gaps = np.diff(at, prepend=0)
        gaps[begins[:-1]] = at[begins[:-1]]
        own = bucket_of[code]
        opens = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out, pieces, small = [], [], pa.ipc.IpcWriteOptions(compression="zstd")
        scale = max(1.0, totals.get(field, 0) / len(at)) / SORTED_BYTES
        for a, z in zip(opens, np.append(opens[1:], len(own))):
            heads = np.flatnonzero(np.append(True, code[a + 1 : z] != code[a : z - 1]))
            used, place = np.unique(row[a:z], return_inverse=True)
            texts = sources.take(pa.array(used)).combine_chunks()
            columns = {"names": tokens.dictionary.take(pa.array(code[a:z][heads])), "sizes": _small(np.diff(np.append(heads, z - a)))}
            columns |= {"place": _small(np.diff(place, prepend=0)), "tf": _small(tf[a:z]), "gaps": _small(gaps[begins[a] : begins[z]])}
            columns |= {c: texts[c].chunk(0) for c in texts.column_names}
            batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns.values()], list(columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=small) as to:
                to.write_batch(batch)
            out.append(sink.getvalue().to_pybytes())
            cost = ROW_BYTES * (z - a) + 8 * (begins[z] - begins[a])
            pieces.append(zlib.crc32(out[-1]) % max(1, round(cost * scale)))
        columns = [pa.repeat(field, len(out)), pa.array(own[opens], pa.int32()), pa.array(pieces, pa.int32()), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["field", "bucket", "piece", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {f: [] for f in fields}
        rows = dict.fromkeys(fields, 0)
        for field, piece, count, token, row, tf, at in _groups(batches, fields, lowered):
            if not len(token):
                continue
            source = pa.RecordBatch.from_arrays([*[piece[c] for c in ("doc_id", *carry)], pa.array(count)], ["doc_id", *carry, "dl"])
            held[field].append((token, row, tf, at, source))
            rows[field] += len(token)
            if rows[field] >= PACK_ROWS:
                yield from pack(field, held[field])
                held[field], rows[field] = [], 0
        for field in fields:
            if rows[field]:
                yield from pack(field, held[field])

    return run


def unpacked(carry: list[str]) -> Callable:
    """The postings of packed() as rows, with their field and bucket, in runs sorted by field, bucket, token and doc_id."""

    def merged(field: str, bucket: int, packs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [{c: p[c].values for c in p.schema.names} for p in packs]
        joined = lambda c: np.concatenate([np.asarray(p[c], dtype=np.int64) for p in flat])
        names = pa.concat_arrays([p["names"] for p in flat]).dictionary_encode()
        code = np.repeat(np.asarray(names.indices, dtype=np.int64), joined("sizes"))
        first = np.cumsum([0, *[len(p["dl"]) for p in flat]])
        row = np.concatenate([np.cumsum(np.asarray(p["place"], dtype=np.int64)) + f for p, f in zip(flat, first)])
        tf, gaps = joined("tf"), joined("gaps")
        begins, total = np.cumsum(tf) - tf, np.cumsum(gaps)
        at = total - np.repeat(total[begins] - gaps[begins], tf)
        source = {c: pa.concat_arrays([p[c] for p in flat]) for c in ("doc_id", *carry, "dl")}
        ids = np.asarray(pc.fill_null(source["doc_id"], np.iinfo(np.int64).min))
        different, id_ = np.unique(ids, return_inverse=True)
        order = _stable(_sorted_names(names.dictionary)[code] * len(different) + id_[row])
        at, code, row, tf = _ordered(tf, at, order), code[order], row[order], tf[order]
        begins = np.append(0, np.cumsum(tf))
        for a in range(0, len(code), 1 << 16):
            z = min(a + (1 << 16), len(code))
            taken = [source[c].take(pa.array(row[a:z])) for c in source]
            columns = [pa.repeat(field, z - a), names.dictionary.take(pa.array(code[a:z])), *taken, pa.array(tf[a:z]), _lists(tf[a:z], at[begins[a] : begins[z]])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(z - a, bucket, np.int32))], ["field", "token", *source, "tf", "positions", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            for field, bucket, postings in zip(*(batch[c].to_pylist() for c in ("field", "bucket", "postings"))):
                for part in pa.ipc.open_stream(postings):
                    held.setdefault((field, bucket), []).append(part)
                    size += ROW_BYTES * len(part["tf"].values) + 8 * len(part["gaps"].values)
                if size >= SORTED_BYTES:
                    for key in sorted(held):
                        yield from merged(*key, held[key])
                    held, size = {}, 0
        for key in sorted(held):
            yield from merged(*key, held[key])

    return run


def token_sums(fields: tuple[str, ...]) -> Callable:
    """How many rows there are and how many tokens each field has in all, a piece at a time, and the sums of the other columns: n_docs, fields, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, fields):
            sums = {"n_docs": piece.num_rows}
            sums |= {f: len(_starts(*_bytes(piece[f]))) for f in fields}
            sums |= {c: pc.sum(piece[c]).as_py() for c in piece.schema.names if c not in fields}
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums.values()], list(sums))

    return run


def _ends(texts: pa.Array, most: int) -> pa.Array:
    """Where each text's fragments end: at the last token border within `most` bytes, or after a longer letter run."""
    data, where = _bytes(texts)
    border = np.append(_starts(data, where), len(data))  # a text's end is where the next one with bytes begins
    rows, at = np.arange(len(texts)), where[:-1]
    in_row, ends = [], []
    while True:
        open_ = at < where[rows + 1]
        rows, at = rows[open_], at[open_]
        if not len(rows):
            break
        here = np.searchsorted(border, at)
        to = np.searchsorted(border, np.minimum(at + most, where[rows + 1]), "right") - 1
        at = border[np.maximum(to, here + 1)]
        in_row.append(rows)
        ends.append(at - where[rows])
    row = np.concatenate([*in_row, np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    end = np.concatenate([*ends, np.zeros(0, np.int64)])[order]
    bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(end, pa.int32()))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, lists.type), lists) if texts.null_count else lists


def with_ends(ends: dict[str, str], most: int) -> Callable:
    """The rows as they are and, for each text column, where its fragments end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, tuple(ends)):
            columns = [*piece.columns, *[_ends(piece[field], most) for field in ends]]
            yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, *ends.values()])

    return run
