"""Exact encoding and decoding with a merge-type piece model that falls back to bytes.

A model of this kind joins, again and again, the two neighbouring pieces whose union ranks best. The result has a local test: a row of pieces
is the encoding exactly if every two neighbours, joined and merged anew, come apart in the same place. So a text is
encoded from the left by its longest piece; where it does not go with the one before, the next shorter one is tried, and where none
does the last piece is taken back. A bit per position notes where nothing goes on, so no place is tried twice. Longest pieces come from an
Aho-Corasick automaton: one pass of leftmost longest matches, and one more match from each place that pass did not come by.

Characters that no piece holds stand alone as their bytes. No piece holds a space mark behind another character, so texts are cut before
runs of space marks, and each distinct stretch of a task is encoded once.

Null texts are empty and encode to begin and end only. Repeated rows are encoded alike; empty tables give empty results. Models of another
kind (other algorithm, normalisation or prefix rules, no bytes) are refused.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import slices

MARK = "▁"
#: Bounds of what a worker process remembers: stretches, their length, and pairs of pieces.
STRETCHES, LONGEST, PAIRS = 150_000, 64, 150_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces with their ranks, the automaton over reversed pieces, and what has been worked out so far."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, rules = ({k: v for number, raw in parts if number == n for k, v in _fields(raw)} for n in (2, 3))
        # fixed values: model_type 3 = 2 is merging, 35 bytes, 24 space marks behind words; rules 2 a character map, 3 prefix, 4 spaces dropped, 5 marks
        plain = trainer.get(3) == 2 and trainer.get(35) and not trainer.get(24) and not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1)
        # a piece's type 4 is one that users defined: it is never merged
        if not plain or any(number == 1 and dict(_fields(raw)).get(3) == 4 for number, raw in parts):
            raise ValueError(f"{path} is not a merge-type model with bytes, a prefix and texts taken as they are")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.rank = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.code = {model.id_to_piece(i): i.to_bytes(4, "little") for i in plain}
        self.letters = set().union(*self.rank)
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError(f"{path} has pieces that go on behind a space mark")
        for c in self.letters - self.code.keys():  # only inside longer pieces: alone they are bytes
            self.code[c] = self._as_bytes(c)
        # pieces that merging cannot reach never stand in an encoding
        self.reached = {p for p in self.code if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: The longest piece that a piece goes on from, or nothing.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.reached), "") for p in self.reached}
        self.stretch = re.compile(self._stretches())
        self.pairs, self.known = _Pairs(self), _Known(self)
        # decoding: what each id stands for
        shown = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for byte, i in self.bytes.items():
            shown[i] = bytes([byte])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        self.is_space = np.array([not b and s.startswith(b" ") and not model.is_unknown(i) for i, (s, b) in enumerate(zip(shown, self.is_byte))])
        self.shown, self.size = shown, np.array([len(s) for s in shown])
        self.flat, self.first = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(self.size) - self.size

    def _stretches(self) -> str:
        """A pattern for parts of a text that no piece joins: space marks with the word behind them, words, and marks that never follow a letter inside a piece."""
        other = "".join(re.escape(c) for c in self.letters if c.isalnum() and not c.isalpha() and not c.isdecimal())
        letter = rf"[^\W\d_{other}]"
        joined = {b for p in self.rank for a, b in zip(p, p[1:]) if re.match(letter, a)}
        apart = "".join(re.escape(c) for c in map(chr, range(128)) if c.isprintable() and not c.isalnum() and c not in joined and c != " ")
        apart += "".join(c for c in "\n\t\r\v\f" if c not in joined)
        cut = rf"(?=[ {MARK}{apart}]|\Z)"
        return f"[ {MARK}]*{letter}+{cut}|[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+"

    def _as_bytes(self, text: str) -> bytes:
        return b"".join(self.bytes[b].to_bytes(4, "little") for b in text.encode())

    def merged(self, text: str) -> list[str]:
        """The model's own rule, for two pieces at most: join the best-ranked neighbours, the leftmost of equals, until none are a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _segment(self, text: str) -> list[str]:
        """The pieces of a text of known letters."""
        if text in self.reached:
            return [text]
        n = len(text)
        pairs, shorter, matches = self.pairs, self.shorter, self.automaton.iter_long
        # the longest piece at each place the leftmost longest matches lead to; other places are asked for when they are reached
        longest = {last + 1 - len(p): p for last, p in matches(text)}
        failed = bytearray(n + 1)  # 1 where no encoding of the rest goes on
        out: list[str] = []
        at, before, piece = 0, "", longest.get(0)
        while at < n:
            while piece and (failed[at + len(piece)] or before and not pairs[before, piece]):
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                before, piece = piece, longest.get(at)
                if piece is None and at < n:
                    piece = longest[at] = next(matches(text, at))[1]
            else:
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
        return out

    def packed(self, stretch: str) -> bytes:
        """A stretch's ids, four bytes each."""
        text = stretch.replace(" ", MARK)
        if self.letters.issuperset(text):
            return b"".join(map(self.code.__getitem__, self._segment(text)))
        out, at = [], 0
        for i, c in enumerate(text):
            if c not in self.letters:
                out += [self.code[p] for p in self._segment(text[at:i])]
                out.append(self._as_bytes(c))
                at = i + 1
        out += [self.code[p] for p in self._segment(text[at:])]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        body = b"".join(map(self.known.__getitem__, self.stretch.findall(" " + text))) if text else b""
        return self.begin.to_bytes(4, "little") + body + self.end.to_bytes(4, "little")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of rows of ids, row i ending at ends[i]: pieces side by side, bytes put together, the first piece without its space."""
        size, first = self.size[ids], self.first[ids].copy()
        row = np.searchsorted(ends, np.arange(len(ids)), "right")
        said = np.flatnonzero(~self.is_control[ids])
        lead = said[np.unique(row[said], return_index=True)[1]]  # each row's first piece that is not a control
        lead = lead[self.is_space[ids[lead]]]
        size[lead] -= 1
        first[lead] += 1
        upto = np.concatenate(([0], np.cumsum(size)))
        raw = self.flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cuts = [0, *upto[ends].tolist()]
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            try:
                out.append(raw[a:b].decode())
            except UnicodeDecodeError:
                begin = int(ends[i - 1]) if i else 0
                out.append(self._mended(ids[begin : int(ends[i])], raw[a:b], size[begin : int(ends[i])]))
        return out

    def _mended(self, ids: np.ndarray, raw: bytes, size: np.ndarray) -> str:
        """Runs of byte ids that are not UTF-8: each byte outside a whole character becomes U+FFFD."""
        out, at, held = [], 0, b""

        def flush() -> None:
            i = 0
            while i < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[i : i + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                i += n

        for i, n in zip(ids.tolist(), size.tolist()):
            if self.is_byte[i]:
                held += raw[at : at + n]
            else:
                flush()
                held = b""
                out.append(raw[at : at + n].decode())
            at += n
        flush()
        return "".join(out)


class _Pairs(dict):
    """Whether two pieces can be neighbours: joined and merged anew they come apart again. A full store starts anew."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = fits = self.model.merged(pair[0] + pair[1]) == [*pair]
        return fits


class _Known(dict):
    """Stretches already encoded; a long one is encoded each time, and a full store starts anew."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, stretch: str) -> bytes:
        ids = self.model.packed(stretch)
        if len(stretch) <= LONGEST:
            if len(self) >= STRETCHES:
                self.clear()
            self[stretch] = ids
        return ids


def model(path: str) -> Model:
    """The model of a file; a worker process reads it once."""
    held = sys.modules.setdefault("_marginalia_models", type(sys)("_marginalia_models"))
    if path not in held.__dict__:
        held.__dict__[path] = Model(path)
    return held.__dict__[path]


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def encoded(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """`columns` of each row, and ids: its text's ids with begin and end, as little-endian unsigned 32-bit integers side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, 2 << 20, "_text"):
            ids = [m.encode(t.as_py() or "") for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(ids, pa.binary())], [*columns, "ids"])

    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{_kinds(docs, columns)}, ids binary")


def decoded(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """`columns` of each row, and text: what its ids (as encoded() writes them; null: none) stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, 1 << 20, "_ids"):
            raw = [i.as_py() or b"" for i in batch["_ids"]]
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
            texts = m.decode_all(ids, np.cumsum([len(r) // 4 for r in raw]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(texts, pa.string())], [*columns, "text"])

    return rows.select(*columns, F.col("ids").alias("_ids")).mapInArrow(run, f"{_kinds(rows, columns)}, text string")
