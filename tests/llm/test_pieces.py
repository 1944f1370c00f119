"""Pieces against the library that defines them."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import pieces, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
EDGES = [
    "", " ", "  ", "a", " a", "a ", "  a  b ", "\n", "\n\n a\tb\r\n", "▁", "▁▁x ▁", "a▁b", "<s>", "</s><unk><0x41>", "\0", "a\0b", "é😀​", "𝔘𝔫𝔦", "日本語 日本語", "ﷺ ﬁ",
    " " * 15, " " * 16, " " * 17, " " * 33 + "the", "the" + " " * 50, "a" * 300, "ab" * 200, "=" * 77, "0123456789" * 9, "eeeeeeeeee" * 30, "�▁́", "Ünïcödé ñ",
    "supercalifragilisticexpialidocious" * 5, "\n".join(["line"] * 20), "ท" * 9, "\U0010ffff", "ab cd",
]


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def back(m, rows: list[list[int]]) -> list[str]:
    ends = np.cumsum([len(r) for r in rows])
    return m.decode_all(np.array([i for r in rows for i in r], np.int64), ends)


def same(text: str) -> None:
    want = SP.encode(text, add_bos=True, add_eos=True)
    m = pieces.model(PATH)
    assert ids(m.encode(text)) == want, repr(text)
    assert back(m, [want]) == [SP.decode(want)], repr(text)


@pytest.mark.parametrize("text", EDGES)
def test_edges(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


@settings(max_examples=600, deadline=None)
@given(st.text("abeinrst ▁.,'\n01AE=-éü", max_size=60))
def test_texts_of_frequent_letters(text):
    same(text)


def test_pieces_side_by_side():
    rng = np.random.default_rng(1)
    names = [SP.id_to_piece(i) for i in range(259, 32000)]
    for _ in range(1500):
        same("".join(names[i] for i in rng.integers(0, len(names), rng.integers(1, 9))).replace("▁", " " if rng.integers(2) else ""))


def test_ids_that_no_text_has():
    rng = np.random.default_rng(2)
    rows = [[], [1], [1, 2], [28705], [1, 28705, 28705, 264], [3, 4, 264], [131 + 100, 132 + 100, 264, 227], [0, 264], [264, 1, 264]]
    rows += [[int(x) for x in rng.choice([*range(3, 259), 264, 28705, 259, 700], rng.integers(1, 9))] for _ in range(800)]
    m = pieces.model(PATH)
    assert back(m, rows) == [SP.decode(r) for r in rows]


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "a  b\nc"), (3, "a  b\nc"), (None, "é日本"), (4, " ".join(f"Word{i % 977} and{i % 13}." for i in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("x").alias("ids"), F.lit("y").alias("_text"))
    done = pieces.decoded(pieces.encoded(docs, PATH, ["doc_id"]), PATH, ["doc_id", "ids"])
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(((r.doc_id, ids(r.ids), r.text) for r in done.collect()), key=key)
    assert got == sorted(((d, SP.encode(t or "", add_bos=True, add_eos=True), t or "") for d, t in rows), key=key)
    assert pieces.encoded(docs.limit(0), PATH, ["doc_id"]).count() == 0
    kept = pieces.encoded(docs.drop("_text"), PATH, ["doc_id", "text"])
    assert kept.columns == ["doc_id", "text", "ids"] and kept.count() == len(rows)


def test_small_stores_give_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "STRETCHES", 3)
    monkeypatch.setattr(pieces, "PAIRS", 2)
    monkeypatch.setattr(pieces, "LONGEST", 4)
    m = pieces.Model(PATH)
    text = "The quick brown fox, the quick brown foxes; unbelievably internationalization"
    assert ids(m.encode(text)) == SP.encode(text, add_bos=True, add_eos=True) == ids(m.encode(text))


def test_query(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_pieces(spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        x = SP.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(x), sha(np.array(x, "<u4").tobytes()), sha(SP.decode(x).encode()))
    assert got == want
