"""Suffix order and longest previous factors against their definitions."""

import numpy as np
import pytest

from marginalia.llm import suffix


def laid_out(texts: list[bytes]):
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    return data, rest


def common(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute_factors(texts: list[bytes], place: np.ndarray) -> list[int]:
    ends = [t[i:] for t in texts for i in range(len(t))]
    return [max([common(s, o) for o, q in zip(ends, place) if q < p], default=0) for s, p in zip(ends, place)]


def random_texts(rng, letters: int, count: int, most: int) -> list[bytes]:
    return [bytes(rng.integers(0, letters, rng.integers(1, most), dtype=np.uint8)) for _ in range(count)]


@pytest.mark.parametrize("letters,count,most", [(1, 3, 40), (2, 6, 40), (2, 1, 200), (3, 12, 20), (256, 5, 40)])
def test_factors_by_definition(letters, count, most):
    rng = np.random.default_rng(letters * 100 + count)
    for _ in range(8):
        texts = random_texts(rng, letters, count, most)
        data, rest = laid_out(texts)
        ends = [t[i:] for t in texts for i in range(len(t))]
        order, shared = suffix.suffix_order(data, rest)
        assert [ends[i] for i in order] == sorted(ends)
        assert list(shared[1:]) == [common(ends[x], ends[y]) for x, y in zip(order, order[1:])]
        for place in (np.arange(len(data)), rng.permutation(len(data)), rng.integers(0, 9, len(data))):
            want = brute_factors(texts, place)
            assert list(suffix.previous_factors(data, rest, place)) == want
            assert list(suffix.previous_factors(data, rest, place, 5)) == [x if x >= 5 else 0 for x in want]


def test_long_repeats_and_bytes_at_both_ends():
    part = bytes(range(256))
    texts = [part + b"\x00" + part, part[:100] + b"\xff" + part, b"\x00" * 60, b"\x00" * 61]
    data, rest = laid_out(texts)
    place = np.arange(len(data))
    assert list(suffix.previous_factors(data, rest, place)) == brute_factors(texts, place)


def test_no_bytes():
    none = np.zeros(0, np.int64)
    assert len(suffix.previous_factors(np.zeros(0, np.uint8), none, none)) == 0


def test_documents_that_share_parts_in_every_way(spark):
    """Overlapping pieces of a few sources over a small alphabet: whole results against a plain search."""
    rng = np.random.default_rng(11)
    sources = ["".join("abcd"[x] for x in rng.integers(0, 4, 400)) for _ in range(4)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(3):
            at = int(rng.integers(0, 300))
            parts.append(sources[rng.integers(0, 4)][at : at + int(rng.integers(60, 260))])
        texts[i] = " ".join(parts)
    seen, want = set(), {}
    for i, text in texts.items():
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            if text[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(text[at : at + 100])
        want[i] = "".join(c for c, g in zip(text, gone) if not g).encode()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeated_bytes(df.union(df.where("doc_id % 7 = 0"))).collect()}
    assert got == want
