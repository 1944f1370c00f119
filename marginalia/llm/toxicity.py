"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms, lower case, letters that look like Latin ones, digits and signs that stand for
letters inside words; what is no letter separates words. An Aho-Corasick automaton finds all lexicon terms (words and beginnings of words) in one pass; a
word counts once, with its longest term, unless an exception phrase covers it. The weights' sum over the number of words is the text's density, and a
logistic curve turns it into a score.

The lexicon, its weights, the exception phrases (unless given) and the curve are learnt from labelled texts: a bounded sample of FIT_ROWS rows, those with
the smallest hashes of their ids. Every text is scored whole. Null and empty texts have density 0. Rows without a label
are not learnt from; repeated rows are scored alike; with no toxic or no clean label, all scores are those of an empty lexicon.
Only the text is an input of a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import saved

#: Labelled rows the lexicon is learnt from, and the most terms it may hold.
FIT_ROWS, TERMS = 20_000, 2_000
#: Bounds of a term's weight (log odds): lighter terms are left out, heavier ones cut, so that no single word decides.
LIGHTEST, HEAVIEST = 2.0, 3.0
# fixed values: letters that look like Latin letters, and signs that stand for letters
HOMOGLYPHS = dict(zip("аеорсухіјѕԁѵһӏкмнтвгαεορτυνικηχ", "aeopcyxijsdvhlkmhtbraeoptuvikhx"))
LEET = dict(zip("0134578@$", "oieastbas"))
_FOLD = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(LEET)


def fold(text: str | None) -> list[str]:
    """The folded words of a text. Signs become letters only inside a word that has letters on both ends of them or begins with them."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    out = []
    for word in text.split():
        if word.isalpha():
            out.append(word)
            continue
        core = word.rstrip("$@")  # signs at the end of a word are signs
        if any(c in LEET for c in core) and any(c.isalpha() for c in core):
            core = core.translate(_SIGNS)
        out.extend("".join(c if c.isalpha() else " " for c in core).split())
    return out


def _terms(word: str) -> list[str]:
    """A word as it stands, and its beginnings of four letters and more."""
    return [word + " ", *[word[:n] for n in range(4, min(9, len(word)))]]


def _all_terms(words: list[str]) -> set[str]:
    return {t for w in set(words) for t in _terms(w)}


def counted(labelled: DataFrame, terms_of: Callable[[list[str]], set[str]] = _all_terms) -> DataFrame:
    """Per term the toxic (a) and the clean (b) texts it stands in, over (text, toxic). Parts are counted in the tasks and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                both[toxic].update(terms_of(fold(text)))
            terms = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([both[1][t] for t in terms], pa.int64()), pa.array([both[0][t] for t in terms], pa.int64())], ["term", "a", "b"]
            )

    parts = labelled.mapInArrow(run, "term string, a bigint, b bigint")
    return parts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


class Lexicon:
    """Terms with weights, exception phrases, and the curve from density to score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float] = (-4.0, 4.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def _build(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (weight, len(term) + 1))
        for phrase in self.exceptions:
            found.add_word(" " + " ".join(fold(phrase)) + " ", (None, len(" ".join(fold(phrase))) + 2))
        found.make_automaton()
        return found

    def density(self, text: str | None) -> float:
        words = fold(text)
        if not words or not (self.weights or self.exceptions):
            return 0.0
        if self.automaton is None:
            self.automaton = self._build()
        flat = " " + " ".join(words) + " "
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (weight, size) in self.automaton.iter(flat):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        total, free = 0.0, 0  # phrases before `free` end before the place looked at
        spared.sort()
        for at, (_, weight) in sorted(best.items()):
            while free < len(spared) and spared[free][1] <= at:
                free += 1
            if free == len(spared) or spared[free][0] > at:
                total += weight
        return max(0.0, 100 * total / len(words))

    def phrases(self, words: list[str]) -> set[str]:
        """The two-word phrases of a text that hold a word with a weight."""
        heavy = [any(t in self.weights for t in _terms(w)) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], heavy, heavy[1:]) if x or y}

    def score(self, density: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(density)))))


def learn(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None, fit_rows: int = FIT_ROWS, terms: int = TERMS) -> Lexicon:
    """A lexicon from documents (doc_id, text) and labels (doc_id, toxic 0/1); exception phrases are learnt unless given."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # at most fit_rows short rows: small enough to be sent to where the texts are
    chosen_rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(chosen_rows), "doc_id").select("text", "toxic"), "labelled")
    all_rows = {r.toxic: r[1] for r in sample.groupBy("toxic").agg(F.count("*")).collect()}
    na, nb = all_rows.get(1, 0), all_rows.get(0, 0)
    if not na or not nb:
        return Lexicon({}, exceptions or [])
    p = (F.col("a") + F.col("b")) / (na + nb)
    z = (F.col("a") / na - F.col("b") / nb) / F.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    counts = counted(sample)
    best = counts.where((F.col("term") != "") & (F.col("a") >= 5) & (p < 1) & (z >= 6)).orderBy(z.desc(), F.length("term"), "term").limit(terms).collect()
    weight = lambda r: min(HEAVIEST, math.log((r["a"] + 0.5) / (na + 1)) - math.log((r["b"] + 0.5) / (nb + 1)))
    chosen: dict[str, float] = {}
    # of terms that stand in as many texts, the longest; then beginnings go before what begins with them
    longest = {(r["term"][:4], r["a"], r["b"]): r for r in sorted(best, key=lambda r: len(r["term"]))}
    for r in sorted(longest.values(), key=lambda r: (len(r["term"]), r["term"])):
        if weight(r) >= LIGHTEST and not any(r["term"][:n] in chosen for n in range(4, len(r["term"]))):
            chosen[r["term"]] = weight(r)
    lexicon = Lexicon(chosen, exceptions or [])
    if exceptions is None and chosen:
        lexicon.exceptions = _innocent(sample, lexicon, na, nb, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t) for t in batch["text"].to_pylist()], pa.float64()), batch["toxic"]], ["x", "toxic"])

    points = sample.mapInArrow(run, "x double, toxic int")
    cells = points.groupBy(F.round(F.log1p("x"), 2).alias("x"), "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").collect()
    lexicon.curve = _fit(np.array([[r["x"], r["toxic"], r["n"]] for r in cells], float))
    return lexicon


def _innocent(sample: DataFrame, lexicon: Lexicon, na: int, nb: int, most: int) -> list[str]:
    """Phrases around lexicon words that are no likelier in toxic texts than in clean ones, told by five clean texts at least."""
    found = counted(sample, lexicon.phrases).where((F.col("b") >= 5) & (F.col("a") * nb <= F.col("b") * na))
    return [r["term"] for r in found.orderBy(F.desc("b"), "term").limit(most).collect()]


def _fit(cells: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the log density, by Newton steps with a slight pull to 0."""
    x, y, n = cells.T
    theta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ theta))
        slope = design.T @ (n * (y - q)) - 1e-2 * theta
        bend = (design * (n * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + np.clip(step, -2, 2)
    return float(theta[0]), float(theta[1])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row doc_id, score, density."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.density(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([lexicon.score(v) for v in x], pa.float64()), pa.array(x, pa.float64())], ["doc_id", "score", "density"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, density double")
