"""How a set of filters works together: what each removes in every order they could be applied in.

Each document has a mask of the filters it fails. Masks are counted per part with their labels; a part's counts become a
decision diagram whose variables are the filters: a node sends documents that pass its filter one way and those that fail
it the other, leaves hold counts, equal subdiagrams are one node, and a node that nothing fails is left out. Adjacent levels
are swapped to run through all orders; the path on which everything passes gives an order's steps.

A text is found repeated by the SHA-256 of its bytes. Rows of one text are counted before and after the shuffle, so a text that fills a
third of the table is a handful of rows when its smallest id is looked for.

Null texts are empty, null languages the empty string. A null doc_id has no label, repeats nothing and is repeated by nothing. Rows that share
doc_id and text are each counted and do not repeat each other. Several labels of one document: the highest counts. An
empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import WORD_GAP

Counts = tuple[int, int, int]
#: What a step counts, after part, filter_order and step.
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_NOTHING: Counts = (0, 0, 0)


class Diagram:
    """A reordered diagram over filters: `order` lists them from the root down; leaves are (documents, good, toxic)."""

    def __init__(self, masks: dict[int, Counts], filters: int):
        self.order = list(range(filters))
        self.nodes: list[tuple] = []  # a leaf's counts, or (filter, passing child, failing child)
        self._known: dict[tuple, int] = {}
        self._sums: dict[int, Counts] = {}
        self.nothing = self._leaf(_NOTHING)
        self.root = self._build(masks, 0)

    def _place(self, node: tuple) -> int:
        if node not in self._known:
            self._known[node] = len(self.nodes)
            self.nodes.append(node)
        return self._known[node]

    def _leaf(self, counts: Counts) -> int:
        return self._place(("leaf", *counts))

    def _node(self, f: int, passing: int, failing: int) -> int:
        return passing if failing == self.nothing else self._place((f, passing, failing))

    def _build(self, masks: dict[int, Counts], level: int) -> int:
        if level == len(self.order):
            return self._leaf(next(iter(masks.values()), _NOTHING))
        f = self.order[level]
        halves = [{m: c for m, c in masks.items() if m >> f & 1 == side} for side in (0, 1)]
        return self._node(f, self._build(halves[0], level + 1), self._build(halves[1], level + 1))

    def branches(self, node: int, f: int) -> tuple[int, int]:
        """Where documents go that pass and that fail `f`; a node without it has none that fail."""
        at = self.nodes[node]
        return at[1:] if at[0] == f else (node, self.nothing)

    def total(self, node: int) -> Counts:
        if node not in self._sums:
            at = self.nodes[node]
            self._sums[node] = at[1:] if at[0] == "leaf" else tuple(map(sum, zip(self.total(at[1]), self.total(at[2]))))
        return self._sums[node]

    def swap(self, level: int) -> None:
        """Exchange the filters at `level` and the one below; nodes further down stay as they are."""
        upper, lower = self.order[level : level + 2]
        above = set(self.order[:level])
        done: dict[int, int] = {}

        def turned(node: int) -> int:
            if node not in done:
                at = self.nodes[node]
                if at[0] in above:
                    done[node] = self._node(at[0], turned(at[1]), turned(at[2]))
                elif at[0] in (upper, lower):
                    (pp, pf), (fp, ff) = (self.branches(x, lower) for x in self.branches(node, upper))
                    done[node] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
                else:
                    done[node] = node
            return done[node]

        self.root = turned(self.root)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> list[tuple[int, int, Counts]]:
        """(filter, documents left, what it removes) along the path on which everything passes."""
        out, node = [], self.root
        for f in self.order:
            node, gone = self.branches(node, f)
            out.append((f, self.total(node)[0], self.total(gone)))
        return out


def swaps(n: int) -> list[int]:
    """Levels to swap, one after the other, that lead through all orders of n: the last item sweeps through each order of the others."""
    if n < 2:
        return []
    out: list[int] = []
    for i, inner in enumerate([*swaps(n - 1), None]):
        down = i % 2 == 0
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            out.append(inner + 1 if down else inner)
    return out


def audited(masks: dict[int, Counts], names: str) -> list[tuple]:
    """(filter_order, step, *FIGURES) for every order of the filters."""
    diagram = Diagram(masks, len(names))
    orders = [(list(diagram.order), diagram.steps())]
    for level in swaps(len(names)):
        diagram.swap(level)
        orders.append((list(diagram.order), diagram.steps()))
    fails, alone, shared = {}, {}, dict.fromkeys(range(len(names)), 0)
    for order, steps in orders:
        fails[order[0]], alone[order[-1]] = steps[0][2][0], steps[-1][2][0]
        for f, _, gone in steps:
            shared[f] += gone[0]
    return [
        ("".join(names[f] for f in order), i + 1, left, n, fails[f] - n, alone[f], good, toxic, shared[f])
        for order, steps in orders
        for i, (f, left, (n, good, toxic)) in enumerate(steps)
    ]


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone: true where it fails."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask (bit i: fails the i-th of ABCDE) the documents, good and toxic ones; E: the text stands in a smaller doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failed = text_failures(F.col("_t"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("key"), bits.alias("bits"))
    marks = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    group = ["part", "key", "bits", "good", "toxic"]
    each = rows.join(marks, "doc_id", "left").select("doc_id", "part", "key", "bits", flag("good"), flag("toxic"))
    each = each.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    texts = each.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("low"),
        F.min_by("n", "doc_id").alias("at_low"),
    )
    first = F.min("low").over(Window.partitionBy("key"))  # a text's rows: one per part and label
    originals = F.col("unnamed") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    sides = F.array(
        F.struct(F.col("bits").alias("mask"), F.col("originals").alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(1 << len(failed))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    sided = texts.withColumn("originals", originals).select("part", "good", "toxic", F.explode(sides).alias("s"))
    n = F.col("s.n")
    return (
        sided.where(n > 0)
        .groupBy("part", F.col("s.mask").alias("mask"))
        .agg(F.sum(n).alias("n"), F.sum(F.col("good") * n).alias("good"), F.sum(F.col("toxic") * n).alias("toxic"))
    )


def interactions(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, order of the filters `names` and step the FIGURES, from (part, mask, n, good, toxic).

    A part has at most 2 ** len(names) masks, so gathering them is bounded by the filters.
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(FIGURES)]
        for batch in batches:
            for part, rows in zip(batch["part"].to_pylist(), batch["masks"].to_pylist()):
                made = audited({r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}, names)
                columns = [[part] * len(made), *zip(*made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "filter_order", "step", *FIGURES])

    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{f} bigint' for f in FIGURES)}")
