"""Quality rules with thresholds learnt from the corpus itself, per language and source.

Each measure of a text goes into a mergeable quantile sketch: counts in buckets whose bounds grow by a fixed ratio, so
sketches of parts add up to the sketch of the whole and every quantile is within that ratio. A group's fence lies
`reach` quartile distances above its upper quartile. Groups shrink towards their language, and languages towards the whole corpus:
`prior` documents' worth of the larger sketch is added to the smaller, so a group of a few documents takes its language's
fence and a large one its own, without a step between. Documents beyond a fence of their group go.

Of the four rules chars_per_word has no floor. The others are shares that are 0 in most documents: where both quartiles are 0 they
say nothing about the rest, and FLOORS holds.

Null texts are empty; null languages and sources are groups of their own; repeated rows are measured and kept like
others; an empty table gives an empty result. Any further columns are carried along; a column named like a measure is
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import WORD_GAP, saved

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratio of a sketch's bucket bounds, and what is added so that 0 has a bucket.
RATIO, SHIFT = 1.02, 0.001
#: A document counts this much in a sketch that others are added to: sketches stay whole numbers, alike however they are summed.
UNIT = 100
#: Lowest fence of the rules that are 0 for most documents.
FLOORS = {"symbol_share": 0.1, "dup_line_share": 0.4, "repeat_share": 0.2}


def measure(docs: DataFrame, window: int = 5) -> DataFrame:
    """The base measures of each text, with `base_failed`. Columns only; a text's repeated windows are found by sorting its own."""
    df = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_w", F.filter(F.split("_t", WORD_GAP), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    df = (
        df.withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint"))
        .withColumn("_l", lines)
        .withColumn("n_lines", F.size("_l").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
    )
    # in 64 bits: a window's hash
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_w") - window),
        lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(window)]),
    )
    df = df.withColumn("_h", F.when(F.size("_w") >= window, hashes))
    # only texts with a repeated window sort theirs
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn(
        "_s", F.when(repeated, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    same = lambda e, j: F.coalesce(F.get(F.col("_s"), j)["h"] == e["h"], F.lit(False))
    near = F.transform("_s", lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
    df = df.withColumn("_p", F.array_sort(F.array_compact(near)))
    covered = F.transform(
        "_p", lambda p, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(window)))
    )
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_t", "_w", "_l", "_h", "_s", "_p")


def rules() -> dict[str, Column]:
    """What is judged: shares of the measures."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "chars_per_word": share("word_chars", "n_words"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per language, source, rule: one small row for each bucket that occurs. Sketches add up by `n`."""
    each = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("x")) for k, v in rules().items()])
    bucket = F.ceil(F.round(F.log(F.col("r.x") + SHIFT) / F.log(F.lit(RATIO)), 6)).cast("int")
    return (
        measured.select("lang", "source", F.explode(each).alias("r"))
        .groupBy("lang", "source", F.col("r.rule").alias("rule"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def shrunk(sketch: DataFrame, by: list[str], parent: DataFrame, above: list[str], prior: int) -> DataFrame:
    """Sketches of the groups of `by`, UNIT a document, with `prior` documents' worth of the parent's (groups of `above`) added."""
    own = sketch.groupBy(*by, "rule", "bucket").agg((F.sum("n") * UNIT).alias("n"))
    total = parent.groupBy(*above, "rule").agg(F.sum("n").alias("_all"))
    up = parent.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("rule").alias("_rule"), "bucket", F.col("n").alias("_n"))
    total = total.select(*[F.col(c).alias(f"_t{c}") for c in above], F.col("rule").alias("_trule"), "_all")
    groups = own.select(*by, "rule").distinct()
    same = lambda mark: F.expr(" and ".join(f"{c} <=> {mark}{c}" for c in [*above, "rule"]))
    lent = groups.join(up, same("_")).join(total, same("_t"))
    lent = lent.select(*by, "rule", "bucket", F.expr(f"({prior * UNIT} * _n) div _all").alias("n"))
    return own.union(lent).groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The quartiles q1 and q3 of each sketch."""
    w = Window.partitionBy(*by, "rule")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.greatest(F.lit(0.0), F.pow(F.lit(RATIO), F.col("bucket")) - SHIFT)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), value))
    return ranked.groupBy(*by, "rule").agg(at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, prior: int = 100, reach: float = 6.0) -> DataFrame:
    """Per language and source the fence of each rule, as columns."""
    whole = sketch.groupBy("rule", "bucket").agg((F.sum("n") * UNIT).alias("n"))
    tongue = shrunk(sketch, ["lang"], whole, [], prior)
    own = quartiles(shrunk(sketch, ["lang", "source"], tongue, ["lang"], prior), ["lang", "source"])
    floor = sum((F.when(F.col("rule") == k, v).otherwise(0.0) for k, v in FLOORS.items()), F.lit(0.0))
    return (
        own.withColumn("fence", F.greatest(floor, F.col("q3") + reach * (F.col("q3") - F.col("q1"))))
        .groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source"))
        .agg(*[F.max(F.when(F.col("rule") == k, F.col("fence"))).alias(f"_fence_{k}") for k in rules()])
    )


def judge(docs: DataFrame, prior: int = 100, reach: float = 6.0) -> DataFrame:
    """All rows with the measures, `base_failed` and `kept`; `docs` holds text, lang, source and what else is wanted back."""
    measured = saved(measure(docs), "quality")  # measured once, used for the sketches and for the verdict
    limits = fences(saved(sketches(measured), "sketches"), prior, reach)
    beyond = F.lit(False)
    for k, v in rules().items():
        beyond = beyond | (v > F.col(f"_fence_{k}"))
    on = measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"])
    return (
        measured.join(limits, on, "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))
        .drop("_lang", "_source", *[f"_fence_{k}" for k in rules()])
    )
