"""Search requests: text lines to request rows, and the checks made before searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.cleaning import day_to_epoch

# The error texts callers see.
ONLY_EXCLUDING = "It is forbidden queries that are only `excluding`."
EMPTY_QUERY = "It is forbidden queries that are empty."
INVALID = "Invalid Arguments. "

NUMBER = r"^[+-]?\d+\z"


def from_lines(lines: DataFrame) -> DataFrame:
    """(request_id, line) to request rows; `page-size,from~to,filters,words`, else an error row."""
    part = F.split(F.regexp_replace("line", r"\r?\n?\z", ""), ",", -1)
    pages = F.split(F.get(part, F.lit(0)), "-", -1)
    numeric = F.forall(pages, lambda p: p.rlike(NUMBER) & p.try_cast("bigint").isNotNull())
    ok = F.size(part) == 4
    blank = F.array().cast("array<string>")

    def number(i: int) -> Column:
        return F.when(ok & numeric, F.get(pages, F.lit(i)).try_cast("bigint"))

    def words(i: int) -> Column:
        return F.when(ok, F.split(F.get(part, F.lit(i)), " ", -1)).otherwise(blank)

    return lines.select(
        "request_id",
        number(0).alias("page"),
        number(1).alias("size"),
        F.when(ok, F.transform(F.split(F.get(part, F.lit(1)), "~", -1), day_to_epoch))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("range"),
        words(2).alias("terms"),
        F.filter(words(3), lambda w: w != "").alias("q"),
        F.when(~ok | ~numeric, F.lit(INVALID)).alias("line_error"),
    )


def parse_filters(terms: Column) -> Column:
    """Known filters as (field, value), split at the first colon, value lower-cased; others are skipped."""
    known = F.filter(terms, lambda t: F.get(F.split(t, ":", 2), F.lit(0)).isin("tags", "category"))
    return F.transform(
        known,
        lambda t: F.struct(
            F.get(F.split(t, ":", 2), F.lit(0)).alias("field"),
            F.lower(F.get(F.split(t, ":", 2), F.lit(1))).alias("value"),
        ),
    )


def parse(requests: DataFrame) -> DataFrame:
    """Requests with their required and excluded words, filters, date bounds and `error`.

    A bound of 0 is open and becomes null. The order of the checks decides which error is shown.
    """
    if "line_error" not in requests.columns:
        requests = requests.withColumn("line_error", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    split = (
        requests.withColumn("q", F.filter(F.coalesce("q", none), lambda w: w != ""))
        .withColumn("must", F.transform(F.filter("q", lambda w: ~w.startswith("-")), F.lower))
        .withColumn(
            "excluded",
            F.transform(F.filter("q", lambda w: w.startswith("-")), lambda w: F.lower(w.substr(F.lit(2), F.length(w)))),
        )
        .withColumn("filters", parse_filters(F.coalesce("terms", none)))
        .withColumn("range", F.coalesce("range", F.array().cast("array<bigint>")))
    )
    bare_filter = F.exists("filters", lambda f: f["value"].isNull())
    no_words = F.size("must") == 0
    error = (
        F.when(F.col("line_error").isNotNull(), F.col("line_error"))
        .when(no_words & (F.size("excluded") > 0), F.lit(ONLY_EXCLUDING))
        .when(F.exists("excluded", lambda w: w == "") | bare_filter | (F.size("range") == 1), F.lit(INVALID))
        .when(no_words & (F.size("filters") == 0) & (F.size("range") == 0), F.lit(EMPTY_QUERY))
        .when(~(F.coalesce("page", F.lit(0)) > 0) | ~(F.coalesce("size", F.lit(0)) > 0), F.lit(INVALID))
    )

    def bound(i: int) -> Column:
        value = F.get("range", F.lit(i))
        return F.when(value != 0, value)

    return split.select(
        "request_id",
        "page",
        "size",
        "must",
        "excluded",
        "filters",
        bound(0).alias("lo"),
        bound(1).alias("hi"),
        (F.size("range") > 0).alias("ranged"),
        error.alias("error"),
    )
