"""A table of search requests answered against the index in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import date_text
from marginalia.operators.batch import packed_best
from marginalia.operators.index import Index
from marginalia.operators.joins import Stage, slot, spread_join, top_in_slots
from marginalia.operators.match import field_matches, lookups, narrowed, word_matches
from marginalia.operators.respond import HIT_COLUMNS, error_json, response_json
from marginalia.operators.snippet import snippets
from marginalia.sources.requests import parse
from marginalia.sources.store import SLICE_DOCS

DAY = 86400
DEEP = 1000  # pages that end further down than this are found through counts per cell
BROADCAST_CLAUSES = 100_000  # rows of a word and a few numbers: some megabytes
BROADCAST_BYTES = 64 << 20  # and the words and tokens in them
BROADCAST_IDS = 2_000_000  # two longs each: some tens of megabytes at most


@dataclass(frozen=True)
class Answers:
    parsed: DataFrame  # requests with their `error`
    pages: DataFrame  # request_id, rank, doc_id, score, total
    totals: DataFrame  # request_id, total
    hits: DataFrame  # request_id, rank, doc_id and what a hit shows
    responses: DataFrame  # request_id, response


def clauses(parsed: DataFrame) -> DataFrame:
    """One row per required word, excluded word and filter of each valid request."""

    def role(name: str, words: Column) -> Column:
        return F.transform(
            words, lambda w: F.struct(F.lit(name).alias("role"), F.lit("text").alias("kind"), w.alias("word"))
        )

    exact = F.transform(
        "filters", lambda f: F.struct(F.lit("filter").alias("role"), f["field"].alias("kind"), f["value"].alias("word"))
    )
    every = F.concat(role("must", F.col("must")), role("excluded", F.col("excluded")), exact)
    return (
        parsed.where("error is null")
        .select(
            "request_id",
            F.size("must").alias("w_must"),
            F.size("excluded").alias("w_excluded"),
            F.size("filters").alias("w_filter"),
            "lo",
            "hi",
            "ranged",
            "page",
            "size",
            F.explode(every).alias("c"),
        )
        .select("*", "c.role", "c.kind", "c.word")
        .drop("c")
    )


def day_of(at: Column) -> Column:
    return F.floor(at / DAY)


def _within(date: Column, lo: Column, hi: Column) -> Column:
    return _within_seconds(F.unix_timestamp(date), lo, hi)


def _within_seconds(at: Column, lo: Column, hi: Column) -> Column:
    """Inclusive on both ends; a null bound is open."""
    return F.coalesce(at >= lo, F.lit(True)) & F.coalesce(at <= hi, F.lit(True))


def in_range(date: str, lo: int, hi: int) -> Column:
    """Inclusive epoch-second bounds on a timestamp column, 0 = open; the scan can skip row groups by it."""
    at = F.col(date)
    above = at >= F.timestamp_seconds(F.lit(lo)) if lo else F.lit(True)
    below = at <= F.timestamp_seconds(F.lit(hi)) if hi else F.lit(True)
    return above & below


def matches(
    index: Index, wanted: DataFrame, parts: DataFrame, exclude: str = "all", fits: bool = False, phrases: bool = True, split: bool = False
) -> DataFrame:
    """request_id, slot, doc_id, key, cell, score, page, size: all documents that satisfy a request.

    Documents satisfy every required word and filter, lie in the date range and, with
    exclude="all", do not hold all excluded words ("any": do not hold any of them).
    The rows are spread by request and slot, which the final ranking reuses. `fits`: lookups
    and clauses were counted and are few enough to broadcast; `phrases`: some word has several tokens; `split`: the lookups
    are stored, and frequent words are split by their counts.
    """
    if exclude not in ("all", "any"):
        raise ValueError("exclude is 'all' or 'any'")
    most = wanted.groupBy("kind", "word").agg(F.sum("min_df").alias("rows")) if split else None  # a word matches no more documents than its rarest tokens
    found = spread_join(parts, word_matches(index, wanted, fits, phrases, split), ["kind", "word"], "doc_id", fits, most)
    part = F.when(F.col("role") == "excluded", 0.0).otherwise(F.col("score"))
    n = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    request = ("w_must", "w_excluded", "w_filter", "ranged", "page", "size")
    per_doc = (
        found.where(_within(F.col("date"), F.col("lo"), F.col("hi")))
        .withColumn("slot", slot(F.col("doc_id"), found))
        .repartition("request_id", "slot")
        .groupBy("request_id", "slot", "doc_id")
        .agg(
            n("must"),
            n("excluded"),
            n("filter"),
            F.sum(part).alias("score"),
            F.first("date").alias("date"),
            *[F.first(c).alias(c) for c in request],
        )
    )
    limit = F.when(F.col("w_excluded") > 0, F.col("w_excluded") if exclude == "all" else F.lit(1))
    by_score = F.col("w_must") > 0
    score = F.round(F.col("score") + F.when(F.col("ranged"), 1.0).otherwise(0.0), 4)
    return per_doc.where(
        (F.col("n_must") == F.col("w_must"))
        & (F.col("n_filter") == F.col("w_filter"))
        & F.coalesce(F.col("n_excluded") < limit, F.lit(True))
    ).select(
        "request_id",
        "slot",
        "doc_id",
        F.when(by_score, score).otherwise(F.unix_timestamp("date").cast("double")).alias("key"),
        F.when(by_score, F.floor(score * 100)).otherwise(day_of(F.unix_timestamp("date"))).alias("cell"),
        F.when(by_score, score).alias("score"),
        "page",
        "size",
    )


def _skip() -> Column:
    return (F.col("page") - 1) * F.col("size")


def shallow_pages(found: DataFrame) -> DataFrame:
    """Pages near the start: each slot hands on its best rows down to the page's end.

    A request whose page is past the end keeps one row without a document, for its total.
    """
    order = [F.desc("key"), F.col("doc_id")]
    return _shown(top_in_slots(found, order, F.col("page") * F.col("size")))


def _shown(ranked: DataFrame) -> DataFrame:
    """The ranked rows that lie on a page, and the first one for the total."""
    on_page = (F.col("rank") > _skip()) & (F.col("rank") <= _skip() + F.col("size"))
    shown = [F.when(on_page, F.col(c)).alias(c) for c in ("rank", "doc_id", "score")]
    return ranked.where(on_page | (F.col("rank") == 1)).select("request_id", *shown, "total")


def batch_pages(parts: DataFrame, matched: DataFrame, exclude: str, rows: int, requests: int) -> DataFrame:
    """Pages near the start of counted requests: matches are put together and ranked where the documents lie (operators/batch.py)."""
    ids = parts.select("request_id", F.xxhash64("request_id").alias("r"), "page", "size", "w_must").distinct()
    best = packed_best(parts, matched, exclude, rows).groupBy("r").agg(F.flatten(F.collect_list("best")).alias("best"), F.sum("n").alias("total")).join(ids, "r")
    # lower keys and missing ones come later, and of equal ones the higher doc_id
    ordered = F.array_sort(F.transform("best", lambda b: F.struct(b["key"].isNull().alias("none"), (-b["key"]).alias("key"), b["doc_id"].isNotNull().alias("named"), b["doc_id"].alias("doc_id"))))
    end = F.least(_skip() + F.col("size"), F.size("best").cast("bigint")).cast("int")
    skip = F.least(_skip(), F.size("best").cast("bigint")).cast("int")
    row = lambda rank, doc_id, score: F.struct(rank.cast("bigint").alias("rank"), doc_id.cast("bigint").alias("doc_id"), score.cast("double").alias("score"))
    null = F.lit(None)
    shown = F.transform(F.slice(ordered, skip + 1, end - skip), lambda b, i: row(skip + i + 1, b["doc_id"], F.when(F.col("w_must") > 0, -b["key"])))
    first = F.when(_skip() > 0, F.array(row(null, null, null))).otherwise(F.array().cast("array<struct<rank: bigint, doc_id: bigint, score: double>>"))
    return best.select("request_id", F.explode(F.concat(first, shown)).alias("b"), "total").select("request_id", "b.rank", "b.doc_id", "b.score", "total")


def reached(cells: DataFrame) -> DataFrame:
    """The cells a page lies in: with `before`, the request's rows in front of the first of them.

    `cells` counts each request's matches (`n`) per cell of the sort key, higher cells first, or has `ahead`, the rows before each, already.
    """
    if "ahead" not in cells.columns:
        higher = Window.partitionBy("request_id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    on_page = cells.where((F.col("ahead") < _skip() + F.col("size")) & (F.col("ahead") + F.col("n") > _skip()))
    return on_page.withColumn("before", F.min("ahead").over(Window.partitionBy("request_id"))).drop("ahead")


#: How a cell is told apart further, in the order of pages: by the sort key itself, then also by ranges of doc_id, which decides between equal keys.
_LEVELS = ["struct(-key)", "struct(-key, shiftright(doc_id, 20))", "struct(-key, shiftright(doc_id, 10))"]


def closer(near: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """The rows around pages that end far down in their cells: counts per finer and finer cell, and only the cells a page lies in go on.

    `near` has request_id, page, size, before, key and doc_id. What is left of a request are its page and up to a thousand rows on either side, so
    ranking them is bounded by the page, however many rows share a cell or a key.
    """
    for cell in _LEVELS:
        near = near.withColumn("cell", F.expr(cell))
        counts = near.groupBy("request_id", "page", "size", "before", "cell").agg(F.count("*").alias("n"))
        front = Window.partitionBy("request_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n").over(front), F.lit(0))).drop("before")
        cells = keep(reached(counts).select("request_id", "cell", "before", "n"), "closer")
        # counted: a page's cells, at most one per row of the page and the two at its ends
        near = spread_join(cells.drop("n"), near.drop("before"), ["request_id", "cell"], "doc_id", sizes=cells.select("request_id", "cell", F.col("n").alias("rows")))
    return near


def cell_pages(on_page: DataFrame, rows: DataFrame, keys: list[str], sizes: DataFrame | None, any_deep: bool = True, keep=lambda df, name: df) -> DataFrame:
    """Pages at any depth: only the rows that share a cell with the page are ranked. request_id, rank, doc_id, score.

    `on_page` are the cells of reached(); `rows` (with key, doc_id) are joined to them by `keys`, of which `sizes` says how many rows each has.
    Where a page ends more than DEEP rows down in its cells, finer cells come first.
    """
    near = spread_join(on_page, rows, keys, "doc_id", sizes=sizes).where(_within_seconds(F.col("at"), F.col("lo"), F.col("hi")) if "lo" in on_page.columns else F.lit(True))
    depth = _skip() + F.col("size") - F.col("before")
    columns = ["request_id", "page", "size", "before", "key", "doc_id", *[c for c in ("score",) if c in rows.columns]]
    near = near.select(*columns)
    if any_deep:
        down = keep(near.where(depth > DEEP), "deep")
        near = near.where(depth <= DEEP).unionByName(closer(down, keep).select(*columns))
    spread = near.withColumn("slot", slot(F.col("doc_id"), rows)).repartition("request_id", "slot")
    ranked = top_in_slots(spread, [F.desc("key"), F.col("doc_id")], depth).withColumn("rank", F.col("rank") + F.col("before"))
    shown = ranked.where((F.col("rank") > _skip()) & (F.col("rank") <= _skip() + F.col("size")))
    score = F.col("score") if "score" in rows.columns else F.lit(None).cast("double")
    return shown.select("request_id", "rank", "doc_id", score.alias("score"))


def with_totals(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """A request's rows, and one more without a document that has its `total`."""
    blank = {"rank": "bigint", "doc_id": "bigint", "score": "double"}
    return pages.withColumn("total", F.lit(None).cast("bigint")).unionByName(
        totals.select("request_id", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], F.col("total").cast("bigint").alias("total"))
    )


def deep_pages(found: DataFrame, finer: bool, keep=lambda df, name: df) -> DataFrame:
    """Pages far from the start. The matches are used twice; Spark reuses their exchange. `finer`: cells are told apart further where a page ends far down in one."""
    cells = found.groupBy("request_id", "page", "size", "cell").agg(F.count("*").alias("n"))
    on_page = reached(cells)
    keys = ["request_id", "cell"]
    rows = found.drop("page", "size", "slot")
    sizes = None
    if finer:
        on_page = keep(on_page, "cells")
        sizes = on_page.select(*keys, F.col("n").alias("rows"))
    pages = cell_pages(on_page.drop("n"), rows, keys, sizes, finer, keep)
    return with_totals(pages, cells.groupBy("request_id").agg(F.sum("n").alias("total")))


def word_pages(found: DataFrame, any_deep: bool = False, finer: bool = False, keep=lambda df, name: df) -> DataFrame:
    """Pages of the requests that have words or filters."""
    if not any_deep:
        return shallow_pages(found)
    deep = F.col("page") * F.col("size") > DEEP
    return shallow_pages(found.where(~deep)).unionByName(deep_pages(found.where(deep), finer, keep))


#: Halvings of a sorted array: four million days, more than the calendar has.
_HALVINGS = 22


def count_below(values: Column, x: Column) -> Column:
    """How many of the sorted `values` are at most x, by halving."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["a"] + s["b"], 1)
        low = F.get(values, middle) <= x
        open_ = s["a"] < s["b"]
        return F.struct(F.when(open_ & low, middle + 1).otherwise(s["a"]).alias("a"), F.when(open_ & ~low, middle).otherwise(s["b"]).alias("b"))

    start = F.struct(F.lit(0).alias("a"), F.size(values).alias("b"))
    return F.aggregate(F.array_repeat(F.lit(0), _HALVINGS), start, halved)["a"]


def _upto(totals: Column, i: Column) -> Column:
    """Posts on the first i days."""
    return F.when(i > 0, F.get(totals, i - 1)).otherwise(F.lit(0))


def browse_pages(parsed: DataFrame, index: Index, any_deep: bool = False, split: bool = False, keep=lambda df, name: df) -> DataFrame:
    """Pages of the requests that name a date range only, newest first.

    The cells are days. Posts per day are counted at load time; the days that have posts, in order, and their running totals are two
    arrays that every request searches by halving: for the ends of its range, and for the days its page begins and ends in. So a request has one row,
    and then one per day of its page, however long the calendar is. Only days that a range cuts through are counted from their posts.
    """
    dated = index.posts.select("doc_id", F.unix_timestamp("date").alias("at"))
    dated = dated.withColumn("cell", day_of(F.col("at")))
    # one row per day of the calendar that has posts
    days = index.days.groupBy("day").agg(F.sum("n").alias("n"))
    days = keep(days.withColumn("upto", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))), "days")
    ordered = F.array_sort(F.collect_list(F.struct("day", "upto")))
    both = days.select(F.struct(ordered["day"].alias("day"), ordered["upto"].alias("upto"))).scalar()
    wanted = parsed.where("error is null").where((F.size("must") == 0) & (F.size("filters") == 0)).select("request_id", "page", "size", "lo", "hi")
    day, upto = F.col("d.day"), F.col("d.upto")
    first = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(count_below(day, day_of(F.col("lo")) - 1))
    last = F.when(F.col("hi").isNull(), F.size(day)).otherwise(count_below(day, day_of(F.col("hi"))))
    # days first .. last - 1 hold the range; those it cuts through are counted apart
    # the arrays are dropped before rows are shuffled
    spans = wanted.withColumn("d", both).withColumns({"first": first, "last": last}).where("first < last")
    spans = spans.withColumns({"oldest": F.get(day, F.col("first")), "newest": F.get(day, F.col("last") - 1)}).drop("d")
    newest, oldest = F.col("newest"), F.col("oldest")
    cut_lo, cut_hi = F.coalesce(F.col("lo") > oldest * DAY, F.lit(False)), F.coalesce(F.col("hi") < newest * DAY + DAY - 1, F.lit(False))
    cut = keep(spans.withColumns({"cut_lo": cut_lo, "cut_hi": cut_hi}), "spans")
    edge_days = F.array_distinct(F.array_compact(F.array(F.when(F.col("cut_lo"), oldest), F.when(F.col("cut_hi"), newest))))
    edge_rows = cut.select("request_id", "lo", "hi", F.explode(edge_days).alias("cell"))
    per_day = days.select(F.col("day").alias("cell"), F.col("n").alias("rows")) if split else None
    counted = (
        spread_join(edge_rows, dated, ["cell"], "doc_id", sizes=per_day)
        .where(_within_seconds(F.col("at"), F.col("lo"), F.col("hi")))
        .groupBy("request_id", "cell")
        .agg(F.count("*").alias("n"))
        .groupBy("request_id")
        .agg(F.min_by("n", "cell").alias("n_first"), F.max_by("n", "cell").alias("n_last"), F.min("cell").alias("c_first"), F.max("cell").alias("c_last"))
    )
    one = F.col("cut_lo") & F.col("cut_hi") & (F.col("first") == F.col("last") - 1)
    zero = F.lit(0).cast("bigint")
    at_hi = F.when(F.col("cut_hi") & (F.col("c_last") == newest), F.col("n_last")).otherwise(zero)
    at_lo = F.when(F.col("cut_lo") & ~one & (F.col("c_first") == oldest), F.col("n_first")).otherwise(zero)
    a = F.col("first") + F.col("cut_lo").cast("int")
    b = F.col("last") - F.col("cut_hi").cast("int")
    located = cut.join(counted, "request_id", "left").withColumn("d", both).withColumns({"e_hi": F.coalesce(at_hi, zero), "e_lo": F.coalesce(at_lo, zero), "a": a, "b": F.greatest(a, b)})
    located = located.withColumns({"top": _upto(upto, F.col("b")), "full": _upto(upto, F.col("b")) - _upto(upto, F.col("a"))})
    end = F.col("e_hi") + F.col("top")  # the newest whole day's last post has this number, counted from the end of the range
    from_day = F.greatest(F.col("a"), count_below(upto, end - _skip() - F.col("size")))
    to_day = F.least(F.col("b") - 1, count_below(upto, end - _skip() - 1))
    located = located.withColumns({"from_day": from_day, "to_day": to_day})

    def cell(day_: Column, ahead: Column, n: Column) -> Column:
        return F.struct(day_.cast("bigint").alias("cell"), ahead.cast("bigint").alias("ahead"), n.cast("bigint").alias("n"))

    whole = F.when(
        F.col("from_day") <= F.col("to_day"),
        F.transform(F.sequence("from_day", "to_day"), lambda i: cell(F.get(day, i), end - F.get(upto, i), F.get(upto, i) - _upto(upto, i))),
    ).otherwise(F.array().cast("array<struct<cell: bigint, ahead: bigint, n: bigint>>"))
    edges = F.array(cell(newest, zero, F.col("e_hi")), cell(oldest, F.col("e_hi") + F.col("full"), F.col("e_lo")))
    listed = located.select("request_id", "page", "size", "lo", "hi", F.explode(F.concat(edges, whole)).alias("c")).select("*", "c.*").drop("c")
    on_page = reached(listed.where("n > 0"))
    pages = cell_pages(on_page.drop("n"), dated.withColumn("key", F.col("at").cast("double")), ["cell"], per_day, any_deep, keep)
    return with_totals(pages, located.select("request_id", (F.col("e_hi") + F.col("full") + F.col("e_lo")).alias("total")).where("total > 0"))


def weights(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """request_id, title_weights, content_weights: the tokens to highlight, rare ones weigh more.

    Tokens of required and excluded words alike; requests without words have none.
    """
    tokens = (
        parts.where("kind = 'text'")
        .select("request_id", "kind", "word")
        .distinct()
        .join(wanted.where("kind = 'text'").select("kind", "word", "field", "terms"), ["kind", "word"])
        .select("request_id", "field", F.explode("terms").alias("t"))
        .where("t.df > 0")
        .select("request_id", "field", F.struct("t.token", (1.0 / (1 + F.col("t.df"))).alias("w")).alias("e"))
        .distinct()
    )
    per_field = [
        F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.col("e")))).alias(f"{f}_weights")
        for f in ("title", "content")
    ]
    return tokens.groupBy("request_id").agg(*per_field)


def fetch(pages: DataFrame, posts: DataFrame, ids_fit: bool = False) -> DataFrame:
    """The pages' documents, beside every other column of `pages`. Posts are first cut down to those on some page, by their ids alone.

    `ids_fit` says that the pages' rows were counted and their ids are few enough to broadcast;
    stored posts are then scanned only in the slices that hold one of them.
    """
    keys = ["slice", "doc_id"] if "slice" in posts.columns else ["doc_id"]
    # A comparison, not just "is not null": Spark prunes folders at run time only by a filtered side.
    rows = pages.where("rank > 0").drop("total")
    ids = rows.withColumn("slice", F.floor(F.col("doc_id") / SLICE_DOCS)).select(*keys).distinct()
    shown = posts.join(F.broadcast(ids) if ids_fit else ids, keys, "left_semi")
    return shown.join(rows, "doc_id")


def hits(pages: DataFrame, posts: DataFrame, highlights: DataFrame, ids_fit: bool = False) -> DataFrame:
    """What each hit shows, with title and snippet highlighted.

    Hits get their words' weights first and meet the texts last: a text is moved once, however many hits show it, and its snippet is made where it lies.
    """
    shown = fetch(pages.join(highlights, "request_id", "left"), posts, ids_fit)
    return snippets(shown, {"title": "title_weights", "content": "content_weights"}).select(
        "request_id",
        "rank",
        "doc_id",
        "score",
        "url",
        date_text(F.col("date")).alias("date"),
        "title",
        F.col("content").alias("snippet"),
        "category",
        "tags",
    )


def keyed(requests: DataFrame) -> DataFrame:
    """Each request row under a key of its own: its request_id and which of the rows with that id it is."""
    same = Window.partitionBy("request_id").orderBy(*[c for c in requests.columns if c != "request_id"])
    nth = F.row_number().over(same)
    return requests.withColumn("_nth", nth).withColumn("request_id", F.struct(F.col("request_id").alias("id"), "_nth")).drop("_nth")


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("request_id", F.col("request_id.id"))


def shared(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that ask for the same are one: (each different request once, under a key of what it asks; request_id and that key).

    Words and filters count as they were given, but for their order.
    """
    asked = ["page", "size", "lo", "hi", "ranged", F.array_sort("must").alias("must"), F.array_sort("excluded").alias("excluded"), F.array_sort("filters").alias("filters")]
    same = F.sha2(F.to_json(F.struct(*asked)), 256)
    valid = parsed.where("error is null").withColumn("_same", same)
    return valid.drop("request_id").dropDuplicates(["_same"]).withColumnRenamed("_same", "request_id"), valid.select("request_id", "_same")


def handed(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers to different requests, given to every row that asked."""
    return answers.withColumnRenamed("request_id", "_same").join(asked, "_same").drop("_same").select(*answers.columns)


def _countable(parsed: DataFrame) -> DataFrame:
    """Pages whose end no number can hold become one that is past any end: no rows, the true count."""
    fits = F.try_multiply("page", "size").isNotNull()
    return parsed.withColumns({"page": F.when(fits, F.col("page")).otherwise(2), "size": F.when(fits, F.col("size")).otherwise(1 << 61)})


def _occurring(parsed: DataFrame) -> dict:
    """What kinds of requests there are: numbers of each, and the size of their words."""
    words, filters = F.concat("must", "excluded"), F.size("filters")
    size = F.octet_length(F.array_join(words, "")) + F.coalesce(F.octet_length(F.array_join("filters.value", "")), F.lit(0))
    browse = (F.size("must") == 0) & (filters == 0)
    row = parsed.where("error is null").agg(
        F.count_if(~browse).alias("words"),
        F.count_if(browse).alias("browse"),
        F.count_if(~browse & (F.col("page") * F.col("size") > DEEP)).alias("deep"),
        F.count_if(browse & (F.col("page") * F.col("size") > DEEP)).alias("deep_browse"),
        F.coalesce(F.sum(F.size(words) + filters), F.lit(0)).alias("clauses"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
    )
    return row.first().asDict()


def _lookups_fit(wanted: DataFrame) -> bool:
    """Whether what postings are joined with may be broadcast, however many requests there are: words of one token, and the tokens of the others."""
    tokens = wanted.where("n > 1").select("field", F.explode("terms.token").alias("token")).distinct()
    for rows, text in ((wanted.where("n = 1 and min_df > 0"), "word"), (tokens, "token")):
        size = rows.agg(F.coalesce(200 * F.count("*") + 4 * F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
        if size.bytes > BROADCAST_BYTES:
            return False
    return True


def search(
    requests: DataFrame, index: Index, exclude: str = "all", stage: Stage | None = None, any_case: bool = False
) -> Answers:
    """Answer every request, each row by itself: rows that share a request_id each get their answer.

    With a `stage` the small middle results (what to look up, the pages' ids) are written
    to the shared folder first, so that Spark knows their size: small ones are broadcast
    and prune the postings' buckets and the posts' slices, and steps that no request needs are left
    out. Clear it after using the answers. `any_case`: category filters find every spelling.
    """
    keep = stage or (lambda df, name: df)
    every = keep(_countable(parse(keyed(requests))), "requests")
    parsed, asked = shared(every)
    parsed = keep(parsed, "different")
    parts = clauses(parsed)
    # Without a stage nothing is run here, so there might be requests of any kind; finer cells, which need what was counted before, are left out.
    kinds = _occurring(parsed) if stage else {"words": 1, "browse": 1, "deep": 1, "deep_browse": 0}
    few = stage is not None and kinds["clauses"] <= BROADCAST_CLAUSES and kinds["bytes"] <= BROADCAST_BYTES
    near = narrowed(index, parts) if few and kinds["words"] and not any_case else index
    wanted, fits, phrases = lookups(parts, near, any_case), False, True
    if not kinds["words"]:
        wanted = wanted.where("false")
    elif stage:
        wanted = keep(wanted, "lookups")
        per_word = F.sum("min_df").alias("rows")  # a word matches no more documents than its rarest tokens
        n = wanted.agg(F.sum(F.size("terms")).alias("tokens"), F.max("n").alias("most"), per_word).first()
        fits, phrases = few and (n.tokens or 0) * 100 <= BROADCAST_BYTES, (n.most or 0) > 1
    found = []
    if stage and kinds["words"]:
        split, deep = not fits, F.col("page") * F.col("size") > DEEP
        joins = fits or _lookups_fit(wanted)
        found.append(batch_pages(parts.where(~deep), field_matches(near, wanted, joins, phrases, not joins), exclude, n.rows or 0, kinds["words"]))
        if kinds["deep"]:
            found.append(deep_pages(matches(near, wanted, parts.where(deep), exclude, fits, phrases, split), True, keep))
    elif kinds["words"] or not kinds["browse"]:
        found.append(word_pages(matches(near, wanted, parts, exclude, fits, phrases, stage is not None and not fits), bool(kinds["deep"]), stage is not None, keep))
    if kinds["browse"]:
        found.append(browse_pages(parsed, index, bool(kinds["deep_browse"]), stage is not None, keep))
    pages = keep(reduce(DataFrame.unionByName, found), "pages")
    ids_fit = stage is not None and pages.count() <= BROADCAST_IDS
    shown = hits(pages, index.posts, weights(parts, wanted), ids_fit)
    totals = (
        parsed.select("request_id")
        .join(pages.groupBy("request_id").agg(F.max("total").alias("total")), "request_id", "left")
        .select("request_id", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    )
    texts = response_json(shown.select("request_id", "rank", *HIT_COLUMNS), totals)
    given = [handed(df, asked) for df in (pages, totals, shown, texts)]
    return Answers(*map(unkeyed, (every, *given[:3], given[3].unionByName(error_json(every)))))
