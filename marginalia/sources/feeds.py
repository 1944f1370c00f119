"""Atom feed files to posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.cleaning import ENTITIES, clean_html, normalise_tags, parse_published
from marginalia.operators.joins import Stage
from marginalia.schema import FEED_ENTRY

# An entry's opening tag starts a row, so a feed file of any size is cut up and shared out like lines of text.
# Comments are not told from text: an entry inside one is read like any other.
_START = "<entry"
_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
_UNDEFINED = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"


def _defined(text: Column) -> Column:
    """Named entities of the table as characters; any other ampersand that XML does not define stands for itself."""
    for name, char in ENTITIES.items():
        if not name.startswith("#") and name not in ("amp", "gt", "lt", "quot"):
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(text, _UNDEFINED, "&amp;")


def mended(entry: Column) -> Column:
    """An entry's text with entities that XML does not define resolved, its CDATA sections untouched."""
    opens, closes = "<![CDATA[", "]]>"
    parts = F.split(entry, r"<!\[CDATA\[")

    def section(part: Column) -> Column:
        inside = F.substring_index(part, closes, 1)
        return F.concat(inside, _defined(F.substr(part, F.length(inside) + 1)))

    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), section)
    return F.array_join(F.concat(F.array(_defined(F.get(parts, F.lit(0)))), rest), opens)


_OPENS, _CLOSES = "<![CDATA[", "]]>"
BROADCAST_PIECES = 1_000_000  # one number each


def _after(marker: str) -> Column:
    """How much of a piece follows the last `marker`; nothing if it has none."""
    rest = F.length(F.substring_index("value", marker, -1))
    return F.when(F.instr("value", marker) > 0, rest)


def _left_in_cdata() -> Column:
    """A piece's effect on the reader's state: whatever it was before, the last marker decides. Null: it stays as it was."""
    opened, closed = _after(_OPENS), _after(_CLOSES)
    return F.when(opened.isNotNull() & F.coalesce(opened < closed, F.lit(True)), True).when(closed.isNotNull(), False)


def _goes_on() -> Column:
    """The cut fell on another element's name, such as <entry-id>."""
    return F.col("value").rlike(r"^[\w:.-]")


def rejoined(pieces: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pieces that are entries of their own, and groups `parts` of pieces that belong together (or None).

    `pieces` has value, file and block (where the stretch of the file begins that a task read). Where an entry opens inside a CDATA section
    the cut was wrong. Whether a piece begins inside one follows from the last marker before it: within a stretch from the pieces
    before, and across stretches from one row for each, so no task sees a whole file and texts are not moved. Only if some piece ends
    inside a section, or goes on with another element's name, is anything looked at twice.
    """
    cut = pieces.withColumn("seq", F.monotonically_increasing_id())
    if cut.where(_left_in_cdata() | _goes_on()).isEmpty():
        return pieces.select("value"), None
    stage = Stage(pieces.sparkSession)
    light = cut.select("file", "block", "seq", _left_in_cdata().alias("after"), _goes_on().alias("odd"))
    inner = Window.partitionBy("file", "block").orderBy("seq")
    outer = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier, so_far = (inner.rowsBetween(Window.unboundedPreceding, to) for to in (-1, 0))

    def carried(rows: DataFrame, value: str, at_end: Column, so_far: Column, name: str) -> DataFrame:
        """`name`: the last `value` before each row, in its stretch or in the ones before."""
        ends = rows.groupBy("file", "block").agg(at_end.alias("end"))
        ends = ends.select("file", "block", F.last("end", ignorenulls=True).over(outer).alias("from_before"))
        own = rows.withColumn("own", so_far)
        return own.join(ends, ["file", "block"]).withColumn(name, F.coalesce("own", "from_before")).drop("own", "from_before")

    at_end = F.max_by("after", F.when(F.col("after").isNotNull(), F.col("seq")))
    states = carried(light, "after", at_end, F.last("after", ignorenulls=True).over(earlier), "inside")
    states = states.withColumn("joins", F.coalesce("inside", F.lit(False)) | F.col("odd"))
    starts = states.withColumn("start", F.when(~F.col("joins"), F.col("seq")))
    led = carried(starts, "start", F.max("start"), F.last("start", ignorenulls=True).over(so_far), "leader")
    led = stage(led.where("joins and leader is not null").select("seq", "leader"), "inside")
    led = led.union(led.select(F.col("leader").alias("seq"), "leader")).distinct()
    few = F.broadcast(led) if led.count() <= BROADCAST_PIECES else led
    order = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    groups = cut.join(few, "seq").groupBy("file", "leader").agg(order.alias("p"))  # one entry each
    return cut.join(few, "seq", "left_anti").select("value"), stage(groups.select(F.col("p.value").alias("parts")), "rejoined")


def cut_entries(pieces: DataFrame) -> DataFrame:
    """Entries from texts (`value`, `file`, `block`) that were cut where entries start.

    Every entry is read by itself, up to the last closing tag, so a broken one costs no other. One that is
    not XML is read again with its entities mended; if that fails too, or no closing tag is left, only
    `_corrupt_record` is set. Pieces that were cut inside a CDATA section are put together again; should the whole not be XML, each piece is
    read by itself. What stands before the first entry and between entries is left out.
    """
    plain, groups = rejoined(pieces)
    if groups is None:
        return _parsed(plain)
    whole = _parsed(groups.select(F.array_join("parts", _START).alias("value"), "parts"), "parts")
    broken = F.col("_corrupt_record").isNotNull()
    apart = _parsed(whole.where(broken).select(F.explode("parts").alias("value")))
    return _parsed(plain).unionByName(whole.where(~broken).drop("parts")).unionByName(apart)


def _parsed(pieces: DataFrame, *kept: str) -> DataFrame:
    """The entries of pieces, each with the columns `kept`."""
    closed = F.regexp_extract("value", r"(?s)^[\s>].*</entry\s*>", 0)
    around = (F.regexp_replace("value", r"\s+", "") == "") | F.col("value").rlike(r"<feed[\s>]")
    opened = F.when(F.col("value").rlike(r"^[\s>/]"), F.concat(F.lit(_START), "value")).otherwise(F.col("value"))
    entries = pieces.select("value", closed.alias("closed"), *kept).where((F.col("closed") != "") | ~around)
    entries = entries.select(F.when(F.col("closed") != "", F.concat(F.lit(_START), "closed")).otherwise(opened).alias("raw"), *kept)
    first = entries.select("raw", F.from_xml("raw", FEED_ENTRY, _OPTIONS).alias("e"), *kept)
    broken = F.col("e._corrupt_record").isNotNull() | F.col("e").isNull()
    again = F.from_xml(F.when(broken, mended(F.col("raw"))), FEED_ENTRY, _OPTIONS)
    second = first.select("raw", "e", broken.alias("broken"), again.alias("again"), *kept)
    lost = F.col("broken") & (F.col("again._corrupt_record").isNotNull() | F.col("again").isNull())
    whole = F.when(F.col("broken"), F.col("again")).otherwise(F.col("e"))
    fields = [F.when(~lost, whole[f]).alias(f) for f in FEED_ENTRY.names if f != "_corrupt_record"]
    return second.select(*fields, F.when(lost, F.col("raw")).alias("_corrupt_record"), *kept)


def _placed(pieces: DataFrame) -> DataFrame:
    return pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Every <entry> of every feed file below `path`; broken ones keep only `_corrupt_record`."""
    return cut_entries(_placed(spark.read.option("lineSep", _START).text(path)))


def stream_feeds(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The pieces of feed files as a stream that picks up each new file once; cut_entries() reads a batch of them."""
    files = spark.readStream.option("lineSep", _START).option("maxFilesPerTrigger", files_per_batch)
    return _placed(files.text(path))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def entries_to_posts(entries: DataFrame, raw: bool = False) -> DataFrame:
    """One post per entry, with `problem` set where the entry cannot be loaded.

    With `raw` also what the feed said, in raw_published and raw_entry.

    The last link and the first category count; further categories are tags. The XML
    source has decoded the title already, so it is taken as it is.
    """
    links = F.filter("link._href", lambda x: x.isNotNull())
    terms = F.coalesce(F.filter("category._term", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    # An empty first category leaves the place open for the next one.
    named = F.array_position(F.transform(terms, lambda x: x != ""), True)
    first = F.when(named > 0, named.cast("int")).otherwise(F.size(terms) + 1)
    skipped = F.greatest(F.size(terms) - first, F.lit(0))
    date = parse_published(F.col("published"))
    return entries.select(
        _or_empty(F.col("title")).alias("title"),
        _or_empty(clean_html(F.col("content._VALUE"))).alias("content"),
        _or_empty(F.try_element_at(links, F.lit(-1))).alias("url"),
        date.alias("date"),
        _or_empty(F.get(terms, first - 1)).alias("category"),
        normalise_tags(F.slice(terms, first + 1, skipped)).alias("tags"),
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("broken entry"))
        .when(date.isNull(), F.lit("bad publish time"))
        .alias("problem"),
        *([F.col("published").alias("raw_published"), F.col("_corrupt_record").alias("raw_entry")] if raw else []),
    )


def loadable(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("problem").isNull()).drop("problem", "raw_published", "raw_entry")


def quarantined(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("problem").isNotNull())
