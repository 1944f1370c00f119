"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import corpus
from marginalia.operators.index import Index
from marginalia.session import shared_dir
from marginalia.sources.store import Store

_stores: dict[tuple[str, str], Store] = {}
_feeds: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The whole `posts` view stored and indexed, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        built = Store(spark, shared_dir(spark, "store"))
        built.add(corpus.posts(spark, sf_dir))
        _stores[key] = built
    return _stores[key]


def index(spark: SparkSession, sf_dir: str) -> Index:
    return store(spark, sf_dir).index()


def use(spark: SparkSession, sf_dir: str, built: Store) -> None:
    """Let the queries over a data folder use a store that is already built."""
    _stores[(spark.sparkContext.applicationId, sf_dir)] = built


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that have a label stand for the ones loaded earlier."""
    labels = corpus.read_table(spark, sf_dir, "labels").select("doc_id")
    return corpus.posts(spark, sf_dir).join(labels, "doc_id", "left_semi")


def labelled_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of the labelled posts, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} labelled")
    if key not in _stores:
        built = Store(spark, shared_dir(spark, "labelled"))
        built.add(labelled(spark, sf_dir))
        _stores[key] = built
    return _stores[key]


#: What every seventh post of the feed quotes: an entry of another feed.
QUOTED = '\n<entry id="q"><b>quoted</b></entry> and <![CDATA[ after'


def feed_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Atom files with one entry per post of the `posts` view.

    Every seventh post quotes a feed and stands in a CDATA section, unless its text could not; the others are
    written by Spark.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _feeds:
        return _feeds[key]
    path = shared_dir(spark, "feed")
    quotes = F.col("doc_id") % 7 == 0
    content = F.when(quotes, F.concat("content", F.lit(QUOTED))).otherwise(F.col("content"))
    posts = corpus.posts(spark, sf_dir).select(
        "title",
        "url",
        F.concat(F.array("category"), F.transform("tags", F.upper)).alias("terms"),
        F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published"),
        content.alias("content"),
        (quotes & ~F.col("content").rlike(r"[\x00-\x08\x0B-\x1F]|\]\]>") & ~F.col("title").rlike(r"[\x00-\x1F]")).alias("literal"),
    )
    posts.where(~F.col("literal")).select(
        "title",
        F.array(F.struct(F.col("url").alias("_href"))).alias("link"),
        F.transform("terms", lambda t: F.struct(t.alias("_term"))).alias("category"),
        "published",
        F.struct(F.col("content").alias("_VALUE"), F.lit("html").alias("_type")).alias("content"),
    ).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)

    def escaped(c: Column) -> Column:
        for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
            c = F.replace(c, F.lit(char), F.lit(f"&{name};"))
        return c

    entry = F.concat(
        F.lit("<entry><title>"), escaped(F.col("title")), F.lit('</title><link href="'), escaped(F.col("url")), F.lit('"/>'),
        F.array_join(F.transform("terms", lambda t: F.concat(F.lit('<category term="'), escaped(t), F.lit('"/>'))), ""),
        F.lit("<published>"), F.col("published"), F.lit('</published><content type="html"><![CDATA['), F.col("content"), F.lit("]]></content></entry>"),
    )
    posts.where("literal").select(entry).write.mode("append").text(path)
    _feeds[key] = path
    return path


def one_request(
    spark: SparkSession,
    q: list[str] | None = None,
    terms: list[str] | None = None,
    range_: list[int] | None = None,
    page: int = 1,
    size: int = 8,
) -> DataFrame:
    """A requests table with a single row, known to the optimizer as a constant."""

    def array(values, kind: str) -> Column:
        return F.array(*[F.lit(v) for v in values or []]).cast(f"array<{kind}>")

    return spark.sql("SELECT * FROM VALUES ('only') AS t(request_id)").select(
        "request_id",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("size"),
        array(range_, "bigint").alias("range"),
        array(terms, "string").alias("terms"),
        array(q, "string").alias("q"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per conversation turn, its words taken from the turn's whole text."""
    turns = corpus.read_table(spark, sf_dir, "conversations")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    keyed = F.array_sort(F.transform(words, lambda w: F.concat(F.lpad(F.length(w).cast("string"), 6, "0"), w)))

    def word(i: int) -> Column:
        return F.coalesce(F.substr(F.try_element_at("keyed", F.lit(i)), F.lit(7)), F.lit(""))

    none = F.array().cast("array<string>")
    kind = F.col("kind")
    minus = lambda c: F.concat(F.lit("-"), c)
    w1, w2, long = F.col("w1"), F.col("w2"), F.col("w_long")
    lo = 1577836800 + (F.col("conv_id") * 7 % 1000) * 86400
    langs = F.array(*map(F.lit, ("EN", "fr", "de", "es")))
    return (
        turns.withColumn("keyed", keyed)
        .withColumn("kind", (F.col("conv_id") + F.col("turn")) % 8)
        .select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
            "conv_id",
            "turn",
            "kind",
            word(1).alias("w1"),
            word(2).alias("w2"),
            word(-1).alias("w_long"),
            F.regexp_extract(F.lower("text"), "[a-z]+ [a-z]+", 0).alias("pair"),
        )
        .select(
            "request_id",
            (1 + F.col("turn") % 2).cast("bigint").alias("page"),
            F.when(F.col("conv_id") % 50 == 13, 0).otherwise(3 + F.col("conv_id") % 5).cast("bigint").alias("size"),
            F.when(kind == 5, F.array(lo, lo + (F.col("turn") + 1) * 3456000 + 3600))
            .when(kind == 7, F.array(F.lit(0).cast("bigint"), lo))
            .otherwise(F.array().cast("array<bigint>"))
            .alias("range"),
            F.when(kind == 3, F.array(F.concat(F.lit("category:"), F.get(langs, (F.col("conv_id") % 4).cast("int")))))
            .when(
                kind == 4,
                F.array(F.concat(F.lit("tags:SRC"), (F.col("conv_id") % 20).cast("string")), F.lit("tags:quality")),
            )
            .when(kind == 7, F.array(F.lit("foo:bar")))
            .otherwise(none)
            .alias("terms"),
            F.when(kind == 0, F.array(w1, w2))
            .when(kind == 1, F.array(w1, minus(w2)))
            .when(kind == 2, F.array("pair"))
            .when(kind == 3, F.array(w1, minus(w2), minus(long)))
            .when((kind == 6) & (F.col("turn") % 2 == 0), F.array(minus(w1)))
            .when(kind == 7, F.array(w1))
            .otherwise(none)
            .alias("q"),
        )
    )


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of requests as text lines, some malformed, from the turns' whole texts."""
    turns = corpus.read_table(spark, sf_dir, "conversations")
    text = F.regexp_replace("text", "[,\n]", " ")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 900).cast("int")), "yyyy-MM-dd")
    line = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("1-8,"), day, F.lit("~2022-01-01,tags:src1 category:EN,"), text))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("2-5,~,,"), text))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("x-5,~"), day, F.lit(",,"), text))
        .otherwise(text)
    )
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        line.alias("line"),
    )


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search requests as text lines `page-size,from~to,filters,words`, dates as days and no commas in words."""
    day = lambda i: F.when(F.get("range", F.lit(i)) != 0, F.date_add(F.lit("1970-01-01").cast("date"), (F.get("range", F.lit(i)) / 86400).cast("int")).cast("string"))
    part = lambda c: F.replace(F.array_join(c, " "), F.lit(","), F.lit(""))
    numbers = F.concat_ws("-", F.col("page").cast("string"), F.col("size").cast("string"))
    days = F.concat(F.coalesce(day(0), F.lit("")), F.lit("~"), F.coalesce(day(1), F.lit("")))
    return requests(spark, sf_dir).select(F.concat_ws(",", numbers, days, part("terms"), part("q")).alias("line"))
