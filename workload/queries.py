"""The registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import corpus
from marginalia.functions import cleaning, text
from marginalia.operators import index as ix
from marginalia.operators import match, rank, snippet, tokens
from marginalia.operators.joins import Stage
from marginalia.plans import ingest, pages, search
from marginalia.session import shared_dir
from marginalia.sources import feeds
from marginalia.sources import requests as rq
from marginalia.sources.store import Store
from marginalia.streaming.ingest import start_ingest
from marginalia.streaming.search import start_search, stream_lines, stream_requests
from workload import inputs

WORDS = ["that", "the"]


def seconds(c: str):
    return F.unix_timestamp(c)


def joined(c: str):
    return F.array_join(c, ",")


# --- sources and loads


def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    entries = feeds.read_feeds(spark, inputs.feed_files(spark, sf))
    return entries.select(
        F.get("link._href", F.lit(0)).alias("href"),
        "title",
        "published",
        F.array_join("category._term", ",").alias("terms"),
        F.col("content._VALUE").alias("content"),
    )


def feed_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = feeds.entries_to_posts(feeds.read_feeds(spark, inputs.feed_files(spark, sf)))
    return feeds.loadable(posts).select(
        "url", "title", "content", seconds("date").alias("date_s"), "category", joined("tags").alias("tags")
    )


def load_new_only(spark: SparkSession, sf: str) -> DataFrame:
    """All posts against a store whose url keys are those of the labelled ones."""
    batch = corpus.posts(spark, sf)
    new = ingest.only_new(batch, inputs.labelled_store(spark, sf).known_urls(batch, Stage(spark)))
    return new.select("doc_id", "url", "title", seconds("date").alias("date_s"), joined("tags").alias("tags"))


def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads: the labelled posts, then all; the second adds what is new."""
    store = Store(spark, shared_dir(spark, "report"))
    ingest.append_new(store, inputs.labelled(spark, sf).drop("doc_id"))
    ingest.append_new(store, corpus.posts(spark, sf).drop("doc_id"))
    return ingest.load_report(store).select("load", "added")


def feed_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the feed whose publish time has no offset, kept with what the feed said."""
    store = Store(spark, shared_dir(spark, "quarantine"))
    entries = feeds.read_feeds(spark, inputs.feed_files(spark, sf))
    cut = F.regexp_replace("published", r"\+00:00$", "Z")
    ingest.load_feed(store, entries.withColumn("published", F.when(F.get("link._href", F.lit(0)).rlike("[0369]$"), cut).otherwise(F.col("published"))))
    return store.quarantine().select("url", "problem", "raw_published", "title")


def url_split(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return corpus.read_table(spark, sf, "pages").select(
        "page_id",
        cleaning.is_feed_url(url).alias("ok"),
        cleaning.feed_host(url).alias("host"),
        cleaning.feed_path(url).alias("path"),
    )


# --- cleaning


def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.read_table(spark, sf, "pages").select("page_id", cleaning.strip_markup(F.col("html")).alias("text"))


def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    clean = cleaning.trim_white(cleaning.collapse_blanks(cleaning.strip_markup(html)))
    return corpus.read_table(spark, sf, "pages").select("page_id", clean.alias("text"))


def entity_decode(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.read_table(spark, sf, "pages").select("page_id", cleaning.decode_entities(F.col("html")).alias("text"))


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.clean_pages(corpus.read_table(spark, sf, "pages"))


def published_parse(spark: SparkSession, sf: str) -> DataFrame:
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 4
    published = (
        F.when(n == 0, F.concat(written, F.lit("+08:00")))
        .when(n == 1, F.concat(written, F.lit("-05:30")))
        .when(n == 2, F.concat(written, F.lit("Z")))
    )
    return corpus.read_table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(cleaning.parse_published(published)).alias("published_s")
    )


def tag_normalise(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.upper("source"), F.initcap("lang"))
    return corpus.read_table(spark, sf, "documents").select(
        "doc_id", F.array_join(cleaning.normalise_tags(tags), ",").alias("tags")
    )


def day_to_epoch(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 3
    written = F.when(n == 0, day).when(n == 1, F.replace(day, F.lit("-"), F.lit("/"))).otherwise("")
    return corpus.read_table(spark, sf, "orders").select("o_orderkey", cleaning.day_to_epoch(written).alias("day_s"))


# --- tokens and index tables


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    posts = corpus.posts(spark, sf)
    return posts.select(
        "doc_id",
        F.array_join(text.index_tokens(F.col("title")), "¦").alias("title_tokens"),
        F.array_join(text.index_tokens(F.col("content")), "¦").alias("content_tokens"),
    )


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each token stands, summed up per document field and token."""
    return (
        tokens.token_offsets(corpus.posts(spark, sf))
        .groupBy("doc_id", "field", "token")
        .agg(
            F.count("*").alias("n"),
            F.min("byte_from").alias("first_from"),
            F.max("byte_to").alias("last_to"),
            F.sum("byte_from").alias("sum_from"),
            F.sum("ord").alias("sum_ord"),
        )
    )


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return ix.postings(corpus.posts(spark, sf)).select(
        "field", "token", "doc_id", "dl", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")
    )


def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return ix.doc_freq(ix.postings(corpus.posts(spark, sf)))


def field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ix.field_stats(corpus.posts(spark, sf)).select(
        "field", "n_docs", "total_len", F.round("avgdl", 6).alias("avgdl")
    )


# --- matching


def _word(spark: SparkSession, sf: str, word: str, kind: str = "text") -> DataFrame:
    words = spark.sql("SELECT * FROM VALUES (:kind, :word) AS t(kind, word)", args={"kind": kind, "word": word})
    index = match.narrowed(inputs.index(spark, sf), words)
    wanted, phrases = _looked_up(match.lookups(words, index))
    return match.field_matches(index, wanted, fits=True, phrases=phrases)


def _looked_up(lookups: DataFrame) -> tuple[DataFrame, bool]:
    """The lookups of one request, staged, and whether a word of several tokens is among them."""
    wanted = Stage(lookups.sparkSession)(lookups, "lookups")
    return wanted, not wanted.where("n > 1").isEmpty()


def term_match(spark: SparkSession, sf: str) -> DataFrame:
    return _word(spark, sf, "that").select("doc_id", "field", "tf")


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return _word(spark, sf, "of the").select("doc_id", "field", "tf")


def any_field(spark: SparkSession, sf: str) -> DataFrame:
    return _word(spark, sf, "of the").select("doc_id").distinct()


def _found(spark: SparkSession, sf: str, exclude: str = "all", **request) -> DataFrame:
    parts = search.clauses(rq.parse(inputs.one_request(spark, **request)))
    index = match.narrowed(inputs.index(spark, sf), parts)
    wanted, phrases = _looked_up(match.lookups(parts, index))
    return search.matches(index, wanted, parts, exclude, True, phrases)


def all_words(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, q=WORDS).select("doc_id", "score")


def exclude_words(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, q=["the", "-that", "-with"]).select("doc_id", "score")


def exclude_any_word(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, exclude="any", q=["the", "-that", "-with"]).select("doc_id", "score")


def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, terms=["tags:SRC1", "tags:quality"]).select("doc_id")


def category_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, terms=["category:EN"]).select("doc_id")


def category_any_case(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose categories are stored in two spellings, both found by the option."""
    mixed = F.when(F.col("doc_id") % 2 == 0, F.upper("category")).otherwise(F.col("category"))
    parts = search.clauses(rq.parse(inputs.one_request(spark, q=["the"], terms=["category:EN"])))
    posts = corpus.posts(spark, sf).withColumn("category", mixed)
    index = ix.from_posts(posts, parts.select(F.col("word").alias("token")))
    wanted, phrases = _looked_up(match.lookups(parts, index, any_case=True))
    return search.matches(index, wanted, parts, "all", True, phrases).select("doc_id", "score")


def filter_parse(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(
        F.concat(F.lit("tags:"), F.upper("source")),
        F.concat(F.lit("lang:"), F.col("lang")),
        F.concat(F.lit("category:A:"), F.col("lang")),
    )
    parsed = F.transform(rq.parse_filters(terms), lambda f: F.concat_ws("=", f["field"], f["value"]))
    return corpus.read_table(spark, sf, "documents").select("doc_id", F.array_join(parsed, ";").alias("filters"))


def date_range(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.index(spark, sf).posts
    return posts.where(search.in_range("date", 1600000000, 1610000000)).select("doc_id", seconds("date").alias("date_s"))


def combined_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(
        spark, sf, q=["the", "-that"], terms=["category:en", "tags:quality"], range_=[1590000000, 0]
    ).select("doc_id", "score")


def request_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rq.parse(inputs.requests(spark, sf)).select("request_id", "error")


# --- results


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_first(_found(spark, sf, q=WORDS), 1, 8).select("doc_id", "score")


def page_two(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_first(_found(spark, sf, q=["of the"]), 2, 8).select("doc_id", "score")


def browse_newest(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.index(spark, sf).posts.select("doc_id", "date")
    return rank.newest_first(posts, 1, 8).select("doc_id", seconds("date").alias("date_s"))


def hit_count(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, q=WORDS).agg(F.count("*").alias("hits"))


# --- snippets


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    return snippet.fragments(corpus.posts(spark, sf))


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """All posts with the weights of one request's words."""
    index = inputs.index(spark, sf)
    parts = search.clauses(rq.parse(inputs.one_request(spark, q=WORDS)))
    # One request gives one row.
    weights = search.weights(parts, match.lookups(parts, index))
    return index.posts.select("*", *[weights.select(c).scalar().alias(c) for c in ("title_weights", "content_weights")])


def best_fragment(spark: SparkSession, sf: str) -> DataFrame:
    best = {f: snippet.best_fragment(F.col(f), F.col(f"{f}_weights")) for f in ix.TEXT_FIELDS}
    both = F.array(*[F.struct(F.lit(f).alias("field"), b.alias("b")) for f, b in best.items()])
    return (
        _weighted(spark, sf)
        .select("doc_id", F.explode(both).alias("f"))
        .where("f.b.score > 0")
        .select(
            "doc_id",
            "f.field",
            (-F.col("f.b.place")).alias("fragment"),
            F.col("f.b.text").alias("text"),
            F.round("f.b.score", 6).alias("score"),
        )
    )


def snippet_html(spark: SparkSession, sf: str) -> DataFrame:
    shown = snippet.snippets(_weighted(spark, sf), {"title": "title_weights", "content": "content_weights"})
    return shown.select("doc_id", "title", F.col("content").alias("snippet"))


def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.posts(spark, sf).select("doc_id", text.excerpt(F.col("content")).alias("excerpt"))


def date_text(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.posts(spark, sf).select("doc_id", text.date_text(F.col("date")).alias("date"))


# --- whole searches


def _answers(spark: SparkSession, sf: str, requests: DataFrame) -> search.Answers:
    return search.search(requests, inputs.index(spark, sf), stage=Stage(spark))


def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf, inputs.one_request(spark, q=WORDS))
    return answers.hits.select(
        "rank", "doc_id", "score", "url", "date", "title", "snippet", "category", joined("tags").alias("tags")
    )


def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, inputs.requests(spark, sf)).pages.where("doc_id is not null").select(
        "request_id", "rank", "doc_id", "score"
    )


def batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, inputs.requests(spark, sf)).totals


def response_json(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, inputs.requests(spark, sf)).responses


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rq.from_lines(inputs.request_lines(spark, sf))
    return parsed.select(
        "request_id",
        "page",
        "size",
        F.array_join(F.col("range").cast("array<string>"), "~").alias("range"),
        F.array_join("terms", " ").alias("terms"),
        F.array_join("q", " ").alias("q"),
        F.col("line_error").alias("error"),
    )


# --- streams and full loads


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The feed files loaded as a stream into an empty store."""
    store = Store(spark, shared_dir(spark, "streamed"))
    start_ingest(store, inputs.feed_files(spark, sf), shared_dir(spark, "ingest-state")).awaitTermination()
    return store.posts().select(
        "url", "title", "content", seconds("date").alias("date_s"), "category", joined("tags").alias("tags")
    )


def stream_search(spark: SparkSession, sf: str) -> DataFrame:
    """The requests answered as a stream of JSON files."""
    inputs.index(spark, sf)
    inbox, answers = shared_dir(spark, "inbox"), shared_dir(spark, "answers")
    inputs.requests(spark, sf).write.json(inbox)
    requests = stream_requests(spark, inbox)
    start_search(inputs.store(spark, sf), requests, answers, shared_dir(spark, "search-state")).awaitTermination()
    return spark.read.parquet(answers).select("request_id", "response")


def line_search(spark: SparkSession, sf: str) -> DataFrame:
    """Request lines in text files, answered as a stream."""
    inputs.index(spark, sf)
    inbox, answers = shared_dir(spark, "lines"), shared_dir(spark, "answers")
    inputs.search_lines(spark, sf).write.text(inbox)
    start_search(inputs.store(spark, sf), stream_lines(spark, inbox), answers, shared_dir(spark, "line-state")).awaitTermination()
    line = F.substr("request_id", F.instr("request_id", ":") + 1)  # the id is file:line
    return spark.read.parquet(answers).select(line.alias("line"), "response")


def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A load of part of the posts, replaced by a load of all of them."""
    store = Store(spark, shared_dir(spark, "rebuilt"))
    ingest.rebuild(store, inputs.labelled(spark, sf).drop("doc_id"))
    ingest.rebuild(store, corpus.posts(spark, sf).drop("doc_id"))
    n_loads = store.table("loads").select(F.count("*").cast("int")).scalar()
    return store.posts().select("doc_id", "url", n_loads.alias("n_loads"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_scan,
        feed_posts,
        load_new_only,
        load_report,
        feed_quarantine,
        url_split,
        html_strip,
        html_clean,
        entity_decode,
        clean_pages,
        published_parse,
        tag_normalise,
        day_to_epoch,
        tokenize,
        token_offsets,
        postings,
        doc_freq,
        field_stats,
        term_match,
        phrase_match,
        any_field,
        all_words,
        exclude_words,
        exclude_any_word,
        tag_filter,
        category_filter,
        category_any_case,
        filter_parse,
        date_range,
        combined_search,
        request_errors,
        bm25_topk,
        page_two,
        browse_newest,
        hit_count,
        fragments,
        best_fragment,
        snippet_html,
        excerpt,
        date_text,
        search_hits,
        batch_search,
        batch_counts,
        response_json,
        request_lines,
        stream_ingest,
        stream_search,
        line_search,
        rebuild,
    )
}
