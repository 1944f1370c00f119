"""Words and filters against the index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import search_tokens
from marginalia.operators.index import TEXT_FIELDS, Index
from marginalia.operators.joins import spread_join
from marginalia.operators.phrases import standing
from marginalia.operators.rank import bm25, idf

LOOKUP_KEY = ["kind", "word", "field"]
PUSHED_TOKENS, PUSHED_BYTES = 1000, 256  # up to so many tokens of so many bytes are named in the scan's filter


def bucket(token: Column, buckets: int) -> Column:
    """The storage bucket of a token; postings are laid out by it. Tasks that pack postings work it out too (cutting.packed)."""
    return F.pmod(F.coalesce(F.crc32(token), F.lit(0).cast("bigint")), F.lit(buckets)).cast("int")


def narrowed(index: Index, words: DataFrame) -> Index:
    """The index with the tokens of `words` named in the filters of its scans, if they are few.

    Postings and document frequencies are sorted by token, so most row groups are then passed over. With
    more tokens the index stays as it is; the joins that follow give the same rows either way.
    """
    parts = F.when(F.col("kind") == "text", search_tokens(F.col("word"))).otherwise(F.array("word"))
    token = words.select(F.explode(parts).alias("token")).distinct()
    short = F.when(F.octet_length("token") <= PUSHED_BYTES, F.col("token"))
    known = token.select(short.alias("token"), bucket(F.col("token"), index.buckets).alias("bucket"))
    rows = known.limit(PUSHED_TOKENS + 1).collect()
    if len(rows) > PUSHED_TOKENS or any(r.token is None for r in rows):
        return index
    named = F.col("token").isin([r.token for r in rows])
    stored = F.col("bucket").isin(sorted({r.bucket for r in rows})) if index.buckets > 1 else F.lit(True)
    return replace(index, postings=index.postings.where(named & stored), doc_freq=index.doc_freq.where(named))


def lookups(words: DataFrame, index: Index, any_case: bool = False) -> DataFrame:
    """What to look up for each distinct (kind, word): one row per field.

    kind `text` is a keyword, searched in title and content and cut into tokens; any
    other kind names an exact field. `terms` holds the tokens with their byte offsets
    in the word; `anchor` is the rarest one, from which matching starts.

    With `any_case` a category stands for every stored spelling of it: one row per spelling,
    weighed by the documents of all of them together.
    """
    text = F.col("kind") == "text"
    cut_words = words.select("kind", "word").distinct().select(
        "kind",
        "word",
        F.explode(F.when(text, F.array(*map(F.lit, TEXT_FIELDS))).otherwise(F.array("kind"))).alias("field"),
        F.when(text, search_tokens(F.col("word"))).otherwise(F.array("word")).alias("parts"),
    )
    if any_case:
        spelt = index.doc_freq.where("field = 'category'").select(F.col("token").alias("spelling")).distinct()
        stored = cut_words.where("kind = 'category'").drop("parts").join(spelt, F.lower("spelling") == F.col("word"))
        stored = stored.select(*LOOKUP_KEY, F.array("spelling").alias("parts"))
        cut_words = cut_words.where("kind <> 'category'").unionByName(stored)
    placed = cut_words.select(
        *LOOKUP_KEY, F.size("parts").alias("n"), "parts", F.posexplode("parts").alias("i", "token")
    ).withColumn(
        "offset",
        F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0), lambda a, t: a + F.octet_length(t)),
    )
    freq = (
        index.doc_freq.join(placed.select("field", "token").distinct(), ["field", "token"], "left_semi")
        .groupBy("field", "token")
        .agg(F.sum("df").alias("df"))
    )
    known = placed.drop("parts").join(freq, ["field", "token"], "left").join(F.broadcast(index.field_stats), "field")
    df = F.coalesce("df", F.lit(0).cast("bigint"))
    spelling = []
    if any_case:
        exact = F.col("kind") == "category"
        together = F.sum("df").over(Window.partitionBy(*LOOKUP_KEY, "i"))
        known = known.withColumns({"df": F.when(exact, together).otherwise(F.col("df")), "spelling": F.when(exact, F.col("token"))})
        spelling = ["spelling"]
    looked_up = known.groupBy(*LOOKUP_KEY, "n", *spelling).agg(
        F.min(df).alias("min_df"),
        F.round(F.sum(idf(F.col("n_docs"), df)), 12).alias("idf"),
        F.first("avgdl").alias("avgdl"),
        F.min_by("token", F.struct(df, F.col("i"))).alias("anchor"),
        F.sort_array(F.collect_list(F.struct("i", "offset", "token", df.alias("df")))).alias("terms"),
    )
    return looked_up.drop(*spelling)


def field_matches(index: Index, wanted: DataFrame, fits: bool = False, phrases: bool = True, split: bool = False) -> DataFrame:
    """kind, word, field, doc_id, date, tf and score part: one row per document and field that matches.

    `fits`: the lookups were counted and are few enough to broadcast. `phrases`: words of several tokens may
    be among them; without, their steps are not planned. `split`: the lookups are stored, and frequent tokens are split by their counts.
    """
    found = wanted.where("min_df > 0").withColumn("bucket", bucket(F.col("anchor"), index.buckets))
    found = found.withColumn("anchor_df", F.col("min_df"))  # how many postings the anchor has
    keep = [*LOOKUP_KEY, "doc_id", "date", "dl", "tf", "idf", "avgdl"]
    hits = _at_anchor(index, found.where("n = 1"), fits, split, "tf").select(*keep)
    if phrases:
        hits = hits.unionByName(_phrases(index, found, fits).select(*keep))
    part = bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return hits.select(*LOOKUP_KEY, "doc_id", "date", "tf", part.alias("score"))


def _at_anchor(index: Index, found: DataFrame, fits: bool, split: bool, *columns: str) -> DataFrame:
    """The postings of each word's rarest token."""
    narrow = index.postings.select(
        "field", "bucket", F.col("token").alias("anchor"), "doc_id", "date", "dl", *columns
    )
    keys = ["field", "bucket", "anchor"]
    sizes = found.groupBy(*keys).agg(F.max("anchor_df").alias("rows")) if split else None
    return spread_join(found.drop("anchor_df"), narrow, keys, "doc_id", fits, sizes).drop("bucket")


def _phrases(index: Index, found: DataFrame, fits: bool) -> DataFrame:
    """Words of several tokens: the tokens must follow each other at exact byte offsets.

    The postings of all their tokens meet by document, each once however many phrases name it (operators/phrases.py).
    """
    phrases = found.where("n > 1")
    tokens = phrases.select("field", F.explode("terms.token").alias("token")).distinct()
    tokens = tokens.withColumn("bucket", bucket(F.col("token"), index.buckets))
    named = index.postings.select("field", "bucket", "token", "doc_id", "date", "dl", "positions").join(
        F.broadcast(tokens) if fits else tokens, ["field", "bucket", "token"], "left_semi"
    )
    return standing(named.drop("bucket"), phrases, index.field_stats)


def word_matches(index: Index, wanted: DataFrame, fits: bool = False, phrases: bool = True, split: bool = False) -> DataFrame:
    """kind, word, doc_id, date, score: a word matches if any of its fields does; parts add up."""
    return (
        field_matches(index, wanted, fits, phrases, split)
        .groupBy("kind", "word", "doc_id")
        .agg(F.first("date").alias("date"), F.sum("score").alias("score"))
    )


def phrase_pattern(word: str) -> str:
    """A regex over lower-cased text that finds a word where it ends at token borders."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in word)
    ahead = "(?<![a-z])" if word[:1].isascii() and word[:1].isalpha() else ""
    behind = "(?![a-z])" if word[-1:].isascii() and word[-1:].isalpha() else ""
    return ahead + quoted + behind
