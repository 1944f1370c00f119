"""Fragments of a text, the best one for a set of weighted tokens, and its highlighted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import cut, escape_html, excerpt
from marginalia.operators import cutting
from marginalia.operators.index import TEXT_FIELDS

# Fixed value: the most bytes a fragment may span.
FRAGMENT_BYTES = 300

# Over a text seen byte by byte: as many bytes as fit and end on a token border, that is
# neither inside a character nor between two letters; a longer letter run stays whole.
_FRAGMENT = rf"[\s\S]{{1,{FRAGMENT_BYTES}}}(?![\x80-\xbf])(?:(?<![A-Za-z])|(?![A-Za-z]))|[A-Za-z]+"


# Columns that hold the ends of a field's fragments where an index stores them.
ENDS = {f: f"{f}_ends" for f in TEXT_FIELDS}


def _pieces(c: Column) -> Column:
    """One regex pass: the text's UTF-8 bytes are read as Latin-1, where a character is a byte."""
    as_bytes = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(as_bytes, F.lit(_FRAGMENT), F.lit(0))


def cut_fragments(c: Column) -> Column:
    """Consecutive fragments of at most 300 bytes that end on token borders, as an array of texts."""
    return F.transform(_pieces(c), lambda p: F.decode(F.encode(p, "ISO-8859-1"), "UTF-8"))


def fragment_ends(c: Column) -> Column:
    """Where the text's fragments end, in bytes: what an index stores of them, some four bytes per fragment."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        _pieces(c), none, lambda ends, p: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + F.length(p))
    )


def with_ends(posts: DataFrame) -> DataFrame:
    """Posts with the ends of their fragments, found inside tasks in one pass over a text's token borders."""
    schema = T.StructType([*posts.schema, *[T.StructField(name, T.ArrayType(T.IntegerType())) for name in ENDS.values()]])
    return posts.mapInArrow(cutting.with_ends(ENDS, FRAGMENT_BYTES), schema)


def sliced(c: Column, ends: Column) -> Column:
    """The fragments of a text whose ends are known: byte slices, no cutting."""

    def each(raw: Column) -> Column:
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        return F.transform(ends, lambda end, i: F.decode(F.substr(raw, start(i) + 1, end - start(i)), "UTF-8"))

    # an array of one: its element is worked out once, not for every slice
    return F.get(F.transform(F.array(c.cast("binary")), each), 0)


def fragments(posts: DataFrame) -> DataFrame:
    """doc_id, field, fragment, byte span and text of every fragment of every post."""
    pair = [F.struct(F.lit(f).alias("field"), cut_fragments(F.col(f)).alias("parts")) for f in TEXT_FIELDS]
    before = Window.partitionBy("doc_id", "field").orderBy("fragment").rowsBetween(Window.unboundedPreceding, 0)
    width = F.octet_length("text")
    return (
        posts.select("doc_id", F.explode(F.array(*pair)).alias("f"))
        .select("doc_id", "f.field", F.posexplode_outer("f.parts").alias("fragment", "text"))
        .where("text is not null")
        .withColumn("byte_to", F.sum(width).over(before))
        .withColumn("byte_from", F.col("byte_to") - width)
    )


def best_fragment(c: Column, weights: Column, ends: Column | None = None) -> Column:
    """struct<score, place, text> of the heaviest fragment; `place` is minus its number, so that
    the earliest wins a tie. `weights` maps a lower-cased token to its weight; `ends` are the fragments' stored ends."""

    def weigh(fragment: Column) -> Column:
        weight = lambda t: F.coalesce(F.try_element_at(weights, F.lower(t)), F.lit(0.0))
        return F.aggregate(cut(fragment), F.lit(0.0), lambda total, t: total + weight(t))

    return F.array_max(
        F.transform(
            cut_fragments(c) if ends is None else sliced(c, ends),
            lambda f, i: F.struct(F.round(weigh(f), 9).alias("score"), (-i).alias("place"), f.alias("text")),
        )
    )


def highlight(fragment: Column, weights: Column) -> Column:
    """Escaped text with each weighted token in bold; neighbours stay separate."""
    return F.array_join(
        F.transform(
            cut(fragment),
            lambda t: F.when(
                F.map_contains_key(weights, F.lower(t)), F.concat(F.lit("<b>"), escape_html(t), F.lit("</b>"))
            ).otherwise(escape_html(t)),
        ),
        "",
    )


def snippets(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Replace each text column by its highlighted best fragment, or its excerpt when nothing was hit.

    `fields` maps a text column to the column of its token weights. Fragments are cut here only where their ends are not at hand.
    """
    for field, weights in fields.items():
        w = F.coalesce(F.col(weights), F.create_map().cast("map<string,double>"))
        ends = F.col(ENDS[field]) if ENDS[field] in df.columns else None
        df = df.withColumn(f"_{field}", F.when(F.size(w) > 0, best_fragment(F.col(field), w, ends)))
    for field, weights in fields.items():
        best = F.col(f"_{field}")
        shown = highlight(best["text"], F.col(weights))
        df = df.withColumn(field, F.when(best["score"] > 0, shown).otherwise(excerpt(F.col(field))))
    return df.drop(*[f"_{f}" for f in fields])
