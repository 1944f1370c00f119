"""Column expressions for cutting text into tokens and showing it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of ASCII letters or one other character.
TOKEN = r"[A-Za-z]+|[^A-Za-z]"
# Fixed value: characters of text shown when nothing in it was hit.
EXCERPT_CHARS = 140
# The characters that are escaped in shown HTML.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def cut(c: Column) -> Column:
    """The text's tokens in order, unchanged, as an array."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """How many tokens `cut` gives, without building them."""
    return F.length(F.regexp_replace(c, "[A-Za-z]+", "a"))


def index_tokens(c: Column) -> Column:
    """Corpus side: cut first, then lower-case each token."""
    return F.transform(cut(c), F.lower)


def search_tokens(c: Column) -> Column:
    """Request side: lower-case the word first, then cut it."""
    return cut(F.lower(c))


def escape_html(c: Column) -> Column:
    for plain, escaped in HTML_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def excerpt(c: Column) -> Column:
    return F.substring(c, 1, EXCERPT_CHARS)


def date_text(c: Column) -> Column:
    """UTC date and time as shown in a hit."""
    utc = F.to_utc_timestamp(c, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss"), F.lit(".0 +00:00:00"))
