"""The registered queries' results stated as DuckDB SQL over the same tables."""

from __future__ import annotations

# --- shared pieces

POSTS = r"""
posts AS (
  SELECT d.doc_id, regexp_extract(d.text, '^[^\n]{0,80}') AS title, d.text AS content,
         'https://corpus.example/' || d.lang || '/' || d.doc_id AS url,
         1577836800 + (d.doc_id * 37 % 1000) * 86400 + d.doc_id % 86400 AS date_s,
         d.lang AS category, d.source,
         [d.source] || CASE WHEN l.quality = 1 THEN ['quality'] ELSE [] END
                    || CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE [] END AS tags
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

# The posts as the feed has them: every seventh quotes an entry of another feed.
FED = (
    POSTS
    + r""",
fed AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN content || chr(10) || '<entry id="q"><b>quoted</b></entry> and <![CDATA[ after' ELSE content END AS content) FROM posts)"""
)

TOKENS = (
    POSTS
    + r""",
cuts AS (
  SELECT doc_id, 'title' AS field, regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]') AS parts FROM posts
  UNION ALL
  SELECT doc_id, 'content', regexp_extract_all(content, '[A-Za-z]+|[^A-Za-z]') FROM posts),
raw AS (SELECT doc_id, field, len(parts) AS dl, generate_subscripts(parts, 1) - 1 AS ord, unnest(parts) AS part FROM cuts),
tokens AS MATERIALIZED (
  SELECT doc_id, field, dl, ord, part, lower(part) AS token,
         coalesce(sum(strlen(part)) OVER w, 0)::BIGINT AS byte_from,
         coalesce(sum(strlen(part)) OVER w, 0)::BIGINT + strlen(part) AS byte_to
  FROM raw WINDOW w AS (PARTITION BY doc_id, field ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
)

# Postings of all four fields, document frequencies and field statistics.
INDEX = (
    TOKENS
    + r""",
postings AS MATERIALIZED (
  SELECT field, token, doc_id, any_value(dl) AS dl, count(*) AS tf,
         string_agg(byte_from::VARCHAR, ' ' ORDER BY byte_from) AS positions
  FROM tokens GROUP BY ALL
  UNION ALL
  SELECT DISTINCT 'tags', unnest(tags), doc_id, len(tags), 1, '' FROM posts
  UNION ALL
  SELECT 'category', category, doc_id, 1, 1, '' FROM posts),
doc_freq AS MATERIALIZED (SELECT field, token, count(*) AS df FROM postings GROUP BY ALL),
field_stats AS (
  SELECT field, (SELECT count(*) FROM posts) AS n_docs, total_len, total_len / (SELECT count(*) FROM posts) AS avgdl
  FROM (SELECT 'title' AS field, count(*) AS total_len FROM tokens WHERE field = 'title'
        UNION ALL SELECT 'content', count(*) FROM tokens WHERE field = 'content'
        UNION ALL SELECT 'tags', sum(len(tags))::BIGINT FROM posts
        UNION ALL SELECT 'category', count(*) FROM posts))"""
)

# From `requests` (request_id, page, size, range, terms, q) to `parsed` and `clauses`.
PARSED = r""",
split AS (
  SELECT *, list_transform(list_filter(q, lambda w: w <> '' AND NOT starts_with(w, '-')), lambda w: lower(w)) AS must,
         list_transform(list_filter(q, lambda w: starts_with(w, '-')), lambda w: lower(substr(w, 2))) AS excluded,
         list_filter(terms, lambda t: split_part(t, ':', 1) IN ('tags', 'category')) AS known
  FROM requests),
parsed AS MATERIALIZED (
  SELECT *, nullif(range[1], 0) AS lo, nullif(range[2], 0) AS hi,
         CASE WHEN len(must) = 0 AND len(excluded) > 0 THEN 'It is forbidden queries that are only `excluding`.'
              WHEN list_contains(excluded, '') OR len(list_filter(known, lambda t: NOT contains(t, ':'))) > 0 OR len(range) = 1
                THEN 'Invalid Arguments. '
              WHEN len(must) = 0 AND len(known) = 0 AND len(range) = 0 THEN 'It is forbidden queries that are empty.'
              WHEN page < 1 OR size < 1 THEN 'Invalid Arguments. ' END AS error
  FROM split)"""

# From `parsed` to `matched`: every document that satisfies a request, with its score and sort key.
MATCHED = (
    PARSED
    + r""",
clauses AS MATERIALIZED (
  SELECT request_id, 'must' AS role, 'text' AS kind, unnest(must) AS word FROM parsed WHERE error IS NULL
  UNION ALL
  SELECT request_id, 'excluded', 'text', unnest(excluded) FROM parsed WHERE error IS NULL
  UNION ALL
  SELECT request_id, 'filter', split_part(f, ':', 1), lower(substr(f, instr(f, ':') + 1))
  FROM (SELECT request_id, unnest(known) AS f FROM parsed WHERE error IS NULL)),
words AS (
  SELECT kind, word, regexp_extract_all(word, '[A-Za-z]+|[^A-Za-z]') AS parts
  FROM (SELECT DISTINCT kind, word FROM clauses) WHERE kind = 'text'
  UNION ALL
  SELECT DISTINCT kind, word, [word] FROM clauses WHERE kind <> 'text'),
word_terms AS (
  SELECT kind, word, len(parts) AS n, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS token,
         parts FROM words),
terms AS MATERIALIZED (
  SELECT kind, word, n, i, token, coalesce(list_sum(list_transform(parts[1:i], lambda p: strlen(p))), 0)::BIGINT AS shift,
         f.field
  FROM word_terms JOIN (VALUES ('text', 'title'), ('text', 'content'), ('tags', 'tags'), ('category', 'category')) f(k, field)
    ON k = kind),
word_idf AS (
  SELECT kind, word, field, round(sum(ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))), 12) AS idf,
         any_value(avgdl) AS avgdl
  FROM terms LEFT JOIN doc_freq USING (field, token) JOIN field_stats USING (field) GROUP BY ALL),
starts AS (
  SELECT kind, word, field, doc_id, n, byte_from - shift AS start, count(*) AS found, any_value(dl) AS dl
  FROM terms JOIN tokens USING (field, token) WHERE n > 1 GROUP BY ALL),
field_hits AS MATERIALIZED (
  SELECT kind, word, field, doc_id, tf, dl FROM terms JOIN postings USING (field, token) WHERE n = 1
  UNION ALL
  SELECT kind, word, field, doc_id, count(*), any_value(dl) FROM starts WHERE found = n GROUP BY ALL),
scored AS (
  SELECT kind, word, field, doc_id, tf, idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
  FROM field_hits JOIN word_idf USING (kind, word, field)),
word_hits AS (SELECT kind, word, doc_id, sum(part) AS part FROM scored GROUP BY ALL),
per_doc AS (
  SELECT request_id, doc_id, count(*) FILTER (role = 'must') AS n_must,
         count(*) FILTER (role = 'excluded') AS n_excluded, count(*) FILTER (role = 'filter') AS n_filter,
         sum(CASE WHEN role = 'excluded' THEN 0 ELSE part END) AS part
  FROM clauses JOIN word_hits USING (kind, word) GROUP BY ALL
  UNION ALL
  SELECT request_id, doc_id, 0, 0, 0, 0 FROM parsed, posts
  WHERE error IS NULL AND len(must) = 0 AND len(known) = 0),
matched AS MATERIALIZED (
  SELECT request_id, doc_id, page, size,
         CASE WHEN len(must) > 0 THEN round(part + CASE WHEN len(range) > 0 THEN 1.0 ELSE 0.0 END, 4) END AS score,
         CASE WHEN len(must) > 0 THEN round(part + CASE WHEN len(range) > 0 THEN 1.0 ELSE 0.0 END, 4)
              ELSE date_s END AS key
  FROM per_doc JOIN parsed USING (request_id) JOIN posts USING (doc_id)
  WHERE n_must = len(must) AND n_filter = len(known)
    AND NOT (len(excluded) > 0 AND n_excluded >= {excluded_limit})
    AND coalesce(date_s >= lo, true) AND coalesce(date_s <= hi, true)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY key DESC, doc_id) AS rank FROM matched),
pages_of AS MATERIALIZED (SELECT * FROM ranked WHERE rank > (page - 1) * size AND rank <= page * size)"""
)
ALL = "len(excluded)"

# Fragment starts by recursion: the next fragment begins with the first token that would not fit.
FRAGMENTS = r""",
next_start AS MATERIALIZED (
  SELECT t.doc_id, t.field, t.byte_from AS start, greatest(n.byte_from, t.own_next) AS after
  FROM (SELECT *, byte_from + 300 AS full_at, lead(byte_from) OVER (PARTITION BY doc_id, field ORDER BY ord) AS own_next FROM tokens) t
  ASOF JOIN tokens n ON t.doc_id = n.doc_id AND t.field = n.field AND t.full_at < n.byte_to),
frag(doc_id, field, fragment, start) AS (
  SELECT doc_id, field, 0, 0::BIGINT FROM tokens WHERE ord = 0
  UNION ALL
  SELECT f.doc_id, f.field, f.fragment + 1, x.after
  FROM frag f JOIN next_start x ON x.doc_id = f.doc_id AND x.field = f.field AND x.start = f.start WHERE x.after > f.start),
placed AS MATERIALIZED (
  SELECT t.*, f.fragment, f.start
  FROM tokens t ASOF JOIN frag f ON t.doc_id = f.doc_id AND t.field = f.field AND t.byte_from >= f.start)"""

# For the words of one request: the weights, each field's best fragment and its highlighted form.
SNIPPETS = (
    FRAGMENTS
    + r""",
weight AS (SELECT field, token, 1.0 / (1 + df) AS w FROM doc_freq WHERE token IN ('that', 'the') AND field IN ('title', 'content')),
scored_frag AS (
  SELECT doc_id, field, fragment, round(sum(w), 9) AS score
  FROM placed LEFT JOIN weight USING (field, token) GROUP BY ALL HAVING sum(w) > 0),
best AS MATERIALIZED (
  SELECT * FROM scored_frag QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, fragment) = 1),
pieces AS (
  SELECT doc_id, field, ord, w,
         replace(replace(replace(replace(replace(part, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS shown
  FROM placed JOIN best USING (doc_id, field, fragment) LEFT JOIN weight USING (field, token)),
html AS (
  SELECT doc_id, field, string_agg(CASE WHEN w IS NULL THEN shown ELSE '<b>' || shown || '</b>' END, '' ORDER BY ord) AS html
  FROM pieces GROUP BY ALL),
shown AS (
  SELECT doc_id, coalesce(t.html, substr(title, 1, 140)) AS title, coalesce(c.html, substr(content, 1, 140)) AS snippet
  FROM posts LEFT JOIN (SELECT * FROM html WHERE field = 'title') t USING (doc_id)
             LEFT JOIN (SELECT * FROM html WHERE field = 'content') c USING (doc_id))"""
)

# The hits of a whole batch: each request's own weights, best fragments and highlighted texts.
BATCH_HITS = (
    FRAGMENTS
    + r""",
weight AS MATERIALIZED (
  SELECT DISTINCT request_id, field, token, 1.0 / (1 + df) AS w
  FROM clauses JOIN terms USING (kind, word) JOIN doc_freq USING (field, token) WHERE kind = 'text'),
hit_raw AS MATERIALIZED (
  SELECT p.request_id, doc_id, field, fragment, ord, part, token FROM pages_of p JOIN placed USING (doc_id)),
hit_tokens AS MATERIALIZED (
  SELECT request_id, doc_id, field, fragment, ord, part, w FROM hit_raw LEFT JOIN weight USING (request_id, field, token)),
totals AS (SELECT request_id, count(*) AS n FROM matched GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT request_id, doc_id, field, fragment, round(sum(w), 9) AS score FROM hit_tokens GROUP BY ALL HAVING sum(w) > 0)
  QUALIFY row_number() OVER (PARTITION BY request_id, doc_id, field ORDER BY score DESC, fragment) = 1),
pieces AS (
  SELECT request_id, doc_id, field, ord, w,
         replace(replace(replace(replace(replace(part, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS shown
  FROM hit_tokens JOIN best USING (request_id, doc_id, field, fragment)),
html AS (
  SELECT request_id, doc_id, field, string_agg(CASE WHEN w IS NULL THEN shown ELSE '<b>' || shown || '</b>' END, '' ORDER BY ord) AS html
  FROM pieces GROUP BY ALL),
hits AS (
  SELECT request_id, rank, to_json({'category': category,
         'date': strftime(make_timestamp(date_s * 1000000), '%Y-%m-%d %H:%M:%S') || '.0 +00:00:00',
         'snippet': coalesce(c.html, substr(content, 1, 140)), 'tags': tags,
         'title': coalesce(t.html, substr(title, 1, 140)), 'url': url})::VARCHAR AS hit
  FROM pages_of JOIN posts USING (doc_id)
       LEFT JOIN (SELECT * FROM html WHERE field = 'title') t USING (request_id, doc_id)
       LEFT JOIN (SELECT * FROM html WHERE field = 'content') c USING (request_id, doc_id)),
responses AS (
  SELECT request_id, CASE WHEN error IS NOT NULL THEN '{"err_msg": "' || error || '"}'
         ELSE '{"count":' || coalesce(any_value(n), 0) || ',"data":['
              || coalesce(string_agg(hit, ',' ORDER BY rank), '') || ']}' END AS response
  FROM parsed p LEFT JOIN totals USING (request_id) LEFT JOIN hits USING (request_id) GROUP BY p.request_id, error)"""
)

# Cleaning steps over a column `html`.
STRIP = r"regexp_replace(html, '<!.*?>|<div[\s\S]+?/div>|<script.*?/script>|</?[a-zA-Z]+[\s\S]*?>', '', 'g')"
FOLD = rf"regexp_replace({STRIP}, '[\n| \x{{a0}}]+', ' ', 'g')"
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CLEAN = rf"regexp_replace({FOLD}, '^{WHITE}|{WHITE}\z', '', 'g')"
_ENTITIES = {
    "#34": '"', "#39": "''", "#43": "+", "amp": "&", "gt": ">", "hellip": "…", "ldquo": "“",
    "lsquo": "‘", "lt": "<", "ndash": "–", "quot": '"', "rdquo": "”", "rsquo": "’",
}
_A = r"[\x00-\x3a\x3c-\x7f]"


def decoded(sql: str) -> str:
    cases = " ".join(f"WHEN '&{name};' THEN '{char}'" for name, char in _ENTITIES.items())
    pattern = rf"&{_A}{{0,7}};|&{_A}{{7}}(?s:.)|&{_A}{{0,6}}[^\x00-\x7f]|&{_A}{{0,7}}\z|[^&]+"
    return (
        f"array_to_string(list_transform(regexp_extract_all({sql}, '{pattern}'), lambda p: "
        f"CASE WHEN NOT starts_with(p, '&') THEN p "
        f"WHEN ends_with(p, ';') THEN CASE p {cases} ELSE '' END "
        f"WHEN length(p) = 9 THEN substr(p, 2) "
        f"WHEN strlen(right(p, 1)) > 1 THEN right(p, 1) ELSE '' END), '')"
    )


def _one(q: list[str] = (), terms: list[str] = (), range_: list[int] = ()) -> str:
    def array(values, kind: str) -> str:
        return "[" + ", ".join(f"'{v}'" if kind == "VARCHAR" else str(v) for v in values) + f"]::{kind}[]"

    return f""",
requests AS (SELECT 'only' AS request_id, 1 AS page, 8 AS size, {array(range_, "BIGINT")} AS range,
                    {array(terms, "VARCHAR")} AS terms, {array(q, "VARCHAR")} AS q)"""


def _matched(select: str, limit: str = ALL, **request) -> str:
    return f"WITH {INDEX}{_one(**request)}{MATCHED.replace('{excluded_limit}', limit)} {select}"


# One request per conversation turn, as in the Spark inputs.
REQUESTS = r""",
keyed AS (
  SELECT *, list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')),
                                     lambda w: lpad(length(w)::VARCHAR, 6, '0') || w)) AS keys,
         (conv_id + turn) % 8 AS kind, 1577836800 + (conv_id * 7 % 1000) * 86400 AS day_lo
  FROM conversations),
chosen AS (
  SELECT *, coalesce(substr(keys[1], 7), '') AS w1, coalesce(substr(keys[2], 7), '') AS w2,
         coalesce(substr(keys[-1], 7), '') AS w_long, regexp_extract(lower(text), '[a-z]+ [a-z]+') AS pair
  FROM keyed),
requests AS (
  SELECT conv_id || '-' || turn AS request_id, 1 + turn % 2 AS page,
         CASE WHEN conv_id % 50 = 13 THEN 0 ELSE 3 + conv_id % 5 END AS size,
         CASE WHEN kind = 5 THEN [day_lo, day_lo + (turn + 1) * 3456000 + 3600]
              WHEN kind = 7 THEN [0, day_lo] ELSE []::BIGINT[] END AS range,
         CASE WHEN kind = 3 THEN ['category:' || ['EN', 'fr', 'de', 'es'][conv_id % 4 + 1]]
              WHEN kind = 4 THEN ['tags:SRC' || (conv_id % 20), 'tags:quality']
              WHEN kind = 7 THEN ['foo:bar'] ELSE []::VARCHAR[] END AS terms,
         CASE WHEN kind = 0 THEN [w1, w2] WHEN kind = 1 THEN [w1, '-' || w2] WHEN kind = 2 THEN [pair]
              WHEN kind = 3 THEN [w1, '-' || w2, '-' || w_long]
              WHEN kind = 6 AND turn % 2 = 0 THEN ['-' || w1] WHEN kind = 7 THEN [w1] ELSE []::VARCHAR[] END AS q
  FROM chosen)"""

_BATCH = f"WITH {INDEX}{REQUESTS}{MATCHED.replace('{excluded_limit}', ALL)}"


def _unlabelled(select: str) -> str:
    return f"WITH {POSTS} SELECT {select} FROM posts p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id)"


_WORDS = ["that", "the"]

_RESPONSES = f"WITH RECURSIVE {INDEX}{REQUESTS}{MATCHED.replace('{excluded_limit}', ALL)}{BATCH_HITS} SELECT request_id, response FROM responses"

# The same requests as lines: dates cut to days and always a range, words cut at spaces.
_LINES = (
    REQUESTS.replace("requests AS (", "typed AS (")
    + r""",
requests AS (
  SELECT request_id, page, size, [coalesce(range[1] // 86400 * 86400, 0), coalesce(range[2] // 86400 * 86400, 0)] AS range,
         string_split(array_to_string(terms, ' '), ' ') AS terms, string_split(replace(array_to_string(q, ' '), ',', ''), ' ') AS q
  FROM typed),
lines AS (
  SELECT request_id, page || '-' || size || ','
         || CASE WHEN range[1] > 0 THEN strftime(make_timestamp(range[1] * 1000000), '%Y-%m-%d') ELSE '' END || '~'
         || CASE WHEN range[2] > 0 THEN strftime(make_timestamp(range[2] * 1000000), '%Y-%m-%d') ELSE '' END || ','
         || array_to_string(terms, ' ') || ',' || replace(array_to_string(q, ' '), ',', '') AS line
  FROM typed)"""
)

ORACLES = {
    "feed_scan": f"""WITH {FED} SELECT url AS href, title,
        strftime(make_timestamp(date_s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS published,
        array_to_string([category] || list_transform(tags, lambda t: upper(t)), ',') AS terms, content FROM fed""",
    "feed_posts": f"""WITH {FED} SELECT url, title, {decoded(CLEAN.replace("(html,", "(content,"))} AS content, date_s, category,
        array_to_string(tags, ',') AS tags FROM fed""",
    "load_new_only": _unlabelled("doc_id, url, title, date_s, array_to_string(tags, ',') AS tags"),
    "load_report": """SELECT 1 AS load, count(*) AS added FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 2, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "feed_quarantine": f"""WITH {POSTS} SELECT url, 'bad publish time' AS problem,
        strftime(make_timestamp(date_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS raw_published, title FROM posts WHERE regexp_matches(url, '[0369]$')""",
    "url_split": r"""SELECT page_id, regexp_matches(url, 'https://(.*?)(/.*)') AS ok,
        regexp_extract(url, 'https://(.*?)(/.*)', 1) AS host, regexp_extract(url, 'https://(.*?)(/.*)', 2) AS path FROM pages""",
    "html_strip": f"SELECT page_id, {STRIP} AS text FROM pages",
    "html_clean": f"SELECT page_id, {CLEAN} AS text FROM pages",
    "entity_decode": f"SELECT page_id, {decoded('html')} AS text FROM pages",
    "clean_pages": f"""SELECT *, length(text) AS n_chars FROM (
        SELECT page_id, {decoded("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title,
               {decoded(CLEAN)} AS text FROM pages)""",
    "published_parse": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(epoch(ts))::BIGINT - 28800
        WHEN 1 THEN floor(epoch(ts))::BIGINT + 19800 WHEN 2 THEN NULL ELSE 0 END AS published_s FROM events""",
    "tag_normalise": "SELECT doc_id, lower(source) || ',' || lower(lang) AS tags FROM documents",
    "day_to_epoch": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate::DATE)::BIGINT ELSE 0 END AS day_s
        FROM orders""",
    "tokenize": f"""WITH {POSTS} SELECT doc_id,
        array_to_string(list_transform(regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]'), lambda t: lower(t)), '¦') AS title_tokens,
        array_to_string(list_transform(regexp_extract_all(content, '[A-Za-z]+|[^A-Za-z]'), lambda t: lower(t)), '¦') AS content_tokens
        FROM posts""",
    "token_offsets": f"""WITH {TOKENS} SELECT doc_id, field, token, count(*) AS n, min(byte_from) AS first_from,
        max(byte_to) AS last_to, sum(byte_from)::BIGINT AS sum_from, sum(ord)::BIGINT AS sum_ord FROM tokens GROUP BY ALL""",
    "postings": f"WITH {INDEX} SELECT field, token, doc_id, dl, tf, positions FROM postings",
    "doc_freq": f"WITH {INDEX} SELECT field, token, df FROM doc_freq",
    "field_stats": f"WITH {INDEX} SELECT field, n_docs, total_len, round(avgdl, 6) AS avgdl FROM field_stats",
    "term_match": _matched("SELECT doc_id, field, tf FROM scored", q=["that"]),
    "phrase_match": _matched("SELECT doc_id, field, tf FROM scored", q=["of the"]),
    "any_field": _matched("SELECT DISTINCT doc_id FROM scored", q=["of the"]),
    "all_words": _matched("SELECT doc_id, score FROM matched", q=_WORDS),
    "exclude_words": _matched("SELECT doc_id, score FROM matched", q=["the", "-that", "-with"]),
    "exclude_any_word": _matched("SELECT doc_id, score FROM matched", limit="1", q=["the", "-that", "-with"]),
    "tag_filter": f"""WITH {POSTS} SELECT doc_id FROM posts
        WHERE list_contains(tags, 'src1') AND list_contains(tags, 'quality')""",
    "category_filter": "SELECT doc_id FROM documents WHERE lang = 'en'",
    "category_any_case": _matched("SELECT doc_id, score FROM matched", q=["the"], terms=["category:EN"]),
    "filter_parse": "SELECT doc_id, 'tags=' || lower(source) || ';category=a:' || lang AS filters FROM documents",
    "date_range": f"WITH {POSTS} SELECT doc_id, date_s FROM posts WHERE date_s BETWEEN 1600000000 AND 1610000000",
    "combined_search": _matched(
        "SELECT doc_id, score FROM matched",
        q=["the", "-that"],
        terms=["category:en", "tags:quality"],
        range_=[1590000000, 0],
    ),
    "request_errors": f"WITH {REQUESTS.lstrip(',')}{PARSED} SELECT request_id, error FROM parsed",
    "bm25_topk": _matched("SELECT doc_id, score FROM ranked WHERE rank <= 8", q=_WORDS),
    "page_two": _matched("SELECT doc_id, score FROM ranked WHERE rank BETWEEN 9 AND 16", q=["of the"]),
    "browse_newest": f"WITH {POSTS} SELECT doc_id, date_s FROM posts ORDER BY date_s DESC, doc_id LIMIT 8",
    "hit_count": _matched("SELECT count(*) AS hits FROM matched", q=_WORDS),
    "fragments": f"""WITH RECURSIVE {TOKENS}{FRAGMENTS} SELECT doc_id, field, fragment, min(byte_from) AS byte_from,
        max(byte_to) AS byte_to, string_agg(part, '' ORDER BY ord) AS text FROM placed GROUP BY ALL""",
    "best_fragment": f"""WITH RECURSIVE {INDEX}{SNIPPETS}
        SELECT doc_id, field, fragment, string_agg(part, '' ORDER BY ord) AS text, round(any_value(score), 6) AS score
        FROM placed JOIN best USING (doc_id, field, fragment) GROUP BY ALL""",
    "snippet_html": f"WITH RECURSIVE {INDEX}{SNIPPETS} SELECT doc_id, title, snippet FROM shown",
    "excerpt": "SELECT doc_id, substr(text, 1, 140) AS excerpt FROM documents",
    "date_text": f"""WITH {POSTS} SELECT doc_id,
        strftime(make_timestamp(date_s * 1000000), '%Y-%m-%d %H:%M:%S') || '.0 +00:00:00' AS date FROM posts""",
    "search_hits": f"""WITH RECURSIVE {INDEX}{_one(q=_WORDS)}{MATCHED.replace("{excluded_limit}", ALL)}{SNIPPETS}
        SELECT rank, doc_id, score, url, strftime(make_timestamp(date_s * 1000000), '%Y-%m-%d %H:%M:%S') || '.0 +00:00:00' AS date,
               s.title, snippet, category, array_to_string(tags, ',') AS tags
        FROM pages_of JOIN posts USING (doc_id) JOIN shown s USING (doc_id)""",
    "batch_search": f"{_BATCH} SELECT request_id, rank, doc_id, score FROM pages_of",
    "batch_counts": f"""{_BATCH} SELECT request_id, count(doc_id) AS total FROM parsed LEFT JOIN matched USING (request_id)
        WHERE error IS NULL GROUP BY ALL""",
    "response_json": _RESPONSES,
    "stream_search": _RESPONSES,
    "line_search": f"""WITH RECURSIVE {INDEX}{_LINES}{MATCHED.replace('{excluded_limit}', ALL)}{BATCH_HITS}
        SELECT line, response FROM responses JOIN lines USING (request_id)""",
    "stream_ingest": f"""WITH {FED} SELECT url, title, {decoded(CLEAN.replace("(html,", "(content,"))} AS content, date_s, category,
        array_to_string(tags, ',') AS tags FROM fed""",
    "rebuild": f"""WITH {POSTS} SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url, 1 AS n_loads FROM posts""",
    "request_lines": r"""WITH lines AS (
          SELECT conv_id || '-' || turn AS request_id, turn, regexp_replace(text, '[,\n]', ' ', 'g') AS t,
                 1577836800 + (conv_id % 900) * 86400 AS day_s
          FROM conversations)
        SELECT request_id, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS page,
               CASE turn % 4 WHEN 0 THEN 8 WHEN 1 THEN 5 END AS size,
               CASE turn % 4 WHEN 0 THEN day_s || '~1640995200' WHEN 1 THEN '0~0' WHEN 2 THEN '0~' || day_s ELSE '' END AS range,
               CASE turn % 4 WHEN 0 THEN 'tags:src1 category:EN' ELSE '' END AS terms,
               CASE WHEN turn % 4 < 3 THEN array_to_string(list_filter(string_split(t, ' '), lambda w: w <> ''), ' ') ELSE '' END AS q,
               CASE WHEN turn % 4 >= 2 THEN 'Invalid Arguments. ' END AS error
        FROM lines""",
}
