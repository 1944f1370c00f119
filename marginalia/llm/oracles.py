"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from marginalia.llm.archive import BASE32
from marginalia.llm.quality import FLOORS, RATIO, SHIFT, UNIT

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _quality() -> str:
    shares = {
        "symbol_share": "coalesce(n_symbols / nullif(word_chars, 0), 0.0)",
        "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)",
        "repeat_share": "coalesce(n_repeat_words / nullif(n_words, 0), 0.0)",
        "chars_per_word": "coalesce(word_chars / nullif(n_words, 0), 0.0)",
    }
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {v}::DOUBLE AS x FROM base" for k, v in shares.items())
    floors = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items())

    def level(name: str, by: str, parent: str, on: str) -> str:
        """Sketches of one level, with 100 documents' worth of the parent's added."""
        return f"""{name}_g AS (SELECT DISTINCT {by}, rule FROM sketch),
{name} AS (SELECT {by}, rule, bucket, sum(n) AS n FROM (SELECT {by}, rule, bucket, {UNIT} * n AS n FROM sketch
    UNION ALL SELECT {", ".join("g." + c for c in by.split(", "))}, g.rule, p.bucket, ({100 * UNIT} * p.n) // p.total FROM {name}_g g
        JOIN (SELECT *, sum(n) OVER (PARTITION BY {on}rule) AS total FROM {parent}) p ON g.rule = p.rule {"AND g.lang IS NOT DISTINCT FROM p.lang" if on else ""}) GROUP BY ALL)"""

    return f"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
long AS ({long}),
sketch AS (SELECT lang, source, rule, ceil(round(ln(x + {SHIFT}::DOUBLE) / ln({RATIO}::DOUBLE), 6))::INT AS bucket, count(*) AS n FROM long GROUP BY ALL),
whole AS (SELECT rule, bucket, {UNIT} * sum(n) AS n FROM sketch GROUP BY ALL),
{level("tongue", "lang", "whole", "")},
{level("own", "lang, source", "tongue", "lang, ")},
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total,
    greatest(0.0, pow({RATIO}::DOUBLE, bucket) - {SHIFT}::DOUBLE) AS v FROM own),
quarts AS (SELECT lang, source, rule, min(v) FILTER (WHERE 4 * upto >= total) AS q1, min(v) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM ranked GROUP BY ALL),
fence AS (SELECT lang, source, rule, greatest(CASE rule {floors} ELSE 0.0 END, q3 + 6 * (q3 - q1)) AS fence FROM quarts),
wide AS (SELECT lang, source, {", ".join(f"max(fence) FILTER (WHERE rule = '{k}') AS f_{k}" for k in shares)} FROM fence GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({" OR ".join(f"{v} > f_{k}" for k, v in shares.items())}) AS kept
FROM base LEFT JOIN wide ON base.lang IS NOT DISTINCT FROM wide.lang AND base.source IS NOT DISTINCT FROM wide.source
"""


def _warc() -> str:
    parts = "".join(
        f"|| substr('{BASE32}', ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
WITH summed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, payload_bytes, '' {parts} AS payload_digest FROM summed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM named)
"""


_NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, hash(list_slice(w, i, i + 2)) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, hash(w) FROM words WHERE len(w) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""


def _chat() -> str:
    from marginalia.llm.chat import CONTROLS, DONE, SAYS, SIGN, TURN

    def escaped(c: str) -> str:
        c = f"replace({c}, '{SIGN}', '{SIGN}0')"
        for i, control in enumerate(CONTROLS):
            c = f"replace({c}, '{control}', '{SIGN}{chr(97 + i)}')"
        return c

    marks = len(TURN) + len(SAYS) + len(DONE)
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length({escaped("role")}) + length({escaped("text")}) + {marks})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _audit() -> str:
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS {0}(f, bit)"
    names = ["l1", "l2", "l3", "l4", "l5"]
    apart = " AND ".join(f"{a}.bit <> {b}.bit" for i, a in enumerate(names) for b in names[i + 1 :])
    steps = " UNION ALL ".join(
        f"SELECT o, {i + 1} AS step, b{i + 1} AS bit, {' + '.join(['0', *[f'b{j + 1}' for j in range(i)]])} AS earlier FROM orders" for i in range(5)
    )
    return rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM words LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM masks GROUP BY ALL),
orders AS (SELECT concat({", ".join(f"{a}.f" for a in names)}) AS o, {", ".join(f"{a}.bit AS b{i + 1}" for i, a in enumerate(names))}
    FROM {", ".join(letters.format(a) for a in names)} WHERE {apart}),
steps AS ({steps}),
each AS (SELECT part, o, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM counted, steps GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM each
"""


def _centroids(k: int = 40, rounds: int = 5) -> str:
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

    def nearest(i: int) -> str:
        return f"near{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(p.v) AS v, min({{'d': {distance}, 'c': c.c}}) AS best FROM points p, centre{i} c GROUP BY r)"

    def centre(i: int) -> str:
        return f"""sums{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{i - 1}) GROUP BY c, i),
centre{i} AS MATERIALIZED (SELECT old.c, coalesce(new.v, old.v) AS v FROM centre{i - 1} old LEFT JOIN
    (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{i} GROUP BY c) new USING (c))"""

    steps = ",\n".join(f"{nearest(i - 1)},\n{centre(i)}" for i in range(1, rounds + 1))
    return f"""
WITH points AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centre0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM points) WHERE c < {k}),
{steps},
{nearest(rounds)}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(centre{rounds}.v, ',')) AS centroid_sha256 FROM near{rounds} JOIN centre{rounds} ON best.c = centre{rounds}.c
"""


ORACLES: dict[str, str] = {
    "op1_quality": _quality(), "op3_warc": _warc(), "op5_near_duplicates": _NEAR, "op9_chat": _chat(),
    "op11_filter_audit": _audit(), "op12_centroids": _centroids(),
}
