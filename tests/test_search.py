"""Searches over a small corpus against brute force, the request checks and the quirks that are kept."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from test_tokens import cut_by_hand

from marginalia.operators import index as ix
from marginalia.operators import joins, match
from marginalia.operators.joins import Stage
from marginalia.plans import search as search_plan
from marginalia.plans.search import search as run_search
from marginalia.schema import POSTS, REQUESTS
from marginalia.sources import requests as rq
from marginalia.sources.store import Store
from marginalia.streaming.search import start_search, stream_requests

DAY = 86400


def make_posts(spark, rows):
    """rows: title, content, date seconds, category, tags."""
    data = [(i, t, c, f"u{i}", d, k, g) for i, (t, c, d, k, g) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "doc_id long, title string, content string, url string, s long, category string, tags array<string>"
    )
    return df.select("doc_id", "title", "content", "url", F.timestamp_seconds("s").alias("date"), "category", "tags")


def random_rows(n=120, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "cat", "dog", "c++", "İx", "数据", "don't", "naïve", "a", "The", "x<y", "&"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", ""]) for _ in range(k))
    return [
        (
            text(rng.randint(0, 4)),
            text(rng.randint(0, 120)),
            rng.choice([0, 5 * DAY, 5 * DAY + 1, rng.randint(0, 40 * DAY)]),
            rng.choice(["en", "Code", ""]),
            rng.sample(["red", "blue", "green"], rng.randint(0, 3)),
        )
        for _ in range(n)
    ]


class Brute:
    """The whole search written plainly over Python lists."""

    def __init__(self, rows):
        self.rows = rows
        self.toks = {f: [self.cut(r[i]) for r in rows] for i, f in enumerate(("title", "content"))}
        self.n = len(rows)

    @staticmethod
    def cut(s):
        at, out = 0, []
        for t in cut_by_hand(s):
            out.append((t.lower(), at, t))
            at += len(t.encode())
        return out

    def df(self, field, token):
        return sum(any(t == token for t, _, _ in d) for d in self.toks[field])

    def idf(self, df):
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def part(self, idf, tf, dl, avg):
        return idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    def word(self, i, word):
        """Score part of a word in document i, None when no field matches."""
        total, hit = 0.0, False
        at, terms = 0, []
        for t in cut_by_hand(word):
            terms.append((t, at))
            at += len(t.encode())
        for field in ("title", "content"):
            doc = self.toks[field][i]
            places = {}
            for t, p, _ in doc:
                places.setdefault(t, set()).add(p)
            tf = sum(all(p + o in places.get(t, ()) for t, o in terms) for p in places.get(terms[0][0], ()))
            if tf:
                hit = True
                avg = sum(len(d) for d in self.toks[field]) / self.n
                total += self.part(sum(self.idf(self.df(field, t)) for t, _ in terms), tf, len(doc), avg)
        return total if hit else None

    def exact(self, i, field, value):
        values = lambda r: r[4] if field == "tags" else [r[3]]
        if value not in values(self.rows[i]):
            return None
        df = sum(value in values(r) for r in self.rows)
        avg = sum(len(values(r)) for r in self.rows) / self.n
        return self.part(self.idf(df), 1, len(values(self.rows[i])), avg)

    def search(self, page, size, range_, terms, q, exclude="all"):
        must = [w.lower() for w in q if not w.startswith("-")]
        out = [w[1:].lower() for w in q if w.startswith("-")]
        filters = [t.split(":", 1) for t in terms if t.split(":")[0] in ("tags", "category")]
        found = []
        for i, row in enumerate(self.rows):
            parts = [self.word(i, w) for w in must] + [self.exact(i, f, v.lower()) for f, v in filters]
            gone = [self.word(i, w) is not None for w in out]
            inside = not range_ or (
                (range_[0] == 0 or row[2] >= range_[0]) and (range_[1] == 0 or row[2] <= range_[1])
            )
            if None in parts or not inside or (gone and (all(gone) if exclude == "all" else any(gone))):
                continue
            score = round(sum(parts) + (1.0 if range_ else 0.0), 4)
            found.append((score if must else row[2], i))
        found.sort(key=lambda x: (-x[0], x[1]))
        return len(found), [i for _, i in found[(page - 1) * size : page * size]]

    def snippet(self, i, field, q):
        text = self.rows[i][0 if field == "title" else 1]
        weight = {}
        for w in q:
            for t in cut_by_hand(w.lstrip("-").lower() if w.startswith("-") else w.lower()):
                if self.df(field, t):
                    weight[t] = 1 / (1 + self.df(field, t))
        frags, start, score, toks = [], 0, 0.0, []
        for t, at, raw in self.toks[field][i]:
            if at + len(raw.encode()) - start > 300:
                frags.append((score, toks))
                start, score, toks = at, 0.0, []
            score = round(score + weight.get(t, 0.0), 9)
            toks.append((t, raw))
        frags.append((score, toks))
        best = max(frags, key=lambda f: f[0])
        if best[0] == 0:
            return text[:140]
        esc = lambda s: s.translate({38: "&amp;", 60: "&lt;", 62: "&gt;", 34: "&quot;", 39: "&#x27;"})
        return "".join(f"<b>{esc(r)}</b>" if t in weight else esc(r) for t, r in best[1])


REQUEST_LIST = [
    (1, 5, [], [], ["the"]),
    (2, 5, [], [], ["the"]),
    (1, 200, [], [], ["the", "of"]),
    (1, 9, [], [], ["the", "the"]),
    (1, 9, [], [], ["of the"]),
    (1, 9, [], [], ["c++"]),
    (1, 9, [], [], ["the the"]),
    (1, 9, [], [], ["İx"]),
    (1, 9, [], [], ["数据"]),
    (1, 9, [], [], ["DON'T", "cat"]),
    (1, 9, [], [], ["the", "-cat"]),
    (1, 9, [], [], ["the", "-cat", "-dog"]),
    (1, 9, [], [], ["the", "-don't"]),
    (1, 9, [], [], ["the", "-nosuchword"]),
    (1, 9, [], [], ["nosuchword"]),
    (1, 9, [], ["tags:RED"], []),
    (1, 9, [], ["tags:red", "tags:blue"], []),
    (1, 9, [], ["tags:red", "tags:red"], ["the"]),
    (1, 9, [], ["category:EN"], []),
    (1, 9, [], ["category:Code"], []),
    (1, 9, [], ["category:"], ["cat"]),
    (1, 9, [], ["foo:bar"], ["cat"]),
    (1, 7, [0, 0], [], []),
    (3, 7, [0, 0], [], []),
    (1, 7, [5 * DAY, 0], [], []),
    (1, 7, [5 * DAY + 1, 20 * DAY], [], []),
    (1, 7, [0, 5 * DAY], [], []),
    (2, 50, [1, 30 * DAY + 77], [], []),
    (1, 7, [20 * DAY, 10 * DAY], [], []),
    (1, 7, [900 * DAY, 0], [], []),
    (1, 7, [5 * DAY, 20 * DAY], ["tags:red"], ["the", "-cat"]),
    (1, 7, [5 * DAY, 20 * DAY], ["tags:red"], []),
    (9999, 7, [0, 0], [], []),
    (9999, 7, [], [], ["the"]),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = random_rows()
    posts = make_posts(spark, rows)
    store = Store(spark, str(tmp_path_factory.mktemp("s") / "store"))
    store.add(posts.where("doc_id < 70"))
    store.add(posts.where("doc_id >= 70"))
    return Brute(rows), store, posts


def table(spark, requests):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(requests)], REQUESTS)


def search(requests, index, exclude="all", staged=True):
    return run_search(requests, index, exclude, Stage(requests.sparkSession) if staged else None)


def answers(result):
    return {r.request_id: json.loads(r.response) for r in result.responses.collect()}


@pytest.mark.parametrize("exclude", ["all", "any"])
def test_batch_equals_brute_force(spark, corpus, exclude):
    brute, store, _ = corpus
    got = answers(search(table(spark, REQUEST_LIST), store.index(), exclude))
    for i, request in enumerate(REQUEST_LIST):
        count, ids = brute.search(*request, exclude=exclude)
        answer = got[str(i)]
        assert (answer["count"], [int(h["url"][1:]) for h in answer["data"]]) == (count, ids), request
        for d, hit in zip(ids, answer["data"]):
            assert hit["title"] == brute.snippet(d, "title", request[4])
            assert hit["snippet"] == brute.snippet(d, "content", request[4])
            assert hit["tags"] == brute.rows[d][4] and hit["category"] == brute.rows[d][3]


def test_derived_index_gives_the_same(spark, corpus):
    _, store, posts = corpus
    requests = table(spark, REQUEST_LIST[:14])
    assert answers(search(requests, ix.from_posts(posts), staged=False)) == answers(search(requests, store.index()))


def test_single_requests_equal_the_batch(spark, corpus):
    _, store, _ = corpus
    whole = answers(search(table(spark, REQUEST_LIST), store.index()))
    for i in (4, 11, 22, 30):
        one = table(spark, REQUEST_LIST).where(F.col("request_id") == str(i))
        assert answers(search(one, store.index()))[str(i)] == whole[str(i)]


def test_deep_pages_give_the_same(spark, corpus, monkeypatch):
    """With every page taken for a deep one."""
    brute, store, _ = corpus
    monkeypatch.setattr("marginalia.plans.search.DEEP", 0)
    got = answers(search(table(spark, REQUEST_LIST), store.index()))
    for i, request in enumerate(REQUEST_LIST):
        count, ids = brute.search(*request)
        assert (got[str(i)]["count"], [int(h["url"][1:]) for h in got[str(i)]["data"]]) == (count, ids), request


@pytest.mark.parametrize("rows", [1, 7, 200_000])
def test_split_hot_keys_give_the_same(spark, corpus, monkeypatch, rows):
    """Frequent keys are split by their counts, whatever the number of partitions."""
    _, store, _ = corpus
    want = answers(search(table(spark, REQUEST_LIST), store.index()))
    monkeypatch.setattr(joins, "PIECE_ROWS", rows)
    monkeypatch.setattr("marginalia.plans.search.BROADCAST_CLAUSES", 0)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert answers(search(table(spark, REQUEST_LIST), store.index())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_key_of_all_rows_is_split_by_its_count(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE_ROWS", 100)
    big = spark.range(20_000).select(F.when(F.col("id") % 50 > 0, F.lit("the")).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("k"), F.col("id").alias("doc_id"))
    sizes = big.groupBy("k").agg(F.count("*").alias("rows"))
    assert [tuple(r) for r in joins.splits(sizes, ["k"]).collect()] == [("the", 196)]
    small = spark.createDataFrame([("the", 1), ("the", 2), ("w50", 3), ("none", 4)], "k string, x int")
    got = joins.spread_join(small, big, ["k"], "doc_id", sizes=sizes)
    assert got.count() == 2 * 19_600 + 1 and got.columns == ["k", "doc_id", "x"]
    # of a table in which every key is frequent only so many are split as may be broadcast
    monkeypatch.setattr(joins, "SPLIT_KEYS", 10)
    even = spark.range(1000).select(F.col("id").alias("k"), F.lit(1000).alias("rows"))
    assert joins.splits(even, ["k"]).count() == 0
    assert joins.splits(even.union(spark.range(1).select(F.lit(-1), F.lit(10**7))), ["k"]).count() <= 10


def browse(spark, posts_at, asked, **options):
    """Pages of date-only requests over posts of these seconds, and by sorting."""
    posts = make_posts(spark, [("t", "c", s, "k", []) for s in posts_at])
    rows = [(str(i), page, size, list(r), [], []) for i, (page, size, r) in enumerate(asked)]
    result = run_search(spark.createDataFrame(rows, REQUESTS), ix.from_posts(posts), stage=Stage(spark), **options)
    got, totals = {str(i): [] for i in range(len(asked))}, {r.request_id: r.total for r in result.totals.collect()}
    for r in result.pages.where("rank > 0").orderBy("rank").collect():
        got[r.request_id].append(r.doc_id)
    order = sorted(range(len(posts_at)), key=lambda i: (-posts_at[i], i))
    for i, (page, size, (lo, hi)) in enumerate(asked):
        inside = [d for d in order if (not lo or posts_at[d] >= lo) and (not hi or posts_at[d] <= hi)]
        assert totals[str(i)] == len(inside), asked[i]
        assert got[str(i)] == inside[(page - 1) * size : page * size], asked[i]
    return result


def test_browsing_a_long_calendar(spark):
    """Posts of 1970 and of 2100: rows follow the pages, not the days between."""
    rng = random.Random(3)
    far = 130 * 365 * DAY
    posts_at = [0, 5, DAY - 1, DAY, far, far + 9, far + DAY] + [rng.choice([40, 41, 9000]) * DAY + rng.randrange(DAY) for _ in range(300)]
    ranges = [(0, 0), (1, 0), (0, far), (DAY, far), (3, 5), (5, 5), (6, DAY - 2), (40 * DAY + 7000, 41 * DAY + 9000), (40 * DAY, 40 * DAY + DAY - 1), (2 * DAY, 3 * DAY),
              (far + 1, far + 8), (far + DAY + 1, 0), (0, 3), (9000 * DAY + 5, 9000 * DAY + 80_000), (50, 40), (-5 * DAY, 1)]
    asked = [(p, n, r) for r in ranges for p, n in ((1, 8), (2, 5), (3, 40), (1, 1000), (4, 1), (10**6, 7))]
    browse(spark, posts_at, asked)


def test_many_equal_requests_are_answered_once(spark, corpus):
    _, store, posts = corpus
    index = store.index()
    rows = [(f"r{i}", 1, 5, [0, 0], [], []) for i in range(3000)] + [(f"q{i}", 1, 3, [], [], ["the", "of"] if i % 2 else ["of", "the"]) for i in range(2000)]
    kept = {}

    class Kept(Stage):
        def __call__(self, df, name):
            kept[name] = super().__call__(df, name)
            return kept[name]

    result = run_search(spark.createDataFrame(rows, REQUESTS), index, stage=Kept(spark))
    assert kept["different"].count() == 2 and kept["pages"].where("rank > 0").count() == 8
    got = answers(result)
    assert len(got) == 5000 and len({json.dumps(v) for k, v in got.items() if k[0] == "r"}) == 1 and len({json.dumps(v) for k, v in got.items() if k[0] == "q"}) == 1
    assert result.hits.count() == 3000 * 5 + 2000 * 3


def test_a_deep_page_inside_one_second(spark, monkeypatch):
    """All posts in one day, most in one second: what is ranked stays near the page."""
    monkeypatch.setattr("marginalia.plans.search.DEEP", 50)
    n = 20_000
    posts_at = [7 * DAY + (100 if i % 10 else i % 60) for i in range(n)]
    ranked = []
    top = search_plan.top_in_slots

    def noted(matches, order, depth):
        ranked.append(matches.groupBy("request_id").count().agg(F.max("count")).first()[0])
        return top(matches, order, depth)

    monkeypatch.setattr(search_plan, "top_in_slots", noted)
    browse(spark, posts_at, [(1900, 10, (0, 0)), (500, 10, (7 * DAY + 3, 7 * DAY + 100)), (1, 20, (0, 0))])
    assert max(x for x in ranked if x) <= n  # the shallow page's day as a whole
    ranked.clear()
    browse(spark, posts_at, [(1900, 10, (0, 0)), (500, 10, (7 * DAY + 3, 7 * DAY + 100))])
    assert max(x for x in ranked if x) <= 10 + 2 * 1024


@pytest.mark.parametrize("word", ["of the", "c++", "the the", "don't", "x<y", ", "])
def test_positions_agree_with_a_regex_over_the_text(spark, corpus, word):
    _, store, posts = corpus
    index = store.index()
    words = spark.createDataFrame([("text", word)], "kind string, word string")
    got = {
        (r.doc_id, r.tf)
        for r in match.field_matches(index, match.lookups(words, index)).where("field = 'content'").collect()
    }
    # İ is the one letter whose lower case cuts differently; leave it out of the text compared.
    pattern = match.phrase_pattern(word)
    overlapping = pattern[: pattern.index(")") + 1] + f"(?={pattern[pattern.index(')') + 1 :]})" if pattern.startswith("(?<!") else f"(?={pattern})"
    lowered = F.lower(F.replace("content", F.lit("İ"), F.lit("é")))
    want = posts.select("doc_id", F.regexp_count(lowered, F.lit(overlapping)).alias("n")).where("n > 0").collect()
    assert got == {(r.doc_id, r.n) for r in want}


def test_byte_positions_decide(spark, tmp_path):
    """Ⱥ takes two bytes, its lower case three: the phrase is looked for three bytes on."""
    store = Store(spark, str(tmp_path / "store"))
    store.add(make_posts(spark, [("", "Ⱥ1x", 0, "", []), ("", "Ⱥx", 0, "", []), ("", "ⱥx", 0, "", [])]))
    got = answers(search(table(spark, [(1, 9, [], [], ["Ⱥx"])]), store.index()))["0"]
    assert sorted(h["url"] for h in got["data"]) == ["u0", "u2"]


ERRORS = [
    ((1, 3, [], [], ["-the"]), rq.ONLY_EXCLUDING),
    ((1, 3, [0, 0], ["tags:red"], ["-the"]), rq.ONLY_EXCLUDING),
    ((1, 3, [], [], ["-"]), rq.ONLY_EXCLUDING),
    ((1, 3, [], [], []), rq.EMPTY_QUERY),
    ((1, 3, [], [], ["", ""]), rq.EMPTY_QUERY),
    ((1, 3, [], ["foo:bar"], []), rq.EMPTY_QUERY),
    ((0, 3, [], [], ["the"]), rq.INVALID),
    ((1, 0, [], [], ["the"]), rq.INVALID),
    ((None, 3, [], [], ["the"]), rq.INVALID),
    ((1, 3, [7], [], ["the"]), rq.INVALID),
    ((1, 3, [], [], ["the", "-"]), rq.INVALID),
    ((1, 3, [], ["tags"], ["the"]), rq.INVALID),
    ((1, 3, [], [], ["the", ""]), None),
    ((1, 3, [], ["tags:a:b"], []), None),
    ((1, 3, [0, 0], [], []), None),
]


def test_request_checks(spark):
    parsed = rq.parse(table(spark, [r for r, _ in ERRORS])).collect()
    assert {r.request_id: r.error for r in parsed} == {str(i): e for i, (_, e) in enumerate(ERRORS)}


def test_error_text(spark, corpus):
    got = search(table(spark, [ERRORS[0][0]]), corpus[1].index()).responses.first().response
    assert got == '{"err_msg": "It is forbidden queries that are only `excluding`."}'


LINES = [
    ("1-8,2020-01-01~2021-01-01,tags:src1,the  cat", (1, 8, [1577836800, 1609459200], ["tags:src1"], ["the", "cat"], None)),
    ("1-8,~,,the\r", (1, 8, [0, 0], [""], ["the"], None)),
    ("1-8,,,the", (1, 8, [0], [""], ["the"], None)),
    ("1,~,,the", (1, None, [0, 0], [""], ["the"], None)),
    ("x-8,~,,the", (None, None, [0, 0], [""], ["the"], rq.INVALID)),
    ("1-8,~,the", (None, None, [], [], [], rq.INVALID)),
    ("1-8,~,,the,cat", (None, None, [], [], [], rq.INVALID)),
    ("", (None, None, [], [], [], rq.INVALID)),
]


def test_request_lines(spark):
    df = spark.createDataFrame([(str(i), line) for i, (line, _) in enumerate(LINES)], "request_id string, line string")
    got = {r.request_id: tuple(r)[1:] for r in rq.from_lines(df).collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(LINES)}


def test_streamed_requests_see_each_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add(make_posts(spark, [("", "one cat", 0, "", [])]))
    inbox, out, state = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def ask(name):
        request = {"request_id": name, "page": 1, "size": 3, "range": [], "terms": [], "q": ["cat"]}
        (inbox / f"{name}.json").write_text(json.dumps(request))
        start_search(store, stream_requests(spark, str(inbox)), out, state).awaitTermination()
        return {r.request_id: json.loads(r.response)["count"] for r in spark.read.parquet(out).collect()}

    assert ask("first") == {"first": 1}
    store.add(make_posts(spark, [("", "-", 0, "", []), ("cat", "", 0, "", [])]).where("doc_id = 1"))
    assert ask("second") == {"first": 1, "second": 2}
    assert POSTS["doc_id"].nullable is False
