"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert difference(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 8


def test_responses_agree_with_pages_and_counts(spark):
    import json

    rows = {r.request_id: json.loads(r.response) for r in entry.queries()["response_json"](spark, SF).collect()}
    counts = {r.request_id: r.total for r in entry.queries()["batch_counts"](spark, SF).collect()}
    pages = {}
    for r in entry.queries()["batch_search"](spark, SF).collect():
        pages.setdefault(r.request_id, []).append((r.rank, r.doc_id))
    errors = {r.request_id: r.error for r in entry.queries()["request_errors"](spark, SF).collect()}
    assert set(rows) == set(errors)
    for request_id, answer in rows.items():
        if errors[request_id]:
            assert answer == {"err_msg": errors[request_id]}
        else:
            assert answer["count"] == counts[request_id]
            urls = [int(hit["url"].rsplit("/", 1)[1]) for hit in answer["data"]]
            assert urls == [d for _, d in sorted(pages.get(request_id, []))]
