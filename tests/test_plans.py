"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
BUILD_ONLY = {"stream_ingest", "stream_search", "line_search", "rebuild"}  # their work is done before the frame is returned


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - BUILD_ONLY))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|NestedLoopJoin|Python|ArrowEval", text)


def test_date_range_reaches_the_scan(spark):
    text = plan(entry.queries()["date_range"](spark, SF))
    assert "GreaterThanOrEqual(date" in text and "LessThanOrEqual(date" in text
    assert "content" not in text


def test_lookups_prune_the_postings(spark):
    text = plan(entry.queries()["term_match"](spark, SF))
    assert "dynamicpruning" in text
    assert "BroadcastHashJoin [field" in text


@pytest.mark.parametrize("name", ["term_match", "phrase_match"])
def test_tokens_reach_the_scan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert re.search(r"DataFilters: [^]]*token#\d+ (IN|=)", text)


def test_page_texts_are_read_by_slice(spark):
    text = plan(entry.queries()["search_hits"](spark, SF))
    assert re.search(r"PartitionFilters: [^]]*dynamicpruningexpression\(slice", text)


def test_cleaning_is_one_stage(spark):
    text = plan(entry.queries()["clean_pages"](spark, SF))
    assert "Exchange" not in text
    assert text.count("regexp_replace(regexp_replace(regexp_replace(html") == 1
