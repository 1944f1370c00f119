"""Every request row gets its own answer, whatever else is in the batch."""

import json

from marginalia.operators.joins import Stage
from marginalia.plans.search import search
from marginalia.schema import REQUESTS
from workload import inputs

SF = "/root/testdata/sf0.001"
HUGE = 9223372036854775807


def answers(spark, rows, staged=True):
    requests = spark.createDataFrame(rows, REQUESTS)
    found = search(requests, inputs.index(spark, SF), stage=Stage(spark) if staged else None)
    out = {}
    for r in found.responses.collect():
        out.setdefault(r.request_id, []).append(json.loads(r.response))
    return out


def test_repeated_ids_are_answered_row_by_row(spark):
    word, browse = (1, 2, [], [], ["the"]), (1, 3, [0, 0], [], [])
    alone = answers(spark, [("w", *word), ("b", *browse)])
    got = answers(spark, [("d", *word), ("d", *word), ("d", *browse), ("e", *browse), ("e", *browse), ("d", 0, 1, [], [], ["the"])])
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got["e"])) == sorted(map(key, alone["b"] * 2))
    assert sorted(map(key, got["d"])) == sorted(map(key, [*alone["w"] * 2, *alone["b"], {"err_msg": "Invalid Arguments. "}]))
    assert alone["w"][0]["count"] > 0 and alone["b"][0]["count"] == 200


def test_a_page_past_all_numbers_stops_nobody(spark):
    for page, size in ((HUGE, 2), (2, HUGE), (HUGE, HUGE), (1, HUGE)):
        got = answers(spark, [("huge", page, size, [], [], ["the"]), ("day", page, size, [0, 0], [], []), ("w", 1, 2, [], [], ["the"])])
        assert got["huge"][0]["count"] == got["w"][0]["count"] and len(got["w"][0]["data"]) == 2
        assert got["day"][0]["count"] == 200
        assert len(got["huge"][0]["data"]) == (got["w"][0]["count"] if page == 1 else 0)


def test_a_stage_serves_twice(spark):
    stage = Stage(spark)
    requests = spark.createDataFrame([("w", 1, 2, [], [], ["the"])], REQUESTS)
    first = search(requests, inputs.index(spark, SF), stage=stage).totals.collect()
    assert search(requests, inputs.index(spark, SF), stage=stage).totals.collect() == first
