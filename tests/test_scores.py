"""Over-flagging, decoding with a threshold and result texts, on small literal rows."""

import json

from hinoki.operators import evaluate as E
from hinoki.sources import records as RC

FOUND = "doc_id long, start int, end int, surface string, error_type string, verdict string, confidence double"


def test_overflag_by_type_and_threshold(spark):
    focus = spark.createDataFrame([(1, 0, 4, "divided"), (1, 0, 4, "divided"), (1, 10, 14, "divided"), (2, 0, 4, "accepted"), (3, 5, 9, "accepted")], "doc_id long, start int, end int, type string")
    found = spark.createDataFrame(
        [(1, 3, 6, "", "go_sareru", "norm_divergence", 0.8), (1, 2, 3, "", "sa_insertion", "norm_divergence", 0.4), (1, 14, 16, "", "go_sareru", "norm_divergence", 0.9), (2, 0, 4, "", "go_sareru", "variation", 0.9)], FOUND
    )
    got = {(r.type, r.threshold): (r.n, r.flagged, r.no_overflag_rate) for r in E.overflag(focus, found, "doc_id").collect()}
    assert len(got) == 3 * (len(E.THRESHOLDS) + 1)
    assert got["divided", 0.8] == (2, 1, 0.5) and got["divided", 0.9] == (2, 0, 1.0)
    assert got["accepted", 0.0] == (2, 0, 1.0) and got["__all__", 0.0] == (4, 1, 0.75)
    assert E.overflag(focus.limit(0), found, "doc_id").count() == 0
    assert {r.flagged for r in E.overflag(focus, found.limit(0), "doc_id").collect()} == {0}


def test_a_token_below_the_threshold_ends_a_span(spark):
    rows = [(1, 1, "B-a", 0.9), (1, 2, "I-a", 0.3), (1, 3, "I-a", 0.8), (1, 4, "I-a", 0.6), (1, 5, "I-b", 0.7), (1, 6, "O", 0.9), (1, 7, "I-b", None), (2, 1, "B-a", 0.5), (2, 2, "B-a", 0.5)]
    t = spark.createDataFrame(rows, "id int, pos int, label string, confidence double")
    spans = lambda th: sorted((r.id, r.type, r.start, r.end) for r in E.bio_decode(t, threshold=th).collect())
    assert spans(0.5) == [(1, "a", 1, 2), (1, "a", 3, 5), (1, "b", 5, 6), (2, "a", 1, 2), (2, "a", 2, 3)]
    assert spans(None) == [(1, "a", 1, 5), (1, "b", 5, 6), (1, "b", 7, 8), (2, "a", 1, 2), (2, "a", 2, 3)]
    assert spans(1.0) == []


def test_result_texts_count_roles(spark):
    found = spark.createDataFrame([(1, 3, 6, "x", "go_sareru", "norm_divergence", 0.8), (1, 0, 2, "y", "go_sareru", "variation", 0.4)], FOUND)
    roles = spark.createDataFrame([(1, 0), (1, 3), (2, 0)], "doc_id long, start int")
    got = {r.doc_id: json.loads(r.result) for r in RC.results_json(found, roles=roles).collect()}
    assert (got[1]["n_roles"], got[1]["reportable_count"], got[1]["variation_count"]) == (2, 1, 1) and [f["start"] for f in got[1]["findings"]] == [0, 3]
    assert got[2] == {"findings": [], "reportable_count": 0, "variation_count": 0, "n_roles": 1}
    assert "n_roles" not in json.loads(RC.results_json(found).first().result)
