"""Declared shapes against answers written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import shapes as op

GOOD = {"relevance": "confirmed", "project_references": [{"candidate_confidence": "high", "candidate_unit_total": 12, "candidate_lat": "34.1", "candidate_name": None}], "diagnostic": {"any": [1, None]}}


def with_project(**changes):
    return {**GOOD, "project_references": [{**GOOD["project_references"][0], **changes}]}


PROJECT = "project_references[0]."
CASES = [
    (GOOD, ""), ({"relevance": "rejected"}, ""), ({}, "relevance:missing"), ({"relevance": None}, "relevance:null"), ({"relevance": 3}, "relevance:value"),
    ({**GOOD, "project_references": {}}, "project_references:type"), ({**GOOD, "project_references": [3, None]}, "project_references[0]:type;project_references[1]:null"),
    ({**GOOD, "more": 1, "other": 2}, "more:extra;other:extra"), ({**GOOD, "diagnostic": []}, "diagnostic:type"),
    (with_project(candidate_unit_total=-1), f"{PROJECT}candidate_unit_total:range"), (with_project(candidate_unit_total=1.5), f"{PROJECT}candidate_unit_total:type"), (with_project(candidate_unit_total="7"), ""), (with_project(candidate_unit_total=3.0), ""),
    (with_project(candidate_unit_total=True), f"{PROJECT}candidate_unit_total:type"), (with_project(candidate_confidence=None), f"{PROJECT}candidate_confidence:null"),
    (with_project(candidate_delivery_year_normalized="2024-02-30"), f"{PROJECT}candidate_delivery_year_normalized:value"), (with_project(candidate_delivery_year_normalized="2024-02-29"), ""),
    (with_project(registry_project_id="x"), f"{PROJECT}registry_project_id:value"), (with_project(registry_project_id="123e4567-e89b-12d3-a456-426614174000"), ""),
    (with_project(candidate_signal_flags={"a": True, "b": "maybe", "c": "yes"}), f"{PROJECT}candidate_signal_flags.b:type"), (with_project(candidate_identifiers={"apn": ["1", 2]}), f"{PROJECT}candidate_identifiers.apn[1]:type"),
    (with_project(passage_excerpts=[{"field": "f", "value": None, "passage": "p", "offset_start": 5, "offset_end": 4}]), f"{PROJECT}passage_excerpts[0].offset_end:order"),
    (with_project(passage_excerpts=[{"field": "f", "passage": "p", "offset_start": "x", "offset_end": 4}]), f"{PROJECT}passage_excerpts[0].offset_start:type;{PROJECT}passage_excerpts[0].value:missing"),
]


def test_extractions_by_hand(spark):
    raws = [(i, json.dumps(c), None) for i, (c, _) in enumerate(CASES)]
    raws += [(100, "no json", None), (101, None, None), (102, "[1]", None), (103, "{}", "max_tokens"), (104, "{}", "refusal"), (105, "```json\n" + json.dumps(GOOD) + "\n```", "end"), (106, "7", None)]
    got = {r.k: (r.status, r.found) for r in op.extraction_answers(spark.createDataFrame(raws, "k long, raw string, stop string"), "k").collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == ("schema_invalid" if want else "ok", want), CASES[i]
    assert [got[i][0] for i in range(100, 107)] == ["parse_error", "parse_error", "schema_invalid", "truncated", "refused", "ok", "schema_invalid"]


def test_codes_are_looked_up(spark):
    codes = spark.createDataFrame([("A", "news_v1", "units"), ("B", "permits_v1", "units"), ("C", "news_v1", "stories")], "code string, profile string, field_name string")
    item = lambda code, **more: {"field_name": "units", "confidence": "low", "reason_code": code, **more}
    raws = {
        1: [item("A"), item("A", source_anchors=[{"text": "t"}])], 2: {"interpretations": [item("A"), item("B")]}, 3: [item("C"), item("Z")], 4: {"interpretations": [item("A", confidence="sure")]},
        5: [item("A", source_anchors=[{"text": "t", "offset_start": 3, "offset_end": 1}])], 6: [], 7: {},
    }
    rows = spark.createDataFrame([(k, json.dumps(v), None) for k, v in raws.items()], "k long, raw string, stop string")
    got = {r.k: (r.status, r.found) for r in op.semantic_answers(rows, "k", codes).collect()}
    assert got == {
        1: ("ok", ""), 2: ("schema_invalid", "interpretations[1].reason_code:wrong_profile"), 3: ("schema_invalid", "interpretations[0].reason_code:wrong_field;interpretations[1].reason_code:unknown_code"),
        4: ("schema_invalid", "interpretations[0].confidence:value"), 5: ("schema_invalid", "interpretations[0].source_anchors[0].offset_end:order"), 6: ("ok", ""), 7: ("ok", ""),
    }


@pytest.mark.parametrize("rows", [0, 3])
def test_no_python_worker(spark, rows):
    """The checks are expressions over variants: nothing in the plan goes to Python."""
    frame = spark.range(rows).select(F.col("id").alias("k"), F.lit('{"relevance": "maybe"}').alias("raw"), F.lit(None).cast("string").alias("stop"))
    made = op.extraction_answers(frame, "k")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and made.count() == rows
