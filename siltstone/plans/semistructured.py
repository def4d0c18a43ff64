"""JSON, array and map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.registry import query
from siltstone.session import table


@query("SELECT event_id, CAST(i - 1 AS INT) AS place, CAST(json_extract_string(props, '$.k') AS BIGINT) + i - 1 AS value FROM events, LATERAL (SELECT unnest(range(1, 4)) AS i)")
def json_explode_ordinality(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    text = F.to_json(F.array(k, k + 1, k + 2))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.from_json(text, "array<bigint>")).alias("place", "value"))
    return rows


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.a.b'), json_extract_string(props, '$.k')) AS found FROM events")
def json_path_coalesce(spark, sf_dir):
    at = lambda path: F.try_variant_get(F.parse_json("props"), path, "string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(at("$.missing"), at("$.a.b"), at("$.k")).alias("found"))


@query(
    """WITH a AS (SELECT project_id, list(evidence_id ORDER BY evidence_id) AS ids FROM evidence GROUP BY project_id) SELECT project_id, ids[CAST(project_id % 3 AS INT) + 1] AS candidate FROM a""",
    "evidence",
)
def candidate_value(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    n = F.regexp_extract(F.concat(F.lit("candidate_"), (F.col("project_id") % 3 + 1).cast("string")), r"candidate_(\d+)", 1).try_cast("int")
    lists = evidence.groupBy("project_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("ids"))
    return lists.select("project_id", F.get("ids", n - 1).alias("candidate"))


@query(
    """SELECT developer_id, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS fields FROM evidence GROUP BY developer_id""",
    "evidence",
)
def linked_fields_by_evidence(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    return evidence.groupBy("developer_id").agg(F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("fields"))
