"""Queries on answers of models against their declared shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import shapes as op
from siltstone.registry import query

#: A project of an extraction; what is wrong with it varies with the row's own values.
_PROJECT = """concat('{"candidate_name": ', CASE WHEN developer IS NULL THEN 'null' ELSE concat('"', developer, '"') END, ', "candidate_unit_total": ', CASE WHEN units IS NULL THEN '"many"' WHEN units % 7 = 3 THEN concat('-', CAST(units AS VARCHAR(9))) ELSE CAST(units AS VARCHAR(9)) END,
  CASE WHEN confidence IS NULL THEN '' ELSE concat(', "candidate_confidence": "', confidence, '"') END, ', "candidate_product_type": "', CASE WHEN project_id % 4 = 0 THEN 'castle' WHEN project_id % 4 = 1 THEN 'condo' ELSE 'apartment' END, '"', CASE WHEN article_id % 9 = 0 THEN ', "note": 1' ELSE '' END,
  ', "candidate_signal_flags": {"topped_out": ', CASE WHEN article_id % 5 = 0 THEN '[]' ELSE 'true' END, '}, "passage_excerpts": [{"field": "units", "value": null, "passage": "p", "offset_start": ', CAST(status_rank AS VARCHAR(9)), ', "offset_end": ', CAST(project_id % 10 AS VARCHAR(9)), '}]}')"""
_EXTRACTED = f"""concat(CASE WHEN reference_id % 6 = 0 THEN '```json ' ELSE '' END, '{{"relevance": "', CASE WHEN article_id % 8 = 0 THEN 'maybe' ELSE 'confirmed' END, '", "project_references": [', {_PROJECT}, CASE WHEN candidates = 2 THEN concat(', ', {_PROJECT}) ELSE '' END, ']',
  CASE WHEN reference_id % 13 = 0 THEN '' ELSE '}}' END, CASE WHEN reference_id % 6 = 0 THEN ' ```' ELSE '' END)"""
_STOP = "CASE WHEN reference_id % 17 = 0 THEN 'max_tokens' WHEN reference_id % 19 = 0 THEN 'refusal' ELSE 'end' END"

_FENCE = "regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', '')"
_STATE = "CASE WHEN stop = 'max_tokens' THEN 'truncated' WHEN stop = 'refusal' THEN 'refused' WHEN NOT good THEN 'parse_error' WHEN listed <> '' THEN 'schema_invalid' ELSE 'ok' END"


@query(
    f"""WITH a AS (SELECT reference_id, {_STOP} AS stop, {_EXTRACTED} AS raw FROM reference),
      t AS (SELECT reference_id, stop, json_valid({_FENCE}) AS good, CASE WHEN json_valid({_FENCE}) THEN {_FENCE} END AS j FROM a),
      p AS (SELECT reference_id, concat('project_references[', i, '].') AS spot, json_extract(j, concat('$.project_references[', i, ']')) AS x FROM t, LATERAL (SELECT unnest(range(CAST(json_array_length(j, '$.project_references') AS BIGINT))) AS i) WHERE good),
      v AS (SELECT reference_id, 'relevance:value' AS f FROM t WHERE json_extract_string(j, '$.relevance') NOT IN ('confirmed', 'rejected', 'unclear')
        UNION ALL SELECT reference_id, concat(spot, k, ':extra') FROM p, LATERAL (SELECT unnest(json_keys(x)) AS k) WHERE k NOT LIKE 'candidate\\_%' ESCAPE '\\' AND k <> 'passage_excerpts'
        UNION ALL SELECT reference_id, concat(spot, 'candidate_unit_total:', CASE WHEN TRY_CAST(json_extract_string(x, '$.candidate_unit_total') AS BIGINT) IS NULL THEN 'type' ELSE 'range' END) FROM p WHERE coalesce(TRY_CAST(json_extract_string(x, '$.candidate_unit_total') AS BIGINT), -1) < 0
        UNION ALL SELECT reference_id, concat(spot, 'candidate_confidence:missing') FROM p WHERE json_extract(x, '$.candidate_confidence') IS NULL
        UNION ALL SELECT reference_id, concat(spot, 'candidate_product_type:value') FROM p WHERE json_extract_string(x, '$.candidate_product_type') NOT IN ('apartment', 'condo', 'townhome', 'single_family', 'micro_co_living', 'other')
        UNION ALL SELECT reference_id, concat(spot, 'candidate_signal_flags.topped_out:type') FROM p WHERE json_type(x, '$.candidate_signal_flags.topped_out') <> 'BOOLEAN'
        UNION ALL SELECT reference_id, concat(spot, 'passage_excerpts[0].offset_end:order') FROM p WHERE CAST(json_extract(x, '$.passage_excerpts[0].offset_start') AS BIGINT) > CAST(json_extract(x, '$.passage_excerpts[0].offset_end') AS BIGINT)),
      g AS (SELECT reference_id, string_agg(f, ';' ORDER BY f) AS listed FROM v GROUP BY reference_id),
      s AS (SELECT reference_id, stop, good, coalesce(listed, '') AS listed FROM t LEFT JOIN g USING (reference_id))
      SELECT reference_id, {_STATE} AS status, CASE WHEN {_STATE} = 'schema_invalid' THEN listed ELSE '' END AS found FROM s""",
    "reference",
)
def extraction_answers(spark, sf_dir):
    """Parse states of extractions, and where they break their shape."""
    (rows,) = views(spark, sf_dir, "reference")
    return op.extraction_answers(rows.select("reference_id", F.expr(_STOP).alias("stop"), F.expr(_EXTRACTED).alias("raw")), "reference_id")


_ITEM = """concat('{"field_name": "', CASE WHEN reference_id % 2 = 0 THEN 'units' ELSE 'stories' END, '", "confidence": "', coalesce(confidence, 'none'), '", "reason_code": "C', CAST(project_id % 60 AS VARCHAR(9)), '", "source_anchors": [{"text": "t", "offset_start": ', CAST(status_rank AS VARCHAR(9)), '}]}')"""
_INTERPRETED = f"""concat(CASE WHEN reference_id % 3 = 0 THEN '' ELSE '{{"interpretations": ' END, '[', {_ITEM}, CASE WHEN candidates = 1 THEN concat(', ', {_ITEM}) ELSE '' END, ']', CASE WHEN reference_id % 3 = 0 THEN '' ELSE '}}' END)"""
_CODES = """SELECT DISTINCT concat('C', CAST(p_partkey % 50 AS VARCHAR(9))) AS code, CASE WHEN p_partkey % 50 % 9 = 0 THEN 'permits_v1' ELSE 'news_v1' END AS profile, CASE WHEN p_partkey % 50 % 4 < 3 THEN 'units' ELSE 'stories' END AS field_name FROM part"""


@query(
    f"""WITH a AS (SELECT reference_id, {_STOP} AS stop, {_INTERPRETED} AS raw FROM reference), c AS ({_CODES}),
      t AS (SELECT reference_id, stop, json_valid(raw) AS good, CASE WHEN json_type(raw) = 'ARRAY' THEN CAST(raw AS JSON) ELSE json_extract(raw, '$.interpretations') END AS j FROM a),
      p AS (SELECT reference_id, concat('interpretations[', i, '].') AS spot, json_extract(j, concat('$[', i, ']')) AS x FROM t, LATERAL (SELECT unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i)),
      v AS (SELECT reference_id, concat(spot, 'confidence:value') AS f FROM p WHERE json_extract_string(x, '$.confidence') NOT IN ('high', 'medium', 'low')),
      w AS (SELECT reference_id, concat(spot, 'reason_code:', CASE WHEN c.code IS NULL THEN 'unknown_code' WHEN c.profile <> 'news_v1' THEN 'wrong_profile' ELSE 'wrong_field' END) AS f FROM p LEFT JOIN c ON c.code = json_extract_string(x, '$.reason_code')
            WHERE (c.code IS NULL OR c.profile <> 'news_v1' OR c.field_name <> json_extract_string(x, '$.field_name')) AND reference_id NOT IN (SELECT reference_id FROM v)),
      g AS (SELECT reference_id, string_agg(f, ';' ORDER BY f) AS listed FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY reference_id),
      s AS (SELECT reference_id, stop, good, coalesce(listed, '') AS listed FROM t LEFT JOIN g USING (reference_id))
      SELECT reference_id, {_STATE} AS status, CASE WHEN {_STATE} = 'schema_invalid' THEN listed ELSE '' END AS found FROM s""",
    "reference",
)
def semantic_answers(spark, sf_dir):
    """Parse states of interpretations, whose reason codes are looked up in a table of codes."""
    (rows,) = views(spark, sf_dir, "reference")
    codes = spark.sql(_CODES.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return op.semantic_answers(rows.select("reference_id", F.expr(_STOP).alias("stop"), F.expr(_INTERPRETED).alias("raw")), "reference_id", codes)
