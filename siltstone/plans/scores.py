"""Distance, score and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.model import views
from siltstone.registry import query
from siltstone.session import table


@query(
    """WITH p AS (SELECT project_id, units, project_id % 60 AS other FROM project), u AS (SELECT project_id, CASE WHEN greatest(units, other) = 0 THEN 0 ELSE abs(units - other) / greatest(units, other) END AS off FROM p)
       SELECT project_id, round(CASE WHEN off <= 0.05 THEN 1.0 WHEN off >= 0.5 THEN 0.0 ELSE (exp(-3 * (off - 0.05) / 0.45) - exp(-3)) / (1 - exp(-3)) END, 6) AS score, off <= 0.25 AS near FROM u""",
    "project",
)
def unit_proximity(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    other = F.col("project_id") % 60
    near = F.coalesce(F.try_divide(F.abs(F.col("units") - other), F.greatest(F.col("units"), other)), F.lit(0.0)) <= 0.25
    return project.select("project_id", F.round(scores.unit_proximity(F.col("units"), other), 6).alias("score"), near.alias("near"))


@query(
    """WITH d AS (SELECT project_id, 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(34.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(34.0)) * power(sin(radians(-118.35 - lng) / 2), 2)))) AS m FROM project)
       SELECT project_id, round(m, 3) AS meters, round(CASE WHEN m <= 0 THEN 1.0 WHEN m >= 5000 THEN 0.0 ELSE (exp(-3 * m / 5000) - exp(-3)) / (1 - exp(-3)) END, 6) AS score FROM d""",
    "project",
)
def distance_falloff(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    m = scores.haversine_meters(F.col("lat"), F.col("lng"), F.lit(34.0), F.lit(-118.35))
    return project.select("project_id", F.round(m, 3).alias("meters"), F.round(scores.proximity(m, 5000.0), 6).alias("score"))


@query(
    """SELECT p_partkey AS id, CAST(sum(CASE WHEN p_size % 2 = 0 THEN p_size END) AS BIGINT) AS total, bool_and(p_size % 2 = 0) AND p_partkey % 3 <> 0 AS complete FROM part GROUP BY p_partkey"""
)
def unit_buckets(spark, sf_dir):
    even = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long"))
    sums = scores.bucket_sum(even, F.when(F.col("p_partkey") % 3 != 0, F.lit(0).cast("long")).otherwise(F.lit(None).cast("long")))
    total = F.when(even.isNotNull(), F.col("s.total"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", sums.alias("s")).select("id", total.alias("total"), F.col("s.complete").alias("complete"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", scores.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) * 108 / 1000000.0 AS DECIMAL(18, 6)) AS usd FROM events")
def model_costs(spark, sf_dir):
    cost = scores.token_cost([(F.col("k"), "3.00"), (F.col("k") * 7, "15.00")])
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k")).select("event_id", cost.alias("usd"))
