"""Queries on the resolution of all fields; the reference day is 1 July 2001."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import fields as op
from siltstone.registry import query

_DAY = "2001-07-01"
_FIELDS = ["units", "stories", "product_type", "age_restriction", "developer", "delivery"]
_EFF = "least(coalesce(evidence_date, CAST(collected_at AS DATE)), CAST(collected_at AS DATE))"
_ORDER = f"{_EFF} DESC, CAST(epoch(collected_at) AS BIGINT) DESC, CASE source_type WHEN 'city_permit' THEN 0 WHEN 'vendor_a' THEN 1 WHEN 'vendor_b' THEN 2 ELSE 3 END, tier, evidence_id"
_TYPE = """CASE lower(trim({0})) WHEN 'apartment' THEN 'Apartment' WHEN 'condos' THEN 'Condo' WHEN 'townhomes' THEN 'Townhome' ELSE 'Unknown' END"""
_OBSERVED = f"""seen AS (SELECT * FROM fielded WHERE NOT superseded),
  raw AS (SELECT *, 'units' AS field, CAST(units AS VARCHAR) AS v FROM seen UNION ALL SELECT *, 'stories', CAST(TRY_CAST(stories AS INT) AS VARCHAR) FROM seen
    UNION ALL SELECT *, 'product_type', {_TYPE.format("product_type")} FROM seen WHERE trim(product_type) <> ''
    UNION ALL SELECT *, 'age_restriction', CASE lower(age_restriction) WHEN 'senior' THEN 'Senior' WHEN 'student' THEN 'Student' WHEN 'non age-restricted' THEN 'Non Age-Restricted' ELSE 'Unknown' END FROM seen WHERE age_restriction IS NOT NULL
    UNION ALL SELECT *, 'developer', developer FROM seen UNION ALL SELECT *, 'delivery', CAST(TRY_CAST(delivery AS DATE) AS VARCHAR) FROM seen),
  observed AS (SELECT *, {_EFF} AS eff, row_number() OVER (PARTITION BY project_id, field ORDER BY {_ORDER}) AS r FROM raw WHERE v IS NOT NULL),
  won AS (SELECT project_id, field, max(CASE WHEN r = 1 THEN v END) AS v, max(CASE WHEN r = 1 THEN evidence_id END) AS evidence_id, max(CASE WHEN r = 1 THEN tier END) AS tier, max(CASE WHEN r = 1 THEN source_type END) AS source_type,
    max(CASE WHEN r = 1 THEN eff END) AS day, count(DISTINCT source_type) AS s FROM observed WHERE r <= 2 GROUP BY project_id, field),
  wanted AS (SELECT project_id, 'units' AS field, CAST(units AS VARCHAR) AS now FROM project UNION ALL SELECT project_id, 'stories', NULL FROM project UNION ALL SELECT project_id, 'product_type', product_type FROM project
    UNION ALL SELECT project_id, 'age_restriction', NULL FROM project UNION ALL SELECT project_id, 'developer', developer FROM project UNION ALL SELECT project_id, 'delivery', NULL FROM project),
  resolved AS (SELECT project_id, field, CASE WHEN evidence_id IS NULL THEN now ELSE v END AS value, CASE WHEN evidence_id IS NULL THEN 'low' WHEN tier = 1 THEN 'high' WHEN day >= DATE '{_DAY}' - 180 AND s >= 2 THEN 'high' WHEN day >= DATE '{_DAY}' - 180 AND tier IN (2, 3) THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN evidence_id IS NULL THEN 'no_evidence_keep_current' WHEN field = 'age_restriction' THEN 'most_recent_explicit_wins' ELSE 'most_recent_wins' END AS rule, day, tier, source_type, evidence_id FROM wanted LEFT JOIN won USING (project_id, field))"""


def _as_of():
    return F.lit(_DAY).cast("date")


def _resolved(spark, sf_dir, fields=_FIELDS, also=()):
    project, evidence = views(spark, sf_dir, "project", "fielded")
    return op.all_fields(project, evidence.filter("NOT superseded"), fields, _as_of(), also)


@query(f"WITH {_OBSERVED} SELECT project_id, field, value, confidence, rule, CAST(day AS VARCHAR) AS day, tier, source_type, evidence_id FROM resolved", "project", "fielded")
def resolve_all_fields(spark, sf_dir):
    """Stories, product type, age, developer, delivery and units of every project, with frontier."""
    return _resolved(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH {_OBSERVED}, act AS (SELECT * FROM override WHERE NOT cleared),
       j AS (SELECT r.*, a.value AS ov, a.project_id IS NOT NULL AND NOT (coalesce(a.by_system AND a.mode = 'until_newer_evidence', FALSE) AND r.day IS NOT NULL AND (r.day > a.base_date OR (r.day = a.base_date AND r.tier < a.base_tier))) AS wins
             FROM resolved r LEFT JOIN act a ON a.project_id = r.project_id AND a.field = r.field)
       SELECT project_id, field, CASE WHEN wins THEN ov ELSE value END AS value, CASE WHEN wins THEN 'high' ELSE confidence END AS confidence, CASE WHEN wins THEN 'override' ELSE rule END AS rule FROM j""",
    "project", "fielded", "override",
)
def overridden_fields(spark, sf_dir):
    """Active overrides on the resolved fields, and whether newer evidence outdates them."""
    (overrides,) = views(spark, sf_dir, "override")
    return op.overridden(_resolved(spark, sf_dir), overrides)


@query(
    f"""WITH {_OBSERVED}, d AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) AS n FROM observed WHERE field = 'delivery' AND v <= '{_DAY}'),
       w AS (SELECT * FROM d WHERE n = 1), news AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n) AS k FROM d WHERE source_type = 'news_article' AND evidence_date >= DATE '{_DAY}' - 180)
       SELECT w.project_id, CASE WHEN w.source_type = 'vendor_a' AND news.v IS NOT NULL THEN news.v ELSE w.v END AS value, CASE WHEN w.source_type = 'vendor_a' AND news.v IS NOT NULL THEN news.source_type ELSE w.source_type END AS source_type,
         CASE WHEN w.source_type = 'vendor_a' AND news.v IS NOT NULL THEN news.evidence_id ELSE w.evidence_id END AS evidence_id FROM w LEFT JOIN news ON news.project_id = w.project_id AND k = 1""",
    "project", "fielded",
)
def delivery_news_over_vendor(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "fielded")
    return op.news_over_vendor(op.observations(evidence.filter("NOT superseded"), ["delivery"]), _as_of())


_FLAGGED = """f AS (SELECT project_id, project_id % 6 = 0 AS needs_review, CASE WHEN project_id % 12 = 0 THEN 'Approved' END AS candidate_status, units AS old_units, CASE WHEN project_id % 3 = 0 THEN units + 9 ELSE units END AS new_units,
  units // 2 AS old_affordable, units // 2 AS new_affordable, CASE WHEN project_id % 5 = 0 THEN NULL ELSE units END AS old_market_rate, CASE WHEN project_id % 5 = 0 THEN NULL ELSE units END AS new_market_rate,
  CASE WHEN project_id % 2 = 0 THEN 0 END AS old_workforce, CASE WHEN project_id % 2 = 0 AND project_id % 7 <> 0 THEN 0 END AS new_workforce,
  CASE project_id % 9 WHEN 0 THEN 'fuzzy_review' WHEN 1 THEN 'new_registry_entry' WHEN 2 THEN 'exact_alias' END AS developer_match FROM project)"""


@query(
    f"""WITH {_FLAGGED}, t AS (SELECT *, coalesce(new_affordable, 0) + coalesce(new_market_rate, 0) + coalesce(new_workforce, 0) - new_units AS off, new_affordable IS NOT NULL AND new_market_rate IS NOT NULL AND new_workforce IS NOT NULL AS whole FROM f)
       SELECT project_id, CASE WHEN candidate_status IS NULL THEN 'permit_issued_requires_review' ELSE 'status_transition_requires_review' END AS flag, 'high' AS priority FROM t WHERE needs_review
       UNION ALL SELECT project_id, 'unit_split_mismatch', 'medium' FROM t WHERE old_units <> new_units AND old_affordable IS NOT DISTINCT FROM new_affordable AND old_market_rate IS NOT DISTINCT FROM new_market_rate AND old_workforce IS NOT DISTINCT FROM new_workforce
         AND ((whole AND abs(off) > 2) OR off > 2)
       UNION ALL SELECT project_id, CASE developer_match WHEN 'fuzzy_review' THEN 'developer_canonicalization_review' ELSE 'developer_registry_new_name' END, 'medium' FROM t WHERE developer_match IN ('fuzzy_review', 'new_registry_entry')""",
    "project",
)
def review_flags(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    half, market = F.floor(F.col("units") / 2).cast("int"), F.when(p % 5 != 0, F.col("units"))
    rows = project.select(
        "project_id", (p % 6 == 0).alias("needs_review"), F.when(p % 12 == 0, "Approved").alias("candidate_status"), F.col("units").alias("old_units"), F.when(p % 3 == 0, F.col("units") + 9).otherwise(F.col("units")).alias("new_units"),
        half.alias("old_affordable"), half.alias("new_affordable"), market.alias("old_market_rate"), market.alias("new_market_rate"), F.when(p % 2 == 0, 0).alias("old_workforce"), F.when((p % 2 == 0) & (p % 7 != 0), 0).alias("new_workforce"),
        F.when(p % 9 == 0, "fuzzy_review").when(p % 9 == 1, "new_registry_entry").when(p % 9 == 2, "exact_alias").alias("developer_match"),
    )
    return op.review_flags(rows)


@query("SELECT project_id, p.status_rank AS current_rank, e.status_rank AS proposed_rank, evidence_id, source_type = 'city_permit' AND evidence_id % 2 = 0 AS suppressed FROM fielded e JOIN project p USING (project_id) WHERE NOT superseded AND e.status_rank < p.status_rank", "fielded", "project")
def regression_candidates(spark, sf_dir):
    """Statuses below the current one, and those of them that additive paperwork explains."""
    evidence, project = views(spark, sf_dir, "fielded", "project")
    return op.regression_candidates(project, evidence.filter("NOT superseded"), (F.col("source_type") == "city_permit") & (F.col("evidence_id") % 2 == 0))


_SEED = """a AS (SELECT project_id, CASE WHEN project_id % 4 = 0 THEN 'Unknown' WHEN project_id % 4 = 1 THEN ' ' ELSE product_type END AS product_type, CASE WHEN project_id % 3 = 0 THEN NULL ELSE developer END AS developer FROM project WHERE project_id % 10 <> 0),
  b AS (SELECT project_id, product_type, CASE WHEN project_id % 5 = 0 THEN NULL ELSE developer END AS developer FROM project WHERE project_id % 7 <> 0)"""


@query(
    f"""WITH {_SEED}, k AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, a.product_type AS t, CASE WHEN trim(a.product_type) NOT IN ('', 'Unknown') THEN a.product_type END AS t1, b.product_type AS t2, a.developer AS d1, b.developer AS d2 FROM a FULL OUTER JOIN b ON a.project_id = b.project_id)
       SELECT project_id, coalesce(t1, t2, t) AS product_type, coalesce(d1, d2) AS developer FROM k""",
    "project",
)
def seed_fill_missing(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    a = project.filter("project_id % 10 <> 0").select("project_id", F.when(p % 4 == 0, "Unknown").when(p % 4 == 1, " ").otherwise(F.col("product_type")).alias("product_type"), F.when(p % 3 != 0, F.col("developer")).alias("developer"))
    b = project.filter("project_id % 7 <> 0").select("project_id", "product_type", F.when(p % 5 != 0, F.col("developer")).alias("developer"))
    return op.fill_missing(a, b, "project_id", ["product_type", "developer"])
