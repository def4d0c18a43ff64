"""Queries on worksheets and rows of the project list; the reference day is 1 July 2001."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import worksheets as op
from siltstone.operators.registry import exact_matches, registry_names
from siltstone.plans.fields import _EFF, _OBSERVED, _ORDER, _resolved
from siltstone.registry import query
from siltstone.session import table

_SHAPE = "CASE WHEN now IS NULL THEN 'null_to_value' WHEN value IS NULL THEN 'value_to_null' ELSE 'value_changed' END"
_BASE = f"""{_OBSERVED}, cnt AS (SELECT project_id, CAST(max({_EFF}) AS VARCHAR) AS last_evidence_date, count(*) AS evidence_count FROM seen GROUP BY project_id),
  win AS (SELECT DISTINCT ON (project_id, evidence_id) project_id, evidence_id, source_type AS ws, tier AS wt, CAST(evidence_date AS VARCHAR) AS wd, CAST(CAST(collected_at AS DATE) AS VARCHAR) AS wc, record_id AS wr FROM seen),
  sheet AS (SELECT '' AS decision, '' AS notes, r.project_id, p.name AS project_name, p.address AS canonical_address, r.field, w.now AS current_value, r.value AS resolved_value, r.rule AS rule_applied, r.confidence AS resolution_confidence, {_SHAPE.replace("value IS", "r.value IS")} AS delta_shape,
    last_evidence_date, evidence_count, CASE WHEN r.evidence_id IS NULL THEN 0 ELSE 1 END AS supporting_evidence_count, CAST(r.evidence_id AS VARCHAR) AS evidence_ids, ws AS winning_source_type, wt AS winning_source_tier, wd AS winning_evidence_date, wc AS winning_collected_at, wr AS winning_source_record_id
    FROM resolved r JOIN wanted w ON w.project_id = r.project_id AND w.field = r.field JOIN project p ON p.project_id = r.project_id LEFT JOIN cnt ON cnt.project_id = r.project_id LEFT JOIN win ON win.project_id = r.project_id AND win.evidence_id = r.evidence_id WHERE r.value IS DISTINCT FROM w.now)"""


@query(f"WITH {_BASE} SELECT *, CAST(resolved_value AS BIGINT) - CAST(current_value AS BIGINT) AS delta_signed, abs(CAST(resolved_value AS BIGINT) - CAST(current_value AS BIGINT)) AS delta_abs, CASE WHEN winning_source_type IS NOT NULL THEN resolved_value END AS winning_observed_value FROM sheet WHERE field = 'units'", "project", "fielded")
def units_worksheet(spark, sf_dir):
    """The review worksheet of units."""
    project, evidence = views(spark, sf_dir, "project", "fielded")
    return op.units_worksheet(project, evidence.filter("NOT superseded"), _resolved(spark, sf_dir, ["units"], op.WON))


@query(
    f"""WITH {_BASE}, x AS (SELECT *, CASE WHEN TRY_CAST(regexp_extract(resolved_value, '^Developer (\\d+), LLC$', 1) AS INT) % 3 = 0 THEN concat('Developer ', regexp_extract(resolved_value, '^Developer (\\d+), LLC$', 1), ' Inc') END AS canonical_name FROM sheet WHERE field = 'developer')
       SELECT *, CASE WHEN canonical_name IS NULL THEN 'new_registry_entry' ELSE 'exact_alias' END AS match_type, resolved_value AS raw_value, canonical_name IS NULL AS requires_review FROM x""",
    "project", "fielded",
)
def developer_worksheet(spark, sf_dir):
    """The review worksheet of developers, with the registry's names."""
    project, evidence = views(spark, sf_dir, "project", "fielded")
    number = F.regexp_extract("developer", r"^Developer (\d+), LLC$", 1).try_cast("int")
    registry = evidence.select(number.alias("developer_id")).filter("developer_id % 3 = 0").distinct().select("developer_id", F.concat(F.lit("Developer "), F.col("developer_id"), F.lit(" Inc")).alias("canonical_name"), F.lit(False).alias("top_tier"))
    names = exact_matches(evidence.select(F.col("developer").alias("raw_name")).distinct(), registry_names(registry, registry.select("developer_id", F.col("canonical_name").alias("alias")).limit(0)))
    return op.developer_worksheet(project, evidence.filter("NOT superseded"), _resolved(spark, sf_dir, ["developer"], op.WON), names)


@query(
    f"""WITH jur AS (SELECT n_nationkey AS jurisdiction_id, lower(n_name) AS slug, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN concat('City of ', n_name) END AS display_name FROM nation WHERE n_nationkey <> 7),
       apn AS (SELECT DISTINCT project_id, lpad(CAST(evidence_id % 9000 AS VARCHAR(9)), 4, '0') AS apn FROM fielded WHERE evidence_id % 40 = 0), lst AS (SELECT project_id, list(apn ORDER BY apn) AS apns FROM apn GROUP BY project_id),
       ev AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_ORDER}) AS r FROM fielded WHERE NOT superseded),
       la AS (SELECT project_id, to_json({{'source_type': source_type, 'evidence_date': CAST(evidence_date AS VARCHAR), 'collected_at': CAST(CAST(collected_at AS DATE) AS VARCHAR), 'fields': list_filter([CASE WHEN units IS NOT NULL THEN 'units' END, CASE WHEN trim(stories) <> '' THEN 'stories' END, CASE WHEN trim(product_type) <> '' THEN 'product_type' END,
         CASE WHEN trim(age_restriction) <> '' THEN 'age_restriction' END, CASE WHEN trim(developer) <> '' THEN 'developer' END, CASE WHEN trim(delivery) <> '' THEN 'delivery' END], lambda x: x IS NOT NULL)}}) AS last_evidence FROM ev WHERE r = 1)
       SELECT p.project_id, coalesce(p.name, p.address) AS project_name, p.address AS canonical_address, p.developer, p.units, p.product_type, CASE WHEN j.jurisdiction_id IS NOT NULL THEN CAST(to_json({{'jurisdiction_id': j.jurisdiction_id, 'slug': j.slug, 'name': j.name, 'display_name': coalesce(j.display_name, j.name)}}) AS VARCHAR) END AS jurisdiction,
         CAST(to_json(coalesce(apns, [])) AS VARCHAR) AS apns, CAST(last_evidence AS VARCHAR) AS last_evidence FROM project p LEFT JOIN jur j ON j.jurisdiction_id = p.jurisdiction_id LEFT JOIN lst ON lst.project_id = p.project_id LEFT JOIN la ON la.project_id = p.project_id""",
    "project", "fielded",
)
def project_list_rows(spark, sf_dir):
    """Rows of the project list, their nested parts as JSON."""
    project, evidence = views(spark, sf_dir, "project", "fielded")
    nation = table(spark, sf_dir, "nation").filter("n_nationkey <> 7")
    k = F.col("n_nationkey")
    jurisdictions = nation.select(k.alias("jurisdiction_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("City of "), "n_name")).alias("display_name"))
    parcels = evidence.filter("evidence_id % 40 = 0").select("project_id", F.lpad((F.col("evidence_id") % 9000).cast("string"), 4, "0").alias("apn"))
    rows = op.project_rows(project, jurisdictions, evidence.filter("NOT superseded"), parcels)
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return rows.select("project_id", "project_name", "canonical_address", "developer", "units", "product_type", json("jurisdiction"), json("apns"), json("last_evidence"))
