"""Queries on the developer registry, made of the names of parts and of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import registry as op
from siltstone.registry import query
from siltstone.session import table

_REGISTRY = """reg AS (SELECT p_partkey AS developer_id, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Holdings, Inc.' ELSE '' END) AS canonical_name, p_partkey % 10 = 0 AS top_tier FROM part WHERE p_partkey % 2 = 0)"""
_NORMAL = "trim(regexp_replace(concat(' ', regexp_replace(trim(regexp_replace(replace(upper({0}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '^THE ', '')), '( (CO|COMPANY|CORP|CORPORATION|INC|INCORPORATED|LC|LLC|LLP|LP|LTD|LIMITED|PLC))+$', ''))"


def _registry(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    form = F.when(F.col("p_partkey") % 3 == 0, " LLC").when(F.col("p_partkey") % 3 == 1, " Holdings, Inc.").otherwise("")
    rows = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("developer_id"), F.concat("p_name", form).alias("canonical_name"), (F.col("p_partkey") % 10 == 0).alias("top_tier"))
    aliases = rows.filter("developer_id % 4 = 0").select("developer_id", F.explode(F.array(F.concat(F.lit("The "), "canonical_name"), F.lit("Holdings Group"), F.upper("canonical_name"))).alias("alias"))
    return rows, aliases


@query(
    f"""WITH {_REGISTRY}, raw AS (SELECT DISTINCT p_name AS raw_name FROM part), al AS (SELECT developer_id, unnest([concat('The ', canonical_name), 'Holdings Group', upper(canonical_name)]) AS name FROM reg WHERE developer_id % 4 = 0),
       nm AS (SELECT developer_id, canonical_name, top_tier, canonical_name AS name, FALSE AS is_alias FROM reg UNION ALL SELECT developer_id, canonical_name, top_tier, al.name, TRUE FROM al JOIN reg USING (developer_id)),
       m AS (SELECT raw_name, nm.*, {_NORMAL.format("canonical_name")} AS d FROM raw JOIN nm ON {_NORMAL.format("raw_name")} = {_NORMAL.format("nm.name")}),
       r AS (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY CASE WHEN regexp_matches(canonical_name, '(LLC|Inc[.])$') THEN 1 ELSE 0 END, len(string_split(d, ' ')), length(canonical_name), CASE WHEN top_tier THEN 0 ELSE 1 END, lower(canonical_name), is_alias, developer_id) AS k FROM m)
       SELECT raw_name, developer_id, canonical_name, CASE WHEN is_alias OR lower(canonical_name) <> lower(raw_name) THEN 'exact_alias' ELSE 'exact_canonical' END AS match_type FROM r WHERE k = 1"""
)
def registry_exact_matches(spark, sf_dir):
    """Names of all parts that a developer has, by normal form, and which developer is preferred."""
    registry, aliases = _registry(spark, sf_dir)
    raw = table(spark, sf_dir, "part").select(F.col("p_name").alias("raw_name")).distinct()
    return op.exact_matches(raw, op.registry_names(registry, aliases))


@query()
def canonicalise_developers(spark, sf_dir):
    """Names of evidence by the registry: exact, similar, or new."""
    (evidence,) = views(spark, sf_dir, "fielded")
    registry, aliases = _registry(spark, sf_dir)
    words = table(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_name", "^(.)(.)", "$1$1$2"), F.lit(" Partners")).alias("raw_name"))
    return op.canonicalised(evidence.select(F.col("developer").alias("raw_name")).unionByName(words), registry, aliases)


@query(
    f"""WITH {_REGISTRY}, raw AS (SELECT DISTINCT trim(n) AS name FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'Realty Group LLC' WHEN 1 THEN ' ' ELSE concat(' ', p_name, ' Inc ') END AS n FROM part) WHERE trim(n) <> '')
       SELECT name, CASE WHEN EXISTS (SELECT 1 FROM reg WHERE {_NORMAL.format("canonical_name")} = {_NORMAL.format("name")}) THEN 'existing' WHEN name = 'Realty Group LLC' THEN 'unsafe' ELSE 'inserted' END AS action FROM raw"""
)
def registry_backfill(spark, sf_dir):
    registry, _ = _registry(spark, sf_dir)
    p = F.col("p_partkey") % 5
    raw = table(spark, sf_dir, "part").select(F.when(p == 0, "Realty Group LLC").when(p == 1, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" Inc "))).alias("raw_name"))
    return op.backfill(raw, registry)


@query(f"WITH {_REGISTRY} SELECT developer_id, 3 AS n_aliases, 1 AS unsafe_aliases, FALSE AS unsafe_name FROM reg WHERE developer_id % 4 = 0")
def registry_audit(spark, sf_dir):
    """Developers of three aliases or more that have one without a meaningful token in common."""
    return op.audited(*_registry(spark, sf_dir))


@query(
    f"""WITH {_REGISTRY}, raw AS (SELECT DISTINCT p_name AS n FROM part) SELECT CASE WHEN EXISTS (SELECT 1 FROM reg WHERE {_NORMAL.format("canonical_name")} = {_NORMAL.format("n")}) THEN 'exact' ELSE 'other' END AS match_type, count(*) AS n FROM raw GROUP BY 1"""
)
def canonicalisation_counters(spark, sf_dir):
    """How many distinct names a sweep of the registry settles by an exact match."""
    registry, aliases = _registry(spark, sf_dir)
    raw = table(spark, sf_dir, "part").select(F.col("p_name").alias("raw_name")).distinct()
    found = raw.join(op.exact_matches(raw, op.registry_names(registry, aliases).filter("NOT is_alias")), "raw_name", "left")
    return found.groupBy(F.when(F.col("match_type").isNotNull(), "exact").otherwise("other").alias("match_type")).agg(F.count(F.lit(1)).alias("n"))
