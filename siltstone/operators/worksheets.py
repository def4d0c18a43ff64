"""Flat worksheets for review, and the nested rows of the project list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.dates import effective_date
from siltstone.operators.resolution import delta_shape, observation_order


#: What a worksheet shows of the winning evidence beside its frontier.
WON = ("evidence_date", "collected_at", "record_id")


def worksheet(projects: DataFrame, evidence: DataFrame, resolved: DataFrame, field: str, current: Column) -> DataFrame:
    """A row for each project whose resolved field differs from its current value: what changed, by which rule, and the evidence that won.

    `resolved` is the result of `fields.all_fields` with the columns WON of the winning evidence; `decision` and `notes` are left for the reviewer.
    """
    day = effective_date(F.col("evidence_date"), F.col("collected_at"))
    counts = evidence.groupBy("project_id").agg(F.max(day).cast("string").alias("last_evidence_date"), F.count(F.lit(1)).alias("evidence_count"))
    now = projects.select("project_id", F.col("name").alias("project_name"), F.col("address").alias("canonical_address"), current.cast("string").alias("current_value"))
    rows = resolved.filter(F.col("field") == field).join(now, "project_id").filter(~F.col("value").eqNullSafe(F.col("current_value")))
    rows = rows.join(counts, "project_id", "left")
    return rows.select(
        F.lit("").alias("decision"), F.lit("").alias("notes"), "project_id", "project_name", "canonical_address", "field", "current_value", F.col("value").alias("resolved_value"), F.col("rule").alias("rule_applied"), F.col("confidence").alias("resolution_confidence"),
        delta_shape(F.col("current_value"), F.col("value")).alias("delta_shape"), "last_evidence_date", "evidence_count", F.when(F.col("evidence_id").isNull(), 0).otherwise(1).alias("supporting_evidence_count"), F.col("evidence_id").cast("string").alias("evidence_ids"),
        F.col("source_type").alias("winning_source_type"), F.col("tier").alias("winning_source_tier"), F.col("evidence_date").cast("string").alias("winning_evidence_date"),
        F.to_date("collected_at").cast("string").alias("winning_collected_at"), F.col("record_id").alias("winning_source_record_id"),
    )


def units_worksheet(projects: DataFrame, evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """The worksheet of units, with how much they change."""
    delta = F.col("resolved_value").try_cast("long") - F.col("current_value").try_cast("long")
    return worksheet(projects, evidence, resolved, "units", F.col("units")).withColumns({"delta_signed": delta, "delta_abs": F.abs(delta), "winning_observed_value": F.when(F.col("winning_source_type").isNotNull(), F.col("resolved_value"))})


def developer_worksheet(projects: DataFrame, evidence: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """The worksheet of developers, with the canonical name that the registry has (raw_name, canonical_name, match_type)."""
    known = names.select(F.col("raw_name").alias("resolved_value"), "canonical_name", "match_type").dropDuplicates(["resolved_value"])
    rows = worksheet(projects, evidence, resolved, "developer", F.col("developer")).join(known, "resolved_value", "left")
    match = F.coalesce("match_type", F.lit("new_registry_entry"))
    return rows.withColumns({"raw_value": F.col("resolved_value"), "match_type": match, "requires_review": match.isin("fuzzy_review", "new_registry_entry")})


def project_rows(projects: DataFrame, jurisdictions: DataFrame, evidence: DataFrame, parcels: DataFrame) -> DataFrame:
    """The rows of the project list: nested jurisdiction (or null), sorted parcels (or an empty list), and the latest evidence with the names of its fields (or null).

    jurisdictions: jurisdiction_id, slug, name, display_name; parcels: project_id, apn.
    """
    place = F.struct("jurisdiction_id", "slug", F.col("jurisdiction_name").alias("name"), F.coalesce("display_name", "jurisdiction_name").alias("display_name"))
    known = jurisdictions.withColumnRenamed("name", "jurisdiction_name").select("jurisdiction_id", place.alias("jurisdiction"))
    apns = parcels.groupBy("project_id").agg(F.array_sort(F.collect_set("apn")).alias("apns"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*observation_order()))
    given = ("units", "stories", "product_type", "age_restriction", "developer", "delivery")
    has = sum((F.when(F.trim(F.col(f).cast("string")) != "", 2**i).otherwise(0) for i, f in enumerate(given)), F.lit(0))
    names = F.array_compact(F.array(*[F.when(F.col("_has").bitwiseAND(2**i) != 0, F.lit(f)) for i, f in enumerate(given)]))
    # what is exchanged of the evidence: its place in the order, and the names of its fields as one number
    evidence = evidence.select("project_id", "evidence_id", "source_type", "tier", "evidence_date", "collected_at", has.alias("_has"))
    last = evidence.withColumn("_r", rank).filter("_r = 1").select("project_id", F.struct("source_type", F.col("evidence_date").cast("string").alias("evidence_date"), F.to_date("collected_at").cast("string").alias("collected_at"), names.alias("fields")).alias("last_evidence"))
    rows = projects.join(known, "jurisdiction_id", "left").join(apns, "project_id", "left").join(last, "project_id", "left")
    return rows.select("project_id", F.coalesce("name", "address").alias("project_name"), F.col("address").alias("canonical_address"), "developer", "units", "product_type", "jurisdiction", F.coalesce("apns", F.array().cast("array<string>")).alias("apns"), "last_evidence")
