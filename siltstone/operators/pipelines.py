"""Whole runs as one plan: collected records, and references of articles, through matching, writing, resolution and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import fields, matching, news, review, sinks


def collect(records: DataFrame, projects: DataFrame, owners: DataFrame, known: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Records of a source to (a row for each record: match, write and review) and (fields of the projects they touch).

    records: record_id, market_id, address, source_type, tier, evidence_date, collected_at,
    units, developer, hash, evidence_id; owners: (record_id, project_id) of the source;
    known: (record_id, hash) already written. A record is matched by the source's own id,
    then by address; a new one of a known project is written and resolved, one of no project
    becomes a candidate for review.
    """
    source = owners.select("record_id", F.col("project_id").alias("owner"), F.lit(0.99).alias("confidence"), F.lit(False).alias("possible"))
    step = matching.ladder(records, "record_id", ("source", source), ("address", matching.by_address(records, projects, "record_id", "project_id")))
    fresh = records.join(known.select("record_id", "hash"), ["record_id", "hash"], "left_anti").select("record_id", "hash", F.lit(True).alias("_new"))
    routed = records.join(step.select("record_id", "step", "owner", "possible"), "record_id").join(fresh, ["record_id", "hash"], "left")
    action = F.when(F.col("_new").isNull(), "unchanged").when(F.col("step") == "none", "new_candidate").when(F.col("possible"), "possible_match").otherwise("written")
    priority = F.when(action == "possible_match", "medium").when(action == "new_candidate", review.unit_priority(F.col("units")))
    routed = routed.withColumn("action", action).withColumn("priority", priority)
    written = routed.filter("action = 'written'").withColumn("project_id", F.col("owner"))
    touched = projects.join(written.select("project_id").distinct(), "project_id", "left_semi")
    resolved = fields.all_fields(touched, written, ["units", "developer"], as_of)
    return routed.select("record_id", "step", "owner", "action", "priority"), resolved


def integrate(references: DataFrame, projects: DataFrame, existing: DataFrame, carded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of current extractions to (what each becomes) and (cards for what differs on confirmed projects).

    existing: (source_type, record_id, hash, project_id) of written evidence; carded:
    (project_id, field) with an open card, which get no other. Evidence of a reference that
    is already written is not written again.
    """
    current = news.current_references(references)
    matched = news.address_composite(current, projects)
    strong = F.col("units").isNotNull() & (F.col("units") >= 10) & F.col("developer").isNotNull()
    routed = news.ladder(current, [("address", matched.select("reference_id", "status", "project_id", "score"))], F.coalesce(strong, F.lit(False)))
    rows = current.drop("project_id").join(routed.hint("merge"), "reference_id")
    writes = sinks.evidence_writes(rows.filter("status = 'confirmed'").select(F.col("reference_id").alias("evidence_id"), "project_id", F.lit("news_article").alias("source_type"), F.col("article_id").cast("string").alias("record_id"), "hash"), existing)
    became = routed.join(writes.select(F.col("evidence_id").alias("reference_id"), "action").hint("merge"), "reference_id", "left")
    now = projects.select("project_id", F.col("units").alias("_u"))
    cards = rows.filter("status = 'confirmed'").join(now.hint("merge"), "project_id").filter(F.coalesce(F.col("units") != F.col("_u"), F.lit(False)))
    cards = cards.select("project_id", F.lit("units").alias("field"), F.col("units").alias("proposed")).distinct().join(carded.hint("merge"), ["project_id", "field"], "left_anti")
    return became.select("reference_id", "step", "status", "project_id", "action"), cards


def integrate_current(references: DataFrame, identifiers: DataFrame, owned: DataFrame, hints: DataFrame, projects: DataFrame, existing: DataFrame, carded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of current extractions through all steps to (what each becomes) and (cards for what differs on confirmed projects).

    A reference is matched by its numbers, then by the project that the extraction named, then by
    address; what is left is a new candidate or discarded. Evidence of confirmed ones is written
    unless it is there. Units and developer that differ from the project's give a card where none is
    open; of several references that differ alike, one.
    """
    current = news.current_references(references)
    mine = lambda rows: rows.join(current.select("reference_id").hint("merge"), "reference_id", "left_semi")
    composite = news.address_composite(current, projects).select("reference_id", "status", "project_id", "score")
    strong = F.col("units").isNotNull() & (F.col("units") >= 10) & F.col("developer").isNotNull()
    steps = [("identifier", news.identifier_step(mine(identifiers), owned)), ("hint", news.hint_step(mine(hints), projects)), ("address", composite)]
    routed = news.ladder(current, steps, F.coalesce(strong, F.lit(False)))
    confirmed = current.drop("project_id").join(routed.filter("status = 'confirmed'").hint("merge"), "reference_id")
    evidence = confirmed.select(F.col("reference_id").alias("evidence_id"), "project_id", F.lit("news_article").alias("source_type"), F.col("article_id").cast("string").alias("record_id"), "hash")
    became = routed.join(sinks.evidence_writes(evidence, existing).select(F.col("evidence_id").alias("reference_id"), "action").hint("merge"), "reference_id", "left")
    now = projects.select("project_id", F.col("units").cast("string").alias("_units"), F.col("developer").alias("_developer"))
    both = confirmed.join(now.hint("merge"), "project_id")
    differs = lambda f, old: F.when(F.coalesce(F.lower(F.trim(F.col(f).cast("string"))) != F.lower(F.trim(old)), F.lit(False)), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("proposed")))
    cards = both.select("project_id", F.inline(F.array_compact(F.array(differs("units", F.col("_units")), differs("developer", F.col("_developer")))))).distinct()
    return became.select("reference_id", "step", "status", "project_id", "action"), cards.join(carded.hint("merge"), ["project_id", "field"], "left_anti")


def scrape_counters(outcomes: DataFrame) -> DataFrame:
    """Per source, how many of its discovered URLs ended how."""
    return outcomes.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("outcome") == "fetched").alias("fetched"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate"),
    )
