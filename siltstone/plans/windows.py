"""Latest-row and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators.ranking import best_by, first_row, leading_streak, top_rows, unique_top
from siltstone.registry import query
from siltstone.session import table


@query(
    """SELECT project_id, evidence_id, source_type, CAST(evidence_date AS VARCHAR) AS evidence_date, units FROM (
         SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY evidence_date DESC NULLS LAST, collected_at DESC, evidence_id DESC) AS r FROM evidence WHERE NOT superseded) WHERE r = 1""",
    "evidence",
)
def latest_evidence_per_project(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    order = [F.desc_nulls_last("evidence_date"), F.desc("collected_at"), F.desc("evidence_id")]
    return first_row(evidence.filter("NOT superseded"), ["project_id"], order).select("project_id", "evidence_id", "source_type", F.col("evidence_date").cast("string").alias("evidence_date"), "units")


@query(
    """SELECT source_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY source_id, event_type ORDER BY occurred_at DESC, event_id DESC) AS r FROM activity) WHERE r = 1""",
    "activity",
)
def latest_resolution_per_field(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    return first_row(events, ["source_id", "event_type"], [F.desc("occurred_at"), F.desc("event_id")]).select("source_id", "event_type", "event_id", "value")


@query(
    """SELECT project_id, item_id, priority FROM (
         SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN state = 'committed' THEN created_at END DESC NULLS LAST, created_at DESC, item_id DESC) AS r FROM review_item)
       WHERE r = 1 AND state = 'committed'""",
    "review_item",
)
def accepted_latest_decision(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    committed = F.when(F.col("state") == "committed", F.col("created_at"))
    latest = first_row(items, ["project_id"], [committed.desc_nulls_last(), F.desc("created_at"), F.desc("item_id")])
    return latest.filter("state = 'committed'").select("project_id", "item_id", "priority")


@query(
    """SELECT project_id, item_id, state FROM (
         SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, item_id DESC) AS r FROM review_item WHERE item_type <> 'possible_match') WHERE r = 1""",
    "review_item",
)
def latest_decision_without_deferred(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return first_row(items.filter("item_type <> 'possible_match'"), ["project_id"], [F.desc("created_at"), F.desc("item_id")]).select("project_id", "item_id", "state")


@query(
    """SELECT source, gate, doc_id FROM (
         SELECT d.source, CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 2 ELSE 3 END AS gate, d.doc_id,
                row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 2 ELSE 3 END, d.n_chars DESC, d.doc_id) AS r
         FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE r = 1"""
)
def gate_priority_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    gated = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("gate", F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3))
    return best_by(gated, ["source"], [F.col("gate"), -F.col("n_chars"), F.col("doc_id")], ["gate", "doc_id"]).select("source", "gate", "doc_id")


@query(
    """SELECT source_id, epoch_us(max(CASE WHEN event_type = 'signup' THEN occurred_at END)) AS last_signup, epoch_us(max(CASE WHEN event_type = 'error' THEN occurred_at END)) AS last_error,
              epoch_us(max(occurred_at)) AS last_any FROM activity GROUP BY source_id""",
    "activity",
)
def source_health(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    micros = lambda c: F.unix_micros(F.max(c).cast("timestamp"))
    last = lambda kind: micros(F.when(F.col("event_type") == kind, F.col("occurred_at")))
    return events.groupBy("source_id").agg(last("signup").alias("last_signup"), last("error").alias("last_error"), micros(F.col("occurred_at")).alias("last_any"))


@query(
    """SELECT project_id, evidence_id, rank FROM (
         SELECT project_id, evidence_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY least(coalesce(evidence_date, CAST(collected_at AS DATE)), CAST(collected_at AS DATE)) DESC,
           CAST(epoch(collected_at) AS BIGINT) DESC, CASE source_type WHEN 'city_permit' THEN 0 WHEN 'vendor_a' THEN 1 WHEN 'vendor_b' THEN 2 ELSE 3 END, tier, evidence_id) AS INT) AS rank
         FROM evidence WHERE NOT superseded) WHERE rank <= 3""",
    "evidence",
)
def observation_ranking(spark, sf_dir):
    from siltstone.operators.resolution import observation_order

    (evidence,) = views(spark, sf_dir, "evidence")
    return top_rows(evidence.filter("NOT superseded"), ["project_id"], observation_order(), 3, "rank").select("project_id", "evidence_id", "rank")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM activity)
       SELECT source_id, CAST(coalesce(min(CASE WHEN event_type = 'signup' THEN n END), count(*) + 1) - 1 AS BIGINT) AS streak FROM r WHERE n <= 10 GROUP BY source_id""",
    "activity",
)
def failing_streak(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    return leading_streak(events, "source_id", [F.desc("occurred_at"), F.desc("event_id")], F.col("event_type") != "signup", 10)


@query(
    """SELECT project_id, evidence_id, n FROM (SELECT e.project_id, e.evidence_id, CAST(row_number() OVER (PARTITION BY e.project_id ORDER BY e.evidence_date DESC NULLS LAST, e.evidence_id DESC) AS INT) AS n
         FROM evidence e JOIN project p ON e.project_id = p.project_id AND e.status_rank = p.status_rank WHERE NOT e.superseded) WHERE n <= 2""",
    "evidence", "project",
)
def support_evidence_top2(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "evidence", "project")
    same = evidence.filter("NOT superseded").join(project.select("project_id", "status_rank"), ["project_id", "status_rank"])
    return top_rows(same, ["project_id"], [F.desc_nulls_last("evidence_date"), F.desc("evidence_id")], 2, "n").select("project_id", "evidence_id", "n")


@query(
    """WITH m AS (SELECT market_id, max(round(price, 2)) AS top FROM project GROUP BY market_id),
       t AS (SELECT p.market_id, m.top, count(*) AS n_top FROM project p JOIN m ON p.market_id = m.market_id AND round(p.price, 2) = m.top GROUP BY p.market_id, m.top)
       SELECT market_id, top, n_top, CASE WHEN n_top = 1 AND top >= 1000 THEN 'confirmed' WHEN top >= 500 THEN 'possible' ELSE 'none' END AS verdict FROM t""",
    "project",
)
def unique_top_guard(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return unique_top(project, "market_id", "price", 2, 1000, 500)


@query(
    """WITH cap AS (SELECT day, source_id, CAST(sum(value) AS DOUBLE) AS spent FROM activity GROUP BY day, source_id),
       rule(low, high, hard) AS (VALUES (DATE '2024-01-01', DATE '2024-01-10', 100.0), (DATE '2024-01-08', DATE '2024-01-20', 150.0), (DATE '2024-01-01', DATE '2099-01-01', 500.0))
       SELECT CAST(day AS VARCHAR) AS day, source_id, hard FROM (SELECT day, source_id, CAST(hard AS DOUBLE) AS hard, row_number() OVER (PARTITION BY day, source_id ORDER BY low DESC, hard DESC) AS r
       FROM cap JOIN rule ON day BETWEEN low AND high) WHERE r = 1""",
    "activity",
)
def active_cap(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    keys = events.select("day", "source_id").distinct()
    rules = spark.createDataFrame([("2024-01-01", "2024-01-10", 100.0), ("2024-01-08", "2024-01-20", 150.0), ("2024-01-01", "2099-01-01", 500.0)], "low string, high string, hard double")
    rules = F.broadcast(rules.select(F.to_date("low").alias("low"), F.to_date("high").alias("high"), "hard"))  # three rows
    return first_row(keys.join(rules, F.col("day").between(F.col("low"), F.col("high"))), ["day", "source_id"], [F.desc("low"), F.desc("hard")]).select(F.col("day").cast("string").alias("day"), "source_id", "hard")
