"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import rollup as op
from siltstone.operators.ranking import best_by
from siltstone.registry import query
from siltstone.session import table


@query("SELECT project_id, count(*) AS n FROM review_item WHERE state IN ('open', 'staged') GROUP BY project_id", "review_item")
def open_items_per_project(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return op.bucket_counts(items.filter(F.col("state").isin("open", "staged")), "project_id")


@query("SELECT state, count(*) AS n, CASE state WHEN 'open' THEN 0 WHEN 'staged' THEN 1 WHEN 'committed' THEN 2 ELSE 3 END AS place FROM review_item GROUP BY state", "review_item")
def status_buckets(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return op.bucket_counts(items, "state", ("open", "staged", "committed"))


@query("SELECT item_type, n FROM (SELECT item_type, count(*) AS n FROM review_item GROUP BY item_type) ORDER BY n DESC, item_type LIMIT 4", "review_item")
def top_item_types(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return op.bucket_counts(items, "item_type").orderBy(F.desc("n"), "item_type").limit(4)


@query(
    """SELECT jurisdiction_id, count(*) FILTER (WHERE priority = 'high') AS high, count(*) FILTER (WHERE priority = 'medium') AS medium, count(*) FILTER (WHERE priority = 'low') AS low FROM review_item GROUP BY jurisdiction_id""",
    "review_item",
)
def priority_pivot(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return items.groupBy("jurisdiction_id").pivot("priority", ["high", "medium", "low"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    """SELECT p.project_id, CAST(max(e.evidence_date) AS VARCHAR) AS last_evidence FROM project p JOIN evidence e ON p.project_id = e.project_id WHERE p.status_rank IN (3, 4) AND NOT e.superseded
       GROUP BY p.project_id HAVING max(e.evidence_date) <= DATE '2001-07-01' - INTERVAL 12 MONTH""",
    "project", "evidence",
)
def stalled_projects(spark, sf_dir):
    project, evidence = views(spark, sf_dir, "project", "evidence")
    last = evidence.filter("NOT superseded").groupBy("project_id").agg(F.max("evidence_date").alias("d"))
    rows = project.filter("status_rank IN (3, 4)").select("project_id").join(last, "project_id")
    return rows.filter(F.col("d") <= F.add_months(F.lit("2001-07-01").cast("date"), -12)).select("project_id", F.col("d").cast("string").alias("last_evidence"))


@query(
    """SELECT event_type, day_of_week, n, n_high, n_low, round(n_high / n, 6) AS share_high, round(n_low / n, 6) AS share_low FROM (
         SELECT event_type, CAST(dayofweek(occurred_at) AS INT) + 1 AS day_of_week, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE value < 5) AS n_low FROM activity GROUP BY ALL)""",
    "activity",
)
def semantic_metrics_filtered(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    return op.filtered_metrics(events.withColumn("day_of_week", F.dayofweek("occurred_at")), ["event_type", "day_of_week"], high=F.col("value") > 50, low=F.col("value") < 5)


@query("SELECT status, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus AS status FROM orders) GROUP BY status")
def parse_health(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status")).distinct()
    return op.bucket_counts(rows, "status")


@query(
    """WITH d AS (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'truncated' ELSE 'parse_error' END AS status FROM orders), c AS (SELECT status, count(*) AS n FROM d GROUP BY status)
       SELECT status, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN n END) OVER (), 0) AS DOUBLE) / sum(n) OVER () AS ok_rate, row_number() OVER (ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, n DESC, status) AS place FROM c"""
)
def parse_health_rates(spark, sf_dir):
    """Counts of parse states, ok first, with the share of what is ok."""
    named = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "truncated").otherwise("parse_error")
    return op.parse_health(table(spark, sf_dir, "orders").select("o_custkey", named.alias("status")).distinct(), "status")


@query("SELECT state, count(DISTINCT project_id) AS n_projects, count(DISTINCT jurisdiction_id) AS n_jurisdictions, count(*) AS n FROM review_item GROUP BY state", "review_item")
def distinct_items_by_status(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return items.groupBy("state").agg(F.countDistinct("project_id").alias("n_projects"), F.countDistinct("jurisdiction_id").alias("n_jurisdictions"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS cost_date, event_type AS bucket, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"""
)
def spend_rollup_daily(spark, sf_dir):
    from siltstone.functions.dates import cost_day

    events = table(spark, sf_dir, "events")
    rows = events.select(cost_day(F.col("ts").cast("timestamp")).cast("string").alias("cost_date"), F.col("event_type").alias("bucket"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return op.additive_rollup(rows, ["cost_date", "bucket"], ["cents"])


@query("SELECT source_type, CAST(min(collected_at) AS VARCHAR) AS low, CAST(max(collected_at) AS VARCHAR) AS high, CAST(max(collected_at) - INTERVAL 24 HOUR AS VARCHAR) AS cursor FROM evidence GROUP BY source_type", "evidence")
def watermark_bounds(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    out = evidence.groupBy("source_type").agg(F.min("collected_at").alias("low"), F.max("collected_at").alias("high"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("source_type", text(F.col("low")).alias("low"), text(F.col("high")).alias("high"), text(F.col("high") - F.expr("INTERVAL 24 HOURS")).alias("cursor"))


@query(
    """SELECT string_agg(developer, ',' ORDER BY developer) AS developers, max(units) AS max_units FROM (SELECT developer, max(units) AS units, row_number() OVER (ORDER BY developer) AS r FROM project GROUP BY developer) WHERE r <= 500""",
    "project",
)
def facet_values(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return op.facets(project, ["developer"], ["units"], {"developer": 500}).select(F.array_join("developer", ",").alias("developers"), "max_units")


@query("SELECT project_id, string_agg(CAST(developer_id AS VARCHAR), ',' ORDER BY developer_id) AS ids FROM (SELECT DISTINCT project_id, developer_id FROM evidence) GROUP BY project_id", "evidence")
def identifiers_per_project(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    return evidence.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("developer_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT count(*) AS n, CAST(sum(units) AS BIGINT) AS units, count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS geocoded, count(*) FILTER (WHERE status_rank = 4) AS building FROM project", "project")
def table_totals(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return project.agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("geocoded"), F.count_if(F.col("status_rank") == 4).alias("building"))


@query(
    """WITH p AS (SELECT jurisdiction_id, count(*) AS projects, count(*) FILTER (WHERE status_rank = 4) AS building FROM project GROUP BY jurisdiction_id),
       i AS (SELECT jurisdiction_id, count(*) FILTER (WHERE priority = 'high') AS high, count(*) FILTER (WHERE priority <> 'high') AS rest, CAST(max(created_at) AS VARCHAR) AS latest FROM review_item WHERE state <> 'committed' GROUP BY jurisdiction_id)
       SELECT n_nationkey AS jurisdiction_id, n_name AS name, coalesce(projects, 0) AS projects, coalesce(building, 0) AS building, coalesce(high, 0) AS high, coalesce(rest, 0) AS rest, latest,
              CASE WHEN coalesce(high, 0) > 50 THEN 'high' WHEN coalesce(high, 0) + coalesce(rest, 0) > 0 THEN 'medium' ELSE 'none' END AS severity
       FROM nation n LEFT JOIN p ON n.n_nationkey = p.jurisdiction_id LEFT JOIN i ON n.n_nationkey = i.jurisdiction_id""",
    "project", "review_item",
)
def coverage_by_jurisdiction(spark, sf_dir):
    project, items = views(spark, sf_dir, "project", "review_item")
    p = project.groupBy("jurisdiction_id").agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("status_rank") == 4).alias("building"))
    i = items.filter("state <> 'committed'").groupBy("jurisdiction_id").agg(F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("priority") != "high").alias("rest"), F.max("created_at").alias("latest"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("jurisdiction_id"), F.col("n_name").alias("name"))
    rows = places.join(p, "jurisdiction_id", "left").join(i, "jurisdiction_id", "left").na.fill(0, ["projects", "building", "high", "rest"])
    severity = F.when(F.col("high") > 50, "high").when(F.col("high") + F.col("rest") > 0, "medium").otherwise("none")
    return rows.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss")).withColumn("severity", severity)


@query(
    """WITH f AS (SELECT project_id, 'pipeline_status' AS field, CASE WHEN max(status_rank) > 5 THEN 'high' WHEN max(status_rank) > 3 THEN 'medium' ELSE 'low' END AS confidence FROM evidence GROUP BY project_id
         UNION ALL SELECT project_id, 'total_units', CASE WHEN min(tier) = 1 THEN 'high' ELSE 'low' END FROM evidence WHERE source_type <> 'vendor_b' GROUP BY project_id
         UNION ALL SELECT project_id, 'developer', CASE WHEN count(DISTINCT developer_id) > 3 THEN 'low' ELSE 'medium' END FROM evidence GROUP BY project_id)
       SELECT project_id, CASE WHEN coalesce(bool_or(field = 'pipeline_status' AND confidence = 'high'), FALSE) AND count(*) FILTER (WHERE confidence = 'low') = 0 THEN 'high'
         WHEN count(*) FILTER (WHERE confidence = 'low') >= 2 OR coalesce(bool_or(field = 'pipeline_status' AND confidence = 'low'), FALSE) THEN 'low' ELSE 'medium' END AS overall, count(*) FILTER (WHERE confidence = 'low') AS n_low,
         string_agg(field || '=' || confidence, ',' ORDER BY field) AS by_field FROM f GROUP BY project_id""",
    "evidence",
)
def overall_confidence(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    facts = evidence.groupBy("project_id").agg(F.max("status_rank").alias("rank"), F.min(F.when(F.col("source_type") != "vendor_b", F.col("tier"))).alias("tier"), F.countDistinct("developer_id").alias("devs"))
    fields = F.array_compact(F.array(
        F.struct(F.lit("pipeline_status").alias("field"), F.when(F.col("rank") > 5, "high").when(F.col("rank") > 3, "medium").otherwise("low").alias("confidence")),
        F.when(F.col("tier").isNotNull(), F.struct(F.lit("total_units").alias("field"), F.when(F.col("tier") == 1, "high").otherwise("low").alias("confidence"))),
        F.struct(F.lit("developer").alias("field"), F.when(F.col("devs") > 3, "low").otherwise("medium").alias("confidence")),
    ))
    by_field = F.array_join(F.transform(F.array_sort(fields), lambda x: F.concat(x["field"], F.lit("="), x["confidence"])), ",")
    out = op.overall_confidence(facts.select("project_id", F.inline(fields)), "project_id")
    return out.join(facts.select("project_id", by_field.alias("by_field")), "project_id")


@query(
    """SELECT project_id, item_type, priority, ids[1] AS survivor, array_to_string(ids[2:], ',') AS invalid FROM (
         SELECT project_id, item_type, priority, list(item_id ORDER BY created_at, item_id) AS ids FROM review_item GROUP BY project_id, item_type, priority) WHERE len(ids) > 1""",
    "review_item",
)
def duplicate_collapse(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    out = op.duplicate_groups(items, ["project_id", "item_type", "priority"], F.col("created_at"), "item_id")
    return out.withColumn("invalid", F.array_join(F.transform("invalid", lambda x: x.cast("string")), ","))


@query(
    """SELECT * FROM (SELECT 'evidence' AS kind, CAST(evidence_id AS BIGINT) AS id, CAST(collected_at AS VARCHAR) AS "at" FROM evidence ORDER BY collected_at DESC, evidence_id LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'item', CAST(item_id AS BIGINT), CAST(created_at AS VARCHAR) FROM review_item ORDER BY created_at DESC, item_id LIMIT 5) ORDER BY "at" DESC, kind, id LIMIT 5""",
    "evidence", "review_item",
)
def recent_activity_top5(spark, sf_dir):
    evidence, items = views(spark, sf_dir, "evidence", "review_item")
    newest = lambda df, kind, key, at: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(at).alias("at")).orderBy(F.desc("at"), "id").limit(5)
    both = newest(evidence, "evidence", "evidence_id", "collected_at").unionByName(newest(items, "item", "item_id", "created_at"))
    return both.orderBy(F.desc("at"), "kind", "id").limit(5).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT o_custkey AS source_id, CAST(sum(coalesce(CASE WHEN o_orderstatus = 'O' THEN 1 END, 0) + coalesce(CASE WHEN o_orderstatus = 'F' THEN 2 END, 0)) AS BIGINT) AS changed FROM orders GROUP BY o_custkey")
def rows_changed_sum(spark, sf_dir):
    inserted, updated = F.when(F.col("o_orderstatus") == "O", 1), F.when(F.col("o_orderstatus") == "F", 2)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.sum(F.coalesce(inserted, F.lit(0)) + F.coalesce(updated, F.lit(0))).alias("changed"))


@query(
    """SELECT status_rank AS current_rank, units % 3 AS proposed, count(*) AS n, min(project_id) AS first_project FROM project WHERE units % 3 < status_rank GROUP BY ALL""",
    "project",
)
def regression_groups(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    rows = project.withColumn("proposed", F.col("units") % 3).filter("proposed < status_rank")
    return rows.groupBy(F.col("status_rank").alias("current_rank"), "proposed").agg(F.count(F.lit(1)).alias("n"), F.min("project_id").alias("first_project"))


@query(
    """WITH c AS (SELECT jurisdiction_id, project_id, CAST(round(amount) AS BIGINT) AS likelihood FROM review_item WHERE item_type = 'possible_match')
       SELECT p.project_id, greatest(0.02, least(0.98, round(1 - coalesce(max(c.likelihood) / 1000000.0, 0), 6))) AS probability FROM project p LEFT JOIN c ON p.project_id = c.project_id GROUP BY p.project_id""",
    "project", "review_item",
)
def new_candidate_probability(spark, sf_dir):
    project, items = views(spark, sf_dir, "project", "review_item")
    best = items.filter("item_type = 'possible_match'").groupBy("project_id").agg(F.max(F.round("amount").cast("long")).alias("best"))
    p = F.round(1 - F.coalesce(F.col("best") / 1000000.0, F.lit(0.0)), 6)
    return project.select("project_id").join(best, "project_id", "left").select("project_id", F.greatest(F.lit(0.02), F.least(F.lit(0.98), p)).alias("probability"))


@query(
    """SELECT source_id, arg_max(event_type, (epoch_us(occurred_at), event_id)) AS last_type, count(DISTINCT event_type) AS kinds FROM activity GROUP BY source_id""",
    "activity",
)
def latest_run_by_source(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    last = best_by(events, ["source_id"], [-F.unix_micros(F.col("occurred_at").cast("timestamp")), -F.col("event_id")], ["event_type"])
    return last.withColumnRenamed("event_type", "last_type").join(events.groupBy("source_id").agg(F.countDistinct("event_type").alias("kinds")), "source_id")
