"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import filters as op
from siltstone.operators.ranking import first_row
from siltstone.registry import query
from siltstone.session import table


@query("SELECT project_id, name, market_id FROM project WHERE status_rank NOT IN (5, 6) AND market_id = 2", "project")
def active_scoped_projects(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return op.scoped(project.filter(~F.col("status_rank").isin(5, 6)), market_id=2).select("project_id", "name", "market_id")


@query(
    """SELECT evidence_id, source_type, tier FROM evidence WHERE NOT superseded AND source_type IN ('city_permit', 'news_article') AND evidence_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""",
    "evidence",
)
def active_evidence_window(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    days = op.within_days(F.col("evidence_date"), F.lit("1996-01-01").cast("date"), F.lit("1997-06-30").cast("date"))
    return op.where_given(evidence.filter(~F.col("superseded") & days), source_type=["city_permit", "news_article"], tier=None).select("evidence_id", "source_type", "tier")


@query(
    """WITH latest AS (SELECT project_id, units AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY evidence_date DESC NULLS LAST, collected_at DESC, evidence_id DESC) AS r FROM evidence WHERE NOT superseded) WHERE r = 1)
       SELECT p.project_id, p.units AS current, l.resolved FROM project p LEFT JOIN latest l ON p.project_id = l.project_id WHERE p.units IS DISTINCT FROM l.resolved""",
    "project", "evidence",
)
def null_safe_changes(spark, sf_dir):
    project, evidence = views(spark, sf_dir, "project", "evidence")
    latest = first_row(evidence.filter("NOT superseded"), ["project_id"], [F.desc_nulls_last("evidence_date"), F.desc("collected_at"), F.desc("evidence_id")])
    joined = project.select("project_id", F.col("units").alias("current")).join(latest.select("project_id", F.col("units").alias("resolved")), "project_id", "left")
    return joined.filter(op.differs(F.col("current"), F.col("resolved")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_key_filter(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k > 90")


@query(
    """SELECT o.o_orderkey AS item_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
         AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')"""
)
def dismissed_records(spark, sf_dir):
    items, lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), table(spark, sf_dir, "lineitem")
    returned = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    opened = lines.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("item_id"))
    return items.join(returned, "item_id", "left_semi").join(opened, "item_id", "left_anti")


@query(
    """SELECT project_id FROM project WHERE contains(lower(concat_ws(' ', name, developer)), 'ring') AND status_rank IN (1, 2, 3) AND market_id = 1 AND coalesce(units, 0) BETWEEN 5 AND 40
         AND lat IS NOT NULL AND lng IS NOT NULL""",
    "project",
)
def dashboard_multi_filter(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    rows = op.where_given(project, status_rank=[1, 2, 3], market_id=1, developer=None)
    return rows.filter(op.contains_text("RING", F.col("name"), F.col("developer")) & F.coalesce("units", F.lit(0)).between(5, 40) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("project_id")


@query(
    """SELECT item_id FROM review_item WHERE item_type = 'field_change' AND state = 'committed' AND contains(lower(concat_ws(' ', priority, item_type, state)), 'high field')""",
    "review_item",
)
def reviewed_rows_filter(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    rows = op.where_given(items, item_type="field_change", state="committed")
    return rows.filter(op.contains_text("high field", F.col("priority"), F.col("item_type"), F.col("state"))).select("item_id")


@query(
    """SELECT event_id, event_type FROM activity WHERE source_id % 3 = 0 AND event_type IN ('click', 'signup') AND occurred_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 23:59:59.999999'""",
    "activity",
)
def change_note_status_row_filters(spark, sf_dir):
    from siltstone.functions.dates import day_bounds

    (events,) = views(spark, sf_dir, "activity")
    days = day_bounds(F.col("occurred_at").cast("timestamp"), "2024-01-05", "2024-01-07")
    return op.where_given(events.filter(days & (F.col("source_id") % 3 == 0)), event_type=["click", "signup"]).select("event_id", "event_type")


@query(
    """SELECT project_id, (address IS NOT NULL OR (developer IS NOT NULL AND units IS NOT NULL)) AND (CASE WHEN status_rank > 3 THEN 'high' WHEN status_rank > 1 THEN 'medium' ELSE 'low' END) IN ('high', 'medium') AND (units IS NULL OR units >= 10) AS is_new
       FROM project""",
    "project",
)
def new_candidate_gate(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    confidence = F.when(F.col("status_rank") > 3, "high").when(F.col("status_rank") > 1, "medium").otherwise("low")
    return project.select("project_id", op.is_new_candidate(F.col("address"), F.lit(None), F.col("developer"), F.col("units"), confidence).alias("is_new"))


@query(
    """WITH e AS (SELECT evidence_id, source_type, CASE CAST(evidence_id % 5 AS INT) WHEN 0 THEN 'Issued' WHEN 1 THEN ' Expired ' WHEN 2 THEN NULL WHEN 3 THEN 'On Ice' ELSE 'VOID' END AS status FROM evidence)
       SELECT evidence_id, source_type = 'city_permit' AND lower(trim(coalesce(status, ''))) NOT IN ('expired', 'void') AS benign,
              source_type = 'city_permit' AND lower(trim(coalesce(status, ''))) = 'on ice' AS alert FROM e""",
    "evidence",
)
def benign_paperwork(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    status = F.element_at(F.array(F.lit("Issued"), F.lit(" Expired "), F.lit(None), F.lit("On Ice"), F.lit("VOID")), (F.col("evidence_id") % 5).cast("int") + 1)
    return evidence.select("evidence_id", op.paperwork(F.col("source_type"), status).alias("p")).select("evidence_id", "p.benign", "p.alert")


@query(
    """SELECT evidence_id, coalesce(abs(e.units - p.units) / greatest(abs(p.units), 1) > 0.10, FALSE) AS material, coalesce(e.units <> p.units AND abs(e.units - p.units) / greatest(abs(p.units), 1) > 0.5, FALSE) AS agent_trigger
       FROM evidence e JOIN project p ON e.project_id = p.project_id WHERE NOT superseded""",
    "evidence", "project",
)
def material_unit_delta(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "evidence", "project")
    rows = evidence.filter("NOT superseded").select("evidence_id", "project_id", "units").join(project.select("project_id", F.col("units").alias("current")), "project_id")
    return rows.select("evidence_id", op.material_delta(F.col("current"), F.col("units")).alias("material"), op.exceeds_delta(F.col("current"), F.col("units"), 0.5).alias("agent_trigger"))
