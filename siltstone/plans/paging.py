"""Feeds, pages, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import feed as op
from siltstone.operators.ranking import best_by
from siltstone.registry import query

_FEED = """feed AS (SELECT epoch_us(occurred_at) AS at_us, 'event' AS type, event_id AS id FROM activity UNION ALL SELECT epoch_us(created_at), 'item', item_id FROM review_item UNION ALL SELECT epoch_us(collected_at), 'evidence', evidence_id FROM evidence)"""
_ORDER = [("at_us", False), ("type", True), ("id", True)]


def _feed(spark, sf_dir, wanted=None):
    events, items, evidence = views(spark, sf_dir, "activity", "review_item", "evidence")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at_us")
    arms = {
        "event": events.select(micros("occurred_at"), F.col("event_id").alias("id")), "item": items.select(micros("created_at"), F.col("item_id").alias("id")),
        "evidence": evidence.select(micros("collected_at"), F.col("evidence_id").alias("id")),
    }
    return op.feed(arms, wanted)


@query(f"WITH {_FEED} SELECT * FROM feed ORDER BY at_us DESC, type, id LIMIT 26", "activity", "review_item", "evidence")
def activity_union_first_page(spark, sf_dir):
    return op.page(_feed(spark, sf_dir), _ORDER, 25)


@query(
    f"""WITH {_FEED} SELECT * FROM feed WHERE at_us < 1704100000000000 OR (at_us = 1704100000000000 AND type > 'event') OR (at_us = 1704100000000000 AND type = 'event' AND id > 5) ORDER BY at_us DESC, type, id LIMIT 26""",
    "activity", "review_item", "evidence",
)
def activity_union_keyset(spark, sf_dir):
    scope = {"view": "all"}
    cursor = op.decode_cursor(op.encode_cursor([1704100000000000, "event", 5], scope), scope)
    return op.page(_feed(spark, sf_dir), _ORDER, 25, cursor)


@query(f"WITH {_FEED} SELECT * FROM feed WHERE type = 'item' ORDER BY at_us DESC, id LIMIT 11", "activity", "review_item", "evidence")
def feed_of_one_view(spark, sf_dir):
    return op.page(_feed(spark, sf_dir, {"item", "change"} & {"event", "item", "evidence"}), _ORDER, 10)


@query("SELECT item_id, priority, CAST(created_at AS VARCHAR) AS created FROM review_item WHERE state = 'open' AND jurisdiction_id = 4 ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at, item_id LIMIT 50", "review_item")
def review_queue(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    rows = items.filter("state = 'open' AND jurisdiction_id = 4").orderBy(rank, "created_at", "item_id").limit(50)
    return rows.select("item_id", "priority", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT project_id, address, name FROM project ORDER BY address NULLS LAST, name, project_id LIMIT 40", "project")
def nullable_sort(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return project.orderBy(F.asc_nulls_last("address"), "name", "project_id").limit(40).select("project_id", "address", "name")


@query("SELECT project_id FROM (SELECT DISTINCT project_id FROM review_item WHERE project_id > 300) ORDER BY project_id LIMIT 100", "review_item")
def batch_keyset_fetch(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return items.filter("project_id > 300").select("project_id").distinct().orderBy("project_id").limit(100)


@query("SELECT source_type, tier, arg_max(evidence_id, (units, -evidence_id)) AS best, max(units) AS units FROM evidence GROUP BY source_type, tier", "evidence")
def dedupe_best_per_key(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    return best_by(evidence, ["source_type", "tier"], [-F.col("units"), F.col("evidence_id")], ["evidence_id", "units"]).withColumnRenamed("evidence_id", "best")


@query("SELECT project_id, label, lat, lng FROM (SELECT project_id, CAST(row_number() OVER (PARTITION BY market_id ORDER BY project_id) AS INT) AS label, lat, lng FROM project WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180) WHERE label <= 9", "project")
def candidate_map_points(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    rows = project.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    label = F.row_number().over(Window.partitionBy("market_id").orderBy("project_id"))
    return rows.withColumn("label", label).filter("label <= 9").select("project_id", "label", "lat", "lng")


@query(
    """SELECT project_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT project_id, 'parcel' AS reason FROM evidence WHERE developer_id = 7 UNION ALL SELECT project_id, 'address' FROM project WHERE contains(address, '90015')
         UNION ALL SELECT project_id, 'radius' FROM project WHERE lat < 33.902) GROUP BY project_id""",
    "evidence", "project",
)
def project_union_with_reasons(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "evidence", "project")
    arm = lambda df, reason: df.select("project_id", F.lit(reason).alias("reason"))
    rows = arm(evidence.filter("developer_id = 7"), "parcel").unionByName(arm(project.filter(F.col("address").contains("90015")), "address")).unionByName(arm(project.filter("lat < 33.902"), "radius"))
    return rows.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query(
    """WITH i AS (SELECT DISTINCT CASE WHEN item_id % 13 = 0 THEN project_id + 10000000 ELSE project_id END AS project_id FROM review_item)
       SELECT project_id FROM i WHERE project_id NOT IN (SELECT project_id FROM project WHERE project_id IS NOT NULL) OR project_id % 9 = 0 AND project_id NOT IN (SELECT project_id FROM evidence WHERE tier = 1)""",
    "review_item", "project", "evidence",
)
def unmatched_ids(spark, sf_dir):
    """Ids of items that no project has (a vendor numbers some of its own), and those of a kind without official evidence."""
    items, project, evidence = views(spark, sf_dir, "review_item", "project", "evidence")
    ids = items.select(F.when(F.col("item_id") % 13 == 0, F.col("project_id") + 10_000_000).otherwise(F.col("project_id")).alias("project_id")).distinct()
    unknown = ids.join(project.select("project_id"), "project_id", "left_anti")
    return unknown.union(ids.filter("project_id % 9 = 0").join(evidence.filter("tier = 1").select("project_id"), "project_id", "left_anti")).distinct()


@query("SELECT project_id, string_agg(source_type, ',' ORDER BY source_type) AS merged FROM (SELECT DISTINCT project_id, source_type FROM evidence) GROUP BY project_id", "evidence")
def merged_lists(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    active = F.collect_set(F.when(~F.col("superseded"), F.col("source_type")))
    merged = F.array_distinct(F.concat(active, F.collect_set("source_type")))
    return evidence.groupBy("project_id").agg(F.array_join(F.array_sort(merged), ",").alias("merged"))
