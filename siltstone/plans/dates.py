"""Date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import dates
from siltstone.model import views
from siltstone.registry import query


@query(
    """SELECT project_id, CAST(CASE project_id % 4 WHEN 0 THEN make_date(2027, 8, 1) WHEN 1 THEN make_date(2027, 11, 1) WHEN 2 THEN make_date(2026, 4, 1) END AS VARCHAR) AS target,
         CAST(make_date(2000 + units, CASE WHEN status_rank BETWEEN 1 AND 12 THEN status_rank ELSE 1 END, 1) AS VARCHAR) AS delivery FROM project""",
    "project",
)
def delivery_phrases(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    phrase = F.element_at(F.array(F.lit("Q3 2027"), F.lit("late 2027"), F.lit("Spring 2026"), F.lit("soon")), (F.col("project_id") % 4).cast("int") + 1)
    delivery = dates.delivery_date(2000 + F.col("units"), F.col("status_rank").cast("string"))
    return project.select("project_id", dates.delivery_target(phrase).cast("string").alias("target"), delivery.cast("string").alias("delivery"))


@query(
    """SELECT item_id, CAST(date_trunc('month', CAST(created_at AS DATE) - INTERVAL 12 MONTH) AS DATE)::VARCHAR AS cut FROM review_item""",
    "review_item",
)
def month_cutoffs(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return items.select("item_id", dates.months_ago(F.to_date("created_at"), 12).cast("string").alias("cut"))


@query("SELECT event_id, CAST(CAST(concat('0x', substr(sha256(concat(event_type, ':', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'))), 1, 16)) AS UBIGINT) % 901 AS BIGINT) AS seconds FROM activity", "activity")
def schedule_jitter(spark, sf_dir):
    (events,) = views(spark, sf_dir, "activity")
    return events.select("event_id", dates.jitter_seconds(F.col("event_type"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), 900).alias("seconds"))
