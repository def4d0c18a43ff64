"""Streaming queries and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.dates import cost_day
from siltstone.operators.budget import reserve
from siltstone.registry import query
from siltstone.session import table
from siltstone.streaming.budget import reserve_stream
from siltstone.streaming.ingest import daily, deduplicated, run_to_table, stream_table


@query("SELECT DISTINCT event_id, user_id AS source_id, event_type FROM events")
def stream_incremental_dedupe(spark, sf_dir):
    events = stream_table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    twice = events.unionAll(events)  # every row is delivered twice
    return run_to_table(deduplicated(twice, ["event_id"], "at").select("event_id", F.col("user_id").alias("source_id"), "event_type"))


def _requests(events):
    at = F.col("ts").cast("timestamp")
    return events.select(F.col("event_type").alias("bucket"), cost_day(at).cast("string").alias("day"), at.alias("at"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query()
def budget_reserve_fold(spark, sf_dir):
    return reserve(_requests(table(spark, sf_dir, "events")).withColumn("at_us", F.unix_micros("at")), 20_000, 30_000)


@query()
def budget_reserve_stream(spark, sf_dir):
    """The same fold on the table as a stream, from state."""
    return run_to_table(reserve_stream(_requests(stream_table(spark, sf_dir, "events")), 20_000, 30_000))


@query(
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS calls, CAST(sum(round(value * 100)) AS BIGINT) AS cents FROM events
       WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 24 HOUR) FROM events) GROUP BY ALL"""
)
def daily_stream(spark, sf_dir):
    """Calls and cents of each day, as a stream gives them: days that the watermark has passed."""
    events = stream_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return run_to_table(daily(events, "at", ["event_type"])).withColumn("day", F.col("day").cast("timestamp_ntz"))
