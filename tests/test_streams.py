"""Folds and streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators.budget import reserve
from siltstone.streaming.budget import reserve_stream

SF = "/root/testdata/sf0.001"


def test_rejected_requests_add_nothing(spark):
    rows = spark.createDataFrame([("a", "d", i, i, c) for i, c in enumerate([60, 50, 30, 10, 1])] + [("b", "d", 9, 9, 200)], "bucket string, day string, at_us long, event_id long, cents long")
    got = {r.event_id: (r.spent, r.accepted, r.warned) for r in reserve(rows, 80, 100).collect()}
    assert got == {0: (60, True, False), 1: (60, False, True), 2: (90, True, True), 3: (100, True, True), 4: (100, False, True), 9: (0, False, True)}


def test_stream_keeps_each_event_once(spark):
    got = catalog.queries()["stream_incremental_dedupe"](spark, SF)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


@pytest.fixture
def arrivals(spark, tmp_path):
    """Requests of three days in four files, in order of time."""
    rows = [(f"b{i % 3}", f"2024-01-0{1 + i // 50}", i * 5_000, i, (i * 37) % 90) for i in range(150)]
    rows = spark.createDataFrame(rows, "bucket string, day string, s long, event_id long, cents long").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s"))).drop("s")
    for k in range(4):
        rows.filter((F.col("event_id") >= 40 * k) & (F.col("event_id") < 40 * k + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def run(spark, folder, out, progress, batches=None):
    """Run the fold on the folder's files, one file a micro-batch; None: to the end."""
    stream = reserve_stream(spark.readStream.schema("bucket string, day string, event_id long, cents long, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder), 400, 600)
    calls = []

    def write(rows, n):
        calls.append(n)
        if batches is not None and len(calls) > batches:
            raise ValueError("lost")
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def test_stream_fold_equals_batch_fold(spark, arrivals, tmp_path):
    """Four micro-batches, broken off in the third and started again from their state, give what one batch gives."""
    rows, folder = arrivals
    names = ["bucket", "day", "event_id", "cents", "spent", "accepted", "warned"]
    want = sorted(map(tuple, reserve(rows.withColumn("at_us", F.unix_micros("at")), 400, 600).select(names).collect()))
    out, progress = str(tmp_path / "out"), str(tmp_path / f"p-{uuid.uuid4().hex}")
    with pytest.raises(Exception, match="lost"):
        run(spark, folder, out, progress, 2)
    assert 0 < spark.read.parquet(out).count() < 150
    run(spark, folder, out, progress)
    assert sorted(map(tuple, spark.read.parquet(out).select(names).collect())) == want
    assert any(not r[5] for r in want) and any(r[5] and r[6] for r in want)


def test_stream_query_equals_batch_query(spark):
    one, other = (catalog.queries()[n](spark, SF) for n in ("budget_reserve_stream", "budget_reserve_fold"))
    assert one.columns == other.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
