"""Queries that write tables batch by batch and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.model import views
from siltstone.operators import ledger as op
from siltstone.registry import query
from siltstone.session import ensure_checkpoint_dir
from siltstone.streaming.ingest import stream_table


def new_ledger(spark, rows, keys):
    """A ledger in a new folder for rows of this schema."""
    schema = T.StructType([*rows.schema.fields, T.StructField("action", T.StringType())])
    return op.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", schema, keys)


def _evidence(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "fielded")
    hash_ = F.sha2(F.concat_ws("-", "status_rank", F.col("units") % 3), 256)
    own = F.col("evidence_id") * 1_000_000 + F.col("project_id")  # lines of the test table share their numbers
    return rows.select("source_type", "record_id", hash_.alias("hash"), own.alias("evidence_id"), F.when(F.col("evidence_id") % 5 != 0, F.col("project_id")).alias("project_id")).distinct()


def _before(i: int) -> str:
    return str(i - 1) if i else "_0"


def _step(i: int) -> str:
    """The evidence after batch i, from that after the batch before."""
    return f"""b{i} AS (SELECT * FROM inc WHERE batch = {i}),
      o{i} AS (SELECT k, min(evidence_id) AS w FROM s{_before(i)} WHERE project_id IS NULL GROUP BY k),
      f{i} AS (SELECT k, min(evidence_id) AS w FROM b{i} WHERE project_id IS NULL AND k NOT IN (SELECT k FROM o{i}) GROUP BY k),
      w{i} AS (SELECT * FROM o{i} UNION ALL SELECT * FROM f{i}),
      n{i} AS (SELECT k, project_id, min(evidence_id) AS e FROM b{i} x WHERE project_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s{_before(i)} y WHERE y.k = x.k AND y.project_id = x.project_id) GROUP BY k, project_id),
      r{i} AS (SELECT n.*, w.w, row_number() OVER (PARTITION BY n.k ORDER BY e) = 1 AND w.w IS NOT NULL AS links FROM n{i} n LEFT JOIN w{i} w ON w.k = n.k),
      h{i} AS (SELECT k, evidence_id, project_id, batch FROM s{_before(i)} UNION ALL SELECT k, w, NULL, {i} FROM f{i}),
      s{i} AS (SELECT h.k, h.evidence_id, coalesce(h.project_id, r.project_id) AS project_id, h.batch FROM h{i} h LEFT JOIN r{i} r ON r.links AND r.k = h.k AND r.w = h.evidence_id AND h.project_id IS NULL UNION ALL SELECT k, e, project_id, {i} FROM r{i} WHERE NOT links)"""


@query(
    f"""WITH inc AS (SELECT DISTINCT concat(source_type, '|', record_id, '|', sha256(concat(status_rank, '-', units % 3))) AS k, evidence_id * 1000000 + project_id AS evidence_id, CASE WHEN evidence_id % 5 <> 0 THEN project_id END AS project_id, evidence_id // 10 % 3 AS batch FROM fielded),
      s_0 AS (SELECT k, evidence_id, project_id, batch FROM inc WHERE false), {", ".join(_step(i) for i in range(3))}
      SELECT k, evidence_id, project_id, CAST(batch AS BIGINT) AS batch FROM s2""",
    "fielded",
)
def evidence_ledger(spark, sf_dir):
    """Evidence written in three batches, the second of them twice, and read back with the projects that it was linked to."""
    rows = _evidence(spark, sf_dir)
    ledger = new_ledger(spark, rows, op.EVIDENCE_KEYS)
    rows = rows.checkpoint()  # each batch reads its rows several times
    for batch in (0, 1, 1, 2):
        ledger.add(batch, rows.filter(F.floor(F.col("evidence_id") / 10_000_000) % 3 == batch), op.evidence_decisions, "feed")
    return op.evidence_state(ledger.rows()).select(F.concat_ws("|", *op.EVIDENCE_KEYS).alias("k"), "evidence_id", "project_id", "batch")


@query(
    """WITH inc AS (SELECT record_id, evidence_id % 3 AS batch, CAST(min(evidence_id // 10) % 2 AS BIGINT) AS mapped FROM fielded GROUP BY ALL),
      c AS (SELECT *, mapped IS DISTINCT FROM lag(mapped) OVER (PARTITION BY record_id ORDER BY batch) AS differs FROM inc)
      SELECT record_id, arg_max(mapped, batch) AS mapped, CAST(max(CASE WHEN differs THEN batch END) AS BIGINT) AS batch, CASE WHEN count(CASE WHEN differs THEN 1 END) > 1 THEN 'update' ELSE 'insert' END AS action FROM c GROUP BY record_id""",
    "fielded",
)
def record_ledger(spark, sf_dir):
    """Source records upserted in three batches: the latest mapped value, and the batch that changed it last."""
    (rows,) = views(spark, sf_dir, "fielded")
    rows = rows.groupBy("record_id", (F.col("evidence_id") % 3).alias("batch")).agg((F.min(F.floor(F.col("evidence_id") / 10)) % 2).alias("mapped"))
    ledger = new_ledger(spark, rows.drop("batch"), ("record_id",))
    for batch in (0, 1, 2):
        ledger.add(batch, rows.filter(F.col("batch") == batch).drop("batch"), op.changed(("record_id",), ("mapped",)))
    return op.latest(ledger.rows(), ("record_id",))


@query(
    """WITH e AS (SELECT event_type AS key, CASE WHEN source_id % 3 > 0 THEN concat('s', source_id % 40) ELSE '{}' END AS scope, occurred_at AS t, event_id AS id, concat('v', CAST(floor(value) AS BIGINT) % 3) AS severity, event_id % 6 = 0 AS cleared, event_id % 3 AS batch FROM activity),
      o AS (SELECT *, row_number() OVER (PARTITION BY key, scope ORDER BY batch, t, id) AS n FROM e),
      c AS (SELECT *, coalesce(max(CASE WHEN cleared THEN n END) OVER (PARTITION BY key, scope), 0) AS done FROM o)
      SELECT key, scope, arg_min(t, n) AS opened_at, arg_max(t, n) AS last_seen, arg_max(severity, n) AS severity, count(*) AS times FROM c WHERE n > done GROUP BY key, scope""",
    "activity",
)
def alert_ledger(spark, sf_dir):
    """Alerts raised and cleared in three batches: one open alert for each key and scope, with its first and last time."""
    (rows,) = views(spark, sf_dir, "activity")
    scope = F.when(F.col("source_id") % 3 > 0, F.concat(F.lit("s"), F.col("source_id") % 40))
    events = rows.select(F.col("event_type").alias("key"), scope.alias("scope"), F.col("occurred_at").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("v"), F.floor("value") % 3).alias("severity"), (F.col("event_id") % 6 == 0).alias("cleared"))
    kept = events.select("key", "scope", F.col("at").alias("opened_at"), F.col("at").alias("last_seen"), "severity", F.lit(0).cast("long").alias("times"), F.lit(True).alias("open"))
    ledger = new_ledger(spark, kept, op.ALERT_KEYS)
    for batch in (0, 1, 2):
        op.add_alerts(ledger, batch, events.filter(F.col("id") % 3 == batch))
    return op.latest(ledger.rows(), op.ALERT_KEYS).filter("open").select("key", "scope", "opened_at", "last_seen", "severity", "times")


@query("SELECT DISTINCT event_id, user_id AS source_id, event_type FROM events")
def event_stream_ledger(spark, sf_dir):
    """A stream that delivers every event twice, written once."""
    events = stream_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), "event_type")
    ledger = new_ledger(spark, events, ("event_id",))
    op.stream_into(events.unionAll(events), ledger, op.first_of_key(("event_id",), "event_type"), f"{ledger.folder}/progress")
    return ledger.rows().select("event_id", "source_id", "event_type")
