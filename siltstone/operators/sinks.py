"""What idempotent writes do, as tables: evidence, source records, articles and alerts; and loads over several files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ledger import Ledger, first_of_key


def canonical_hash(json: Column) -> Column:
    """SHA-256 of a JSON object as compact text with sorted keys, without keys that begin with a colon."""
    entries = F.array_sort(F.transform(F.map_entries(F.map_filter(F.from_json(json, "map<string,variant>"), lambda k, v: ~k.startswith(":"))), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    body = F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ",")
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def evidence_writes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming rows and what becomes of them: insert, skip (known), or link (a known row without project gets one).

    Known: the same source_type, record_id and hash. Rows that come twice in one load are written once.
    """
    key = ["source_type", "record_id", "hash"]
    first = Window.partitionBy(*key, "project_id").orderBy("evidence_id")
    fresh = incoming.withColumn("_r", F.row_number().over(first))
    known = existing.groupBy(*key).agg(F.max("project_id").alias("_owner"), F.lit(True).alias("_known"))
    action = F.when(F.col("_r") > 1, "skip").when(F.col("_known").isNull(), "insert").when(F.col("_owner").isNull() & F.col("project_id").isNotNull(), "link").otherwise("skip")
    return fresh.join(known.hint("merge"), key, "left").select("evidence_id", "project_id", action.alias("action"))


def record_upsert(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """inserted, updated or unchanged, by hash and mapped fields; both sides have one row for each key."""
    known = existing.select(*keys, F.col("hash").alias("_h"), F.col("mapped").alias("_m"), F.lit(True).alias("_k"))
    same = F.col("hash").eqNullSafe(F.col("_h")) & F.col("mapped").eqNullSafe(F.col("_m"))
    return incoming.join(known, keys, "left").select(*keys, F.when(F.col("_k").isNull(), "inserted").when(same, "unchanged").otherwise("updated").alias("action"))


def article_inserts(found: DataFrame, known: DataFrame) -> DataFrame:
    """Articles whose canonical URL is new, each once (the first found): (url, url_hash, published)."""
    hashed = found.filter("url IS NOT NULL").withColumn("url_hash", F.sha2("url", 256)).join(known.select("url_hash"), "url_hash", "left_anti")
    one = hashed.groupBy("url_hash").agg(F.min_by(F.struct("url", F.coalesce("published", "modified").alias("published")), "place").alias("a"))
    return one.select("a.url", "url_hash", "a.published")


def open_alerts(raised: DataFrame) -> DataFrame:
    """One open alert for each key and scope: the latest severity and message, when first and last seen, and how often."""
    latest = lambda c: F.max_by(c, F.struct("at", "id"))
    return raised.filter("NOT resolved").groupBy("key", F.coalesce("scope", F.lit("{}")).alias("scope")).agg(
        latest(F.col("severity")).alias("severity"), latest(F.col("id")).alias("last_id"), F.count(F.lit(1)).alias("times"),
    )


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows from several files the first of each key; rows without one are left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.filter(F.col(key).isNotNull()).withColumn("_r", rank).filter("_r = 1").drop("_r")


def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by cleaned header text: names maps headers to columns; a header that is missing gives nulls."""
    have = {" ".join(c.split()).lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[h.lower()]}`") if h.lower() in have else F.lit(None).cast("string")).alias(c) for h, c in names.items()])


def route(key: Column, city: Column, status: Column, cities: list, dismissed: list) -> Column:
    """Where a workbook's row goes: blank (no key), other_city, dismissed or project."""
    return F.when(key.isNull(), "blank").when(~F.coalesce(city.isin(cities), F.lit(False)), "other_city").when(status.isin(dismissed), "dismissed").otherwise("project")


def load_upload(rows: DataFrame, key: str, folder: str, batch: int, source: str) -> Row:
    """Add the rows of new keys to the ledger in `folder` and give the row on the run.

    Rows without a key are skipped, and so are keys that the ledger has; of equal keys one is
    written. A load that breaks is repeated under its batch number.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("action", T.StringType())])
    return Ledger(rows.sparkSession, folder, schema, (key,)).add(batch, rows, first_of_key((key,), *rows.columns), source)


def export_csv(rows: DataFrame, folder: str) -> None:
    """Rows as CSV files with a header, lists, maps and structs as JSON text; the folder is replaced."""
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("escape", '"').csv(folder, header=True)


def incremental_cursor(loads: DataFrame, overlap_hours: int) -> DataFrame:
    """Per source the newest update less the overlap, and the mode that follows: full without a cursor."""
    last = loads.groupBy("source_id").agg(F.max("updated_at").alias("m"))
    cursor = F.col("m") - F.make_dt_interval(F.lit(0), F.lit(overlap_hours))
    return last.select("source_id", cursor.alias("cursor"), F.when(F.col("m").isNull(), "full").otherwise("incremental").alias("mode"))
