"""Latest-row, top-k and ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import ensure_checkpoint_dir


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given order.

    The order should be total. Spark ranks within each input partition first and drops what
    cannot be among the first k, so at most k rows a key and partition are shuffled.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1)


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with their place in their group, from 1, without a group being one task's work.

    Rows are dealt out by range of (groups, order), which should be total, and numbered within each
    range; a range's numbers go on where the group's ranges before it end. The ranges are cut by a
    sample, so they are kept in a checkpoint for both passes.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    within = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    counts = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each group and range that it reaches into
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_range").alias("_at"), before.alias("_before"))
    same = F.col("_range") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    placed = dealt.withColumn("_place", within).join(offsets, same)
    return placed.select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))


def best_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of the row with the least order struct of each key, by partial aggregation (no sort)."""
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}") for c in columns])


def leading_streak(df: DataFrame, key: str, order: list[Column], flag: Column, most: int) -> DataFrame:
    """Per key, how many of its first `most` rows in order come before the first without the flag."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_f", flag).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    broken = F.min(F.when(~F.col("_f"), F.col("_r")))
    return ranked.groupBy(key).agg((F.coalesce(broken, F.count(F.lit(1)) + 1) - 1).cast("long").alias("streak"))


def unique_top(df: DataFrame, key: str, score: str, digits: int, confirm: float, possible: float) -> DataFrame:
    """Each key's best score: confirmed if it alone has it (rounded) and it is high enough, else possible or none."""
    rounded = df.withColumn("_s", F.round(score, digits))
    top = rounded.groupBy(key).agg(F.max("_s").alias("top"))
    ties = rounded.join(top, key).filter(F.col("_s") == F.col("top")).groupBy(key, "top").agg(F.count(F.lit(1)).alias("n_top"))
    verdict = F.when((F.col("n_top") == 1) & (F.col("top") >= confirm), "confirmed").when(F.col("top") >= possible, "possible").otherwise("none")
    return ties.select(key, "top", "n_top", verdict.alias("verdict"))
