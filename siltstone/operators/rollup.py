"""Counts, metrics and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_counts(df: DataFrame, key: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """Rows per value; with an order of the domain, also each value's place in it."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if order is None:
        return out
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key)).cast("int")
    return out.withColumn("place", F.when(place > 0, place - 1).otherwise(len(order)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def filtered_metrics(df: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    """Per key: rows, rows of each flag and each flag's share, in one pass."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])
    return counted.select("*", *[F.round(share(F.col(f"n_{k}"), F.col("n")), 6).alias(f"share_{k}") for k in flags])


def facets(df: DataFrame, columns: list[str], numbers: list[str] = (), most: dict[str, int] | None = None) -> DataFrame:
    """One row: the sorted distinct non-empty values of each column (the first `most` of those capped), and maxima of numbers.

    Distinct values are gathered per column by a partial aggregation; a column without a cap
    should be one of few values.
    """
    def values(c: str) -> Column:
        found = F.array_sort(F.collect_set(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))))
        return F.slice(found, 1, most[c]) if most and c in most else found

    return df.agg(*[values(c).alias(c) for c in columns], *[F.max(c).alias(f"max_{c}") for c in numbers])


def additive_rollup(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in sums])


def overall_confidence(df: DataFrame, key: str, field: str = "field", confidence: str = "confidence", main: str = "pipeline_status") -> DataFrame:
    """High if the main field is high and none is low; low if it or two fields are low; else medium."""
    low = F.count_if(F.col(confidence) == "low")
    main_is = lambda v: F.coalesce(F.bool_or((F.col(field) == main) & (F.col(confidence) == v)), F.lit(False))
    verdict = F.when(main_is("high") & (low == 0), "high").when((low >= 2) | main_is("low"), "low").otherwise("medium")
    return df.groupBy(key).agg(verdict.alias("overall"), low.alias("n_low"))


def duplicate_groups(df: DataFrame, keys: list[str], order: Column, id_col: str) -> DataFrame:
    """Groups of more than one row: the survivor by least order, all ids in order, and those to invalidate."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(id_col).alias("i")))).alias("_all")).filter(F.size("_all") > 1)
    ids = F.transform("_all", lambda x: x["i"])
    return rows.select(*keys, F.get(ids, F.lit(0)).alias("survivor"), F.slice(ids, 2, 2**30).alias("invalid"))


def parse_health(rows: DataFrame, status: str, ok: str = "ok") -> DataFrame:
    """A row for each state: how many, of how many in all, the share of `ok`, and its place, `ok` first, then the commonest.

    States are few, so the totals are a second, small aggregate.
    """
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), (F.coalesce(F.sum(F.when(F.col(status) == ok, F.col("n"))), F.lit(0)).cast("double") / F.sum("n")).alias("ok_rate"))
    place = F.row_number().over(Window.orderBy(F.when(F.col(status) == ok, 0).otherwise(1), F.desc("n"), status)).cast("long")
    return counts.join(F.broadcast(total)).select(status, "n", "total", "ok_rate", place.alias("place"))
