"""A bounded sample of labelled rows with their texts, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, fold: int) -> Column:
    """Whether a row is kept from learning: crc32(id as text) mod `fold` is 0."""
    return (F.crc32(F.col(id_col).cast("string")) % fold) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, fold: int, id_col: str, text_col: str, label_col: str, none_of: int = 0) -> DataFrame:
    """(_id, _y, _t, _h) of `per_class` ids of each class, least hashes first, and of their different texts as many.

    An id with several labels has the greatest of them, or the least where `none_of` is 1. Labels other
    than 0 and 1, null ids and held-out rows are left out.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id", fold))
    one = F.min("_y") if none_of else F.max("_y")
    marked = usable.groupBy("_id").agg(one.cast("int").alias("_y")).withColumn("_h", F.xxhash64("_id"))
    sampled = [marked.filter(F.col("_y") == y).orderBy("_h", "_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(sampled[0].union(sampled[1]).select("_id", "_y"))  # 2 * per_class rows at most
    # rows of one id and text are one; of an id with many texts, no more than the bound are learned from
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(picked, "_id").withColumn("_h", F.xxhash64("_id", "_t"))
    rows = rows.groupBy("_id", "_h").agg(F.max("_y").alias("_y"), F.max("_t").alias("_t"))
    bounded = [rows.filter(F.col("_y") == y).orderBy("_h", "_id").limit(per_class) for y in (0, 1)]
    return bounded[0].union(bounded[1]).select("_id", "_y", "_t", "_h")
