"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges (a, b) of longs to (node, root), root the least node of each component.

    Null ends and loops are left out, so nodes without other edges have no row. Every round
    rewires each node's neighbours to the least of them: the larger ones, then the smaller
    ones. Rounds end when a round changes nothing; each cuts its lineage in the shared
    checkpoint folder, and only two numbers of each round reach the driver. A star's rows
    are joined to its centre's minimum, never gathered in one place. The number of rounds
    grows with the logarithm of the edges; a RuntimeError says so if `rounds` do not do.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    for _ in range(rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rewired = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = rewired.unionAll(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
