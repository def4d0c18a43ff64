"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product, the sum of m partial scores, one for each group of
components. Per query, each group is a list of scores to which every vector adds one.
Vectors are dealt out to blocks, queries to blocks of their own, and a task meets one
block of each, so a query set of any size meets every row without being broadcast.

1. Each list gives its k best entries of each block; with their vectors' other partial
   scores they make sums, of which the k-th best per query is a bound that the answer
   reaches.
2. That bound is a safe cutoff: of m lists, a vector whose shifted partial scores (less
   each list's least) are all below (bound - sum of least) / m cannot reach it. Per query
   it goes to every block with its queries; a list gives all entries that reach it, and
   vectors that no list gives leave.
3. The scores of those that remain are resolved exactly, and the k best per block meet.

Defined results: a vector that is null or empty, holds a null or a non-finite component,
or whose id is null takes no part, as query or candidate; so does one of another length
than the others that it meets. A query has no row for itself (its own id). Rows repeated
with the same id and vector are one candidate and one query. Different vectors of one id
are all candidates and all queries: the id's rows are the k best scores of any of its
vectors with any candidate, and a candidate id may recur. Ties go to smaller ids; with
fewer than k candidates all are returned. Scores must fit a long. Other columns are not read and an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.session import ensure_checkpoint_dir


#: Stands for no bound: the least long lets every vector pass.
_NONE = -(2**63)


@dataclass(frozen=True)
class SearchParams:
    """k: rows per query; groups: lists that a score is summed from; blocks and slices bound what a task holds."""

    k: int = 20
    groups: int = 4
    query_block: int = 2048
    query_slice: int = 256
    vector_block: int = 8192


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null where any is null or non-finite."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of (block, ids, length of a vector, all components), each of about `size` vectors."""
    total = rows.count()
    blocks = max(1, -(-total // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name, F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(name, "dim", F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_v"))


def _partials(q: np.ndarray, c: np.ndarray, groups: int) -> list[np.ndarray]:
    """Partial score matrices, one for each group of components; exact while sums stay below 2**53."""
    cuts = np.array_split(np.arange(q.shape[1]), min(groups, q.shape[1]))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if exact < 2**24 else np.float64 if exact < 2**53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    return [q[:, g] @ c[:, g].T for g in cuts]


def top_k(vectors: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """`vectors` and `queries` are (id long, v array<long>): query_id, rank, vec_id, score."""
    usable = lambda d: d.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).select("id", "v").dropDuplicates(["id", "v"])
    cs = _blocks(usable(vectors), params.vector_block, "c")
    qs = _blocks(usable(queries), params.query_block, "q")
    # every block of queries with every block of vectors: the stated query set against all rows
    places = cs.select("c", "dim").distinct()
    pairs = qs.join(places, "dim").join(cs, ["dim", "c"])
    k, groups = params.k, params.groups

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q_ids, c_ids = np.asarray(row["q_ids"], np.int64), np.asarray(row["c_ids"], np.int64)
        q = np.asarray(row["q_v"], np.int64).reshape(len(q_ids), -1)
        c = np.asarray(row["c_v"], np.int64).reshape(len(c_ids), -1)
        order = np.argsort(c_ids, kind="stable")
        return q_ids, q, c_ids[order], c[order]

    def slices(q: np.ndarray):
        return (slice(at, at + params.query_slice) for at in range(0, len(q), params.query_slice))

    def gather(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                all_ids, q, c_ids, c = unpack(row)
                for part in slices(q):
                    q_ids, lists = all_ids[part], _partials(q[part], c, groups)
                    # a query itself may be among the best, so each list gives one more
                    n = min(k + 1, len(c_ids))
                    at = np.concatenate([np.argpartition(p, len(c_ids) - n, axis=1)[:, len(c_ids) - n :] for p in lists], axis=1)
                    at.sort(axis=1)
                    counts = c_ids[at] != q_ids[:, None]
                    counts[:, 1:] &= at[:, 1:] != at[:, :-1]
                    score = np.where(counts, sum(np.take_along_axis(p, at, 1) for p in lists).astype(np.int64), _NONE)
                    score = np.sort(score, axis=1)[:, ::-1][:, :k]
                    sums = [s[:m].tolist() for s, m in zip(score, np.minimum(counts.sum(1), k).tolist(), strict=True)]
                    least = np.stack([p.min(1) for p in lists], 1).astype(np.int64)
                    yield pd.DataFrame({"query_id": q_ids, "dim": q.shape[1], "sums": sums, "least": least.tolist()})

    # written once, since both the bound and the least scores come of it
    ensure_checkpoint_dir(vectors.sparkSession)
    lists = pairs.mapInPandas(gather, "query_id long, dim int, sums array<long>, least array<long>").checkpoint()
    sums = lists.select("query_id", F.explode("sums").alias("s"))
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"))))
    # each sum is of another pair of vectors, so the k-th best of an id is reached; with fewer than k there is no bound: the least long lets every vector pass
    bound = ranked.filter(F.col("r") == k).select("query_id", F.col("s").alias("bound"))
    least = lists.select("query_id", "dim", F.posexplode("least").alias("g", "x")).groupBy("query_id", "dim", "g").agg(F.min("x").alias("x"))
    least = least.groupBy("query_id", "dim").agg(F.sort_array(F.collect_list(F.struct("g", "x")))["x"].alias("least"))
    cutoffs = least.join(bound, "query_id", "left")

    blocked = usable(queries).withColumn("dim", F.size("v")).join(cutoffs.withColumnRenamed("query_id", "id"), ["id", "dim"])
    n_q = max(1, -(-usable(queries).count() // params.query_block))
    blocked = blocked.withColumn("q", F.pmod(F.xxhash64("id", "v"), F.lit(n_q)).cast("int")).groupBy("q", "dim")
    blocked = blocked.agg(F.collect_list(F.struct("id", "v", "least", "bound")).alias("rows")).select(
        "q", "dim", F.col("rows.id").alias("q_ids"), F.flatten("rows.v").alias("q_v"), F.flatten("rows.least").alias("q_least"), F.transform("rows.bound", lambda b: F.coalesce(b, F.lit(_NONE))).alias("q_bound")
    )

    def resolve(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                all_ids, q, c_ids, c = unpack(row)
                bounds, leasts = np.asarray(row["q_bound"], np.int64), np.asarray(row["q_least"], np.int64).reshape(len(all_ids), -1)
                for part in slices(q):
                    q_ids, bound, least = all_ids[part], bounds[part], leasts[part]
                    lists = _partials(q[part], c, groups)
                    free = bound == _NONE
                    cutoff = least + ((np.where(free, 0, bound) - least.sum(1)) // len(lists))[:, None]
                    stay = np.repeat(free[:, None], len(c_ids), axis=1)
                    for g, p in enumerate(lists):
                        stay |= p >= cutoff[:, g : g + 1].astype(p.dtype)
                    at_q, at_c = np.nonzero(stay)
                    exact = sum(p[at_q, at_c] for p in lists).astype(np.int64)
                    enough = (exact >= bound[at_q]) & (q_ids[at_q] != c_ids[at_c])
                    at_q, at_c, exact = at_q[enough], at_c[enough], exact[enough]
                    order = np.lexsort((c_ids[at_c], -exact, at_q))
                    at_q, at_c, exact = at_q[order], at_c[order], exact[order]
                    first = np.searchsorted(at_q, at_q)
                    top = np.arange(len(at_q)) - first < k
                    yield pd.DataFrame({"query_id": q_ids[at_q[top]], "vec_id": c_ids[at_c[top]], "score": exact[top]})

    found = blocked.join(places, "dim").join(cs, ["dim", "c"]).mapInPandas(resolve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
