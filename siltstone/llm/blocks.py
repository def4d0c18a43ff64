"""Documents in hash blocks, and NumPy arrays in the binary columns of packed rows.

Operators that compare every word of a corpus with all others would shuffle a row for each
word. Here a block of documents, of bounded text, deals its values out to partitions by
hash range as one packed row for each partition; partitions answer blocks in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(docs: DataFrame, id_col: str, text_col: str, block_chars: int, *more) -> DataFrame:
    """(id, text, more..., block), partitioned by block, each of about `block_chars` characters of text.

    Every use of the result has this one exchange, which Spark makes once and reuses.
    """
    total = docs.agg(F.sum(F.length(text_col)), F.count(F.lit(1))).collect()[0]
    n = max(1, -(-((total[0] or 0) + 100 * total[1]) // block_chars))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("block")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more, block).repartition(n, "block")


def parts_of(docs: DataFrame) -> int:
    """How many hash ranges values are dealt out to: the session's shuffle partitions."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each 64-bit key; ascends with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def cut_by_part(sorted_keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, low, high) of the non-empty parts of ascending keys."""
    part = range_part(sorted_keys, parts)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    return [(p, int(cuts[p]), int(cuts[p + 1])) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def unpacked(column: pa.ChunkedArray | pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def joined(column, kind) -> np.ndarray:
    arrays = unpacked(column, kind)
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def table_batches(table: pa.Table):
    """A grouped table's rows as one batch (none if it is empty)."""
    if table.num_rows:
        yield from table.combine_chunks().to_batches()
