"""How many rows an Arrow batch holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session's Arrow batches hold `rows` rows at most; a smaller setting stays.

    Operators work through texts in slices of about two megabytes, so larger batches only
    occupy memory, once in the executor and once in its Python worker.
    """
    now = int(spark.conf.get(_KEY))
    if now <= 0 or now > rows:
        spark.conf.set(_KEY, str(rows))
