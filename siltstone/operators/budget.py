"""Budget reservations: an ordered fold in which rejected requests add nothing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket string, day string, event_id long, cents long, spent long, accepted boolean, warned boolean"


def reserve(requests: DataFrame, warn: int, hard: int) -> DataFrame:
    """Per (bucket, day), requests in order of (at_us, event_id): accepted if the spend stays within `hard`.

    A request warns if the projected spend reaches `warn`. The running sum depends on each
    decision, so no window expresses it. Requests are sorted within partitions by Spark,
    which may spill, and folded batch by batch: a task holds one batch and one running
    spend, however large a bucket's day is. Columns read: bucket, day, at_us, event_id,
    cents; requests without cents are left out.
    """

    def fold(batches):
        key, spent = None, 0
        for batch in batches:
            buckets, days, cents = (batch.column(i).to_pylist() for i in (0, 1, 4))
            out = ([], [], [])
            for bucket, day, c in zip(buckets, days, cents, strict=True):
                if (bucket, day) != key:
                    key, spent = (bucket, day), 0
                projected = spent + c
                accepted = projected <= hard
                spent = projected if accepted else spent
                for column, value in zip(out, (spent, accepted, projected >= warn), strict=True):
                    column.append(value)
            spend, accept, warned = (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.bool_()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), spend, accept, warned], ["bucket", "day", "event_id", "cents", "spent", "accepted", "warned"])

    rows = requests.select("bucket", "day", "at_us", "event_id", "cents").filter("cents IS NOT NULL")
    return rows.repartition("bucket", "day").sortWithinPartitions("bucket", "day", "at_us", "event_id").mapInArrow(fold, SCHEMA)
