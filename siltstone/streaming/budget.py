"""Budget reservations as a stream: the spend of each bucket's day is kept state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "bucket string, day string, event_id long, cents long, spent long, accepted boolean, warned boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reservations(StatefulProcessor):
    """Folds the requests of a (bucket, day) in order; its spend is dropped once the watermark is `keep_ms` past the last request."""

    def __init__(self, warn: int, hard: int, keep_ms: int):
        self.warn, self.hard, self.keep_ms = warn, hard, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "cents long, until_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        spent, until = self.spent.get() if self.spent.exists() else (0, None)
        # the requests of one micro-batch; how many there are is the trigger's to bound
        requests = sorted((r.at_us, r.event_id, r.cents) for r in rows)
        for _, event_id, cents in requests:
            projected = spent + cents
            accepted = projected <= self.hard
            spent = projected if accepted else spent
            yield Row(bucket=key[0], day=key[1], event_id=event_id, cents=cents, spent=spent, accepted=accepted, warned=projected >= self.warn)
        later = max(until or 0, requests[-1][0] // 1000 + self.keep_ms)
        if later != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(later)
        self.spent.update((spent, later))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.spent.clear()
        return iter(())

    def close(self) -> None:
        pass


def reserve_stream(requests: DataFrame, warn: int, hard: int, late: str = "24 hours", keep_ms: int = 86_400_000) -> DataFrame:
    """What `operators.budget.reserve` gives, on a stream (bucket, day, at, event_id, cents).

    Micro-batches are folded one after the other, each in order of (at, event_id); requests
    without cents, or later than the watermark, are left out. A bucket's day is one key, as its
    definition asks; others spread over the state's partitions.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = requests.filter("cents IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).select("bucket", "day", "at", F.unix_micros("at").alias("at_us"), "event_id", "cents")
    return rows.groupBy("bucket", "day").transformWithState(Reservations(warn, hard, keep_ms), SCHEMA, "Append", "EventTime")
