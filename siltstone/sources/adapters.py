"""Adapters: raw rows of a city's feeds as records of one schema, by name.

An adapter is a function from a DataFrame to a DataFrame, for `DataFrame.transform`. Records
without an id are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.text import clean_identifier, clean_text, parcel_number, permit_number
from siltstone.operators.resolution import INSPECTION, OCCUPANCY, PERMIT

Adapter = Callable[[DataFrame], DataFrame]


def _day(c: Column) -> Column:
    return F.try_to_date(F.substring(clean_text(c), 1, 10), "yyyy-MM-dd")


def _records(rows: DataFrame, source: str, record: Column, kind: Column, day: Column, apn: bool = False, point: bool = False, use: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(source).alias("source"), record.alias("record_id"), clean_text(F.col("address")).alias("address"), kind.cast("string").alias("evidence_type"), day.cast("string").alias("evidence_date"),
        (parcel_number(F.col("book"), F.col("page"), F.col("parcel")) if apn else none).alias("apn"), *[(F.col(c) if point else F.lit(None).cast("double")).alias(c) for c in ("lat", "lng")], (use if use is not None else none).alias("housing_use"),
    ).filter("record_id IS NOT NULL")


def permits(rows: DataFrame) -> DataFrame:
    """Permits of the closed feed."""
    return _records(rows, "permits", clean_identifier(F.col("permit")), F.lit(PERMIT), _day(F.col("issue_date")))


def permit_activity(rows: DataFrame) -> DataFrame:
    """Updates of permits of the closed feed: no evidence of a status."""
    none = F.lit(None)
    return _records(rows, "permit_activity", clean_identifier(F.col("permit")), none, none)


def new_housing(rows: DataFrame) -> DataFrame:
    """Permits of new housing, with parcel and place."""
    return _records(rows, "new_housing", clean_identifier(F.col("permit")), F.lit(PERMIT), _day(F.col("issue_date")), apn=True, point=True)


def occupancy(rows: DataFrame) -> DataFrame:
    """Certificates of occupancy: evidence only if issued, with a date."""
    day = _day(F.col("issue_date"))
    issued = (F.lower(clean_text(F.col("latest_status"))) == "cofo issued") & day.isNotNull()
    return _records(rows, "occupancy", clean_identifier(F.col("cofo_number")), F.when(issued, OCCUPANCY), F.when(issued, day), apn=True, point=True)


def live_permits(rows: DataFrame) -> DataFrame:
    """Permits of the live feed, and their use if it is one of housing."""
    use = clean_text(F.col("use_desc"))
    return _records(rows, "live_permits", permit_number(clean_text(F.col("permit"))), F.lit(PERMIT), _day(F.col("issue_date")), apn=True, point=True, use=F.when(use.isin(*fixed.HOUSING_USES), use))


def live_permit_activity(rows: DataFrame) -> DataFrame:
    """Updates of permits of the live feed."""
    none = F.lit(None)
    return _records(rows, "live_permit_activity", permit_number(clean_text(F.col("permit"))), none, none, apn=True, point=True)


def inspections(as_of: Column) -> Adapter:
    """Inspections: evidence of construction if recent, with a good result, on an active permit."""

    def adapt(rows: DataFrame) -> DataFrame:
        day = _day(F.col("issue_date"))
        counts = (day >= F.date_sub(as_of, fixed.INSPECTION_DAYS)) & F.col("result").isin(*fixed.POSITIVE_RESULTS) & F.col("permit_status").isin(*fixed.ACTIVE_PERMITS)
        return _records(rows.filter(clean_text(F.col("permit")).isNotNull()), "inspections", F.col("row_id").cast("string"), F.when(counts, INSPECTION), F.when(counts, day), point=True)

    return adapt


def adapters(as_of: Column) -> dict[str, Adapter]:
    return {
        "permits": permits, "permit_activity": permit_activity, "new_housing": new_housing, "occupancy": occupancy, "live_permits": live_permits,
        "live_permit_activity": live_permit_activity, "inspections": inspections(as_of),
    }


def adapter(name: str, as_of: Column) -> Adapter:
    """The adapter of this name; a KeyError if there is none."""
    return adapters(as_of)[name]
