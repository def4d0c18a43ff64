"""Date rules as column expressions; the reference day is always a parameter."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.text import mapped


def effective_date(evidence_date: Column, collected_at: Column) -> Column:
    """The evidence's date, at most the day it was collected."""
    day = F.to_date(collected_at)
    return F.least(F.coalesce(evidence_date, day), day)


def date_value(c: Column) -> Column:
    """The ISO date of the first ten characters."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")


def derived_date(fields: list[Column], updated: Column, created: Column, seen: Column) -> Column:
    """The first of the fields that is a date, else the day of update, creation or first sight."""
    return F.coalesce(*[date_value(f) for f in fields], F.to_date(updated), F.to_date(created), F.to_date(seen))


MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}


def month_year(c: Column) -> Column:
    """The first of the month of `Mon YYYY`."""
    month = mapped(F.upper(F.substring(F.regexp_extract(c, r"^\s*([A-Za-z]{3,9})\.?\s+(\d{4})\s*$", 1), 1, 3)), MONTHS)
    year = F.regexp_extract(c, r"^\s*([A-Za-z]{3,9})\.?\s+(\d{4})\s*$", 2).try_cast("int")
    return F.when(month.isNotNull() & year.isNotNull(), F.make_date(year, month, F.lit(1)))


def delivery_date(year: Column, month: Column) -> Column:
    """The first of the month; January where the month is missing or none."""
    m = F.coalesce(month.try_cast("int"), mapped(F.upper(F.substring(F.trim(month.cast("string")), 1, 3)), MONTHS))
    return F.make_date(year.cast("int"), F.when(m.between(1, 12), m).otherwise(1), F.lit(1))


def months_ago(as_of: Column, n: int) -> Column:
    return F.to_date(F.trunc(F.add_months(as_of, -n), "MM"))


def estimated_delivery(status: Column, units: Column, as_of: Column) -> Column:
    """1 July of the year after the status's base years and an allowance for size; null for other statuses."""
    size = F.when(units.isNull(), 0.0).when(units < 200, -0.5).when(units <= 500, 0.0).when(units <= 1000, 1.0).otherwise(1.5)
    base = mapped(status, fixed.BASE_YEARS)
    return F.when(base.isNotNull(), F.make_date(F.ceil(F.year(as_of) + base + size).cast("int"), F.lit(7), F.lit(1)))


# The month that stands for a part of a year.
SEASONS = {"Q1": 2, "Q2": 5, "Q3": 8, "Q4": 11, "EARLY": 3, "MID": 7, "LATE": 11, "SPRING": 4, "SUMMER": 7, "FALL": 10, "WINTER": 1}


def delivery_target(c: Column) -> Column:
    """`Q3 2027`, `late 2027`, `Fall 2027` or `2027` as a first of month."""
    word = F.upper(F.regexp_extract(c, r"^\s*(\w+)\s+(\d{4})\s*$", 1))
    year = F.regexp_extract(c, r"(\d{4})\s*$", 1).try_cast("int")
    month = F.when(word == "", 1).otherwise(mapped(word, SEASONS))
    return F.when(year.isNotNull() & month.isNotNull(), F.make_date(year, month, F.lit(1)))


def cost_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def jitter_seconds(name: Column, at: Column, most: int) -> Column:
    """0 to `most`, by the first eight bytes of a hash of the name and the ISO time."""
    digest = F.sha2(F.concat(name, F.lit(":"), at), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(most + 1)).cast("long")


def mail_or_iso(c: Column) -> Column:
    """A timestamp in mail or ISO form."""
    day = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in forms])


def day_bounds(ts: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Between the start of one UTC day and the end of another; either may be open."""
    out = F.lit(True)
    if start is not None:
        out &= ts >= F.lit(f"{start} 00:00:00").cast("timestamp")
    if end is not None:
        out &= ts <= F.lit(f"{end} 23:59:59.999999").cast("timestamp")
    return out


_NAMES = {name: i for i, name in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))} | {
    name: i for i, name in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)
}


def _field(text: str, low: int, high: int) -> set[int]:
    """The numbers of a schedule's field: lists of numbers or names, spans, and steps (from one number on to the end)."""
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        ends = [_NAMES[x] if x in _NAMES else int(x) for x in span.split("-")] if span != "*" else [low, high]
        a, b = ends[0], high if step and len(ends) == 1 else ends[-1]
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def previous_fire(cron: str, zone: str, now: dt.datetime, catchup_hours: int, last_run: dt.datetime | None) -> dt.datetime | None:
    """The last time at or before `now` that a five-field schedule names, if recent enough and later than the last run.

    Where a schedule restricts both the day of the month and of the week, either will do.
    This is scheduling of a job, not of rows, so it runs once where the job is started.
    """
    minute, hour, day, month, week = cron.split()
    minutes, hours, days, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12)
    weekdays = {w % 7 for w in _field(week, 0, 7)}
    at = now.astimezone(ZoneInfo(zone)).replace(second=0, microsecond=0)
    for _ in range(catchup_hours * 60 + 1):
        in_month, in_week = at.day in days, (at.isoweekday() % 7) in weekdays
        named = in_month or in_week if not day.startswith("*") and not week.startswith("*") else in_month and in_week
        if at.minute in minutes and at.hour in hours and at.month in months and named:
            fired = at.astimezone(dt.UTC)
            return fired if last_run is None or fired > last_run else None
        at = (at.astimezone(dt.UTC) - dt.timedelta(minutes=1)).astimezone(ZoneInfo(zone))
    return None
