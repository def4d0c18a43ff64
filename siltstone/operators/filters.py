"""Scope, optional-parameter and eligibility filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status texts of permits, folded, that take a permit out of force or show it in force.
REGRESSING = ("cancelled", "permit cancelled", "void", "revoked", "expired", "withdrawn", "plan check cancelled")
ADDITIVE = ("issued", "permit finaled", "ready to issue", "plan check submitted", "plans approved", "pending inspection", "cofo issued", "cofo pending", "")


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each parameter that is not None; lists and tuples mean any of their values."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def scoped(df: DataFrame, market_id=None, market_slug: str | None = None) -> DataFrame:
    """By market id if given, else by slug, else all."""
    return where_given(df, market_id=market_id) if market_id is not None else where_given(df, market=market_slug)


def scoped_to_article(projects: DataFrame, article_market: Column, unscoped: str = "unscoped") -> Column:
    """Whether a project is in the market of an article's source, or the source has none."""
    return (article_market == unscoped) | (projects["market_id"] == article_market)


def within_days(c: Column, start: Column, end: Column) -> Column:
    return F.coalesce(c.between(start, end), F.lit(False))


def contains_text(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring of the columns, joined by blanks."""
    return F.lower(F.concat_ws(" ", *columns)).contains(needle.lower())


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def is_new_candidate(address: Column, identifier: Column, developer: Column, units: Column, confidence: Column, least_units: int = 10) -> Column:
    """A strong signal, enough confidence, and not known to be small."""
    strong = address.isNotNull() | identifier.isNotNull() | (developer.isNotNull() & units.isNotNull())
    return strong & F.coalesce(confidence.isin("high", "medium"), F.lit(False)) & (units.isNull() | (units >= least_units))


def paperwork(source: Column, status: Column, sources: tuple[str, ...] = ("city_permit", "city_permit_activity")) -> Column:
    """struct(benign, alert): whether a permit row only adds paperwork; an unknown status counts as benign and raises an alert."""
    key = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    permit = F.coalesce(source.isin(*sources), F.lit(False))
    benign = permit & ~key.isin(*REGRESSING)
    return F.struct(benign.alias("benign"), (benign & ~key.isin(*ADDITIVE)).alias("alert"))


def material_delta(current: Column, candidate: Column, share: float = 0.10) -> Column:
    """Whether a count moves by more than a share of the current one (of 1 at least)."""
    return F.coalesce(F.abs(candidate - current) / F.greatest(F.abs(current), F.lit(1)) > share, F.lit(False))


def exceeds_delta(current: Column, new: Column, share: float) -> Column:
    """Relative change over a threshold; unknown or equal counts never exceed."""
    return F.coalesce((current != new) & (F.try_divide(F.abs(new - current), F.greatest(F.abs(current), F.lit(1))) > share), F.lit(False))


def excerpts(json: Column) -> Column:
    """array(struct(start, end)) of passage excerpts, given as a list or under one of three keys."""
    kind = "array<struct<start: bigint, end: bigint>>"
    under = [F.from_json(F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")), kind) for key in ("passage_excerpts", "excerpts", "items")]
    return F.coalesce(F.when(F.trim(json).startswith("["), F.from_json(json, kind)), *under, F.array().cast(kind))


def excerpt_span(found: Column) -> Column:
    """struct(start, end): from the least start to the greatest end; nulls without an excerpt."""
    return F.struct(F.array_min(F.transform(found, lambda e: e["start"])).alias("start"), F.array_max(F.transform(found, lambda e: e["end"])).alias("end"))


def clean_identifiers(values: Column) -> Column:
    """A map of identifier lists with sorted, distinct, trimmed values, and without kinds that have none."""
    tidy = F.transform_values(values, lambda _, v: F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))))
    return F.map_filter(tidy, lambda _, v: F.size(v) > 0)


def identifier_line(values: Column) -> Column:
    """A map of identifier lists as kind:a|b, the kinds in order; '' for none."""
    entries = F.array_sort(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,array<string>>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "|"))), ",")


def first_json_text(json: Column, default: Column, *keys: str) -> Column:
    """The first of the keys that has a text, else the default."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(F.try_parse_json(json), f"$.{k}", "string")), F.lit("")) for k in keys], default)


def one_of(value: Column, *columns: Column) -> Column:
    """Whether a text is loosely equal (letters and digits, in lower case) to one of the columns."""
    loose = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    tidy = lambda c: F.trim(loose(c))
    return F.coalesce(F.array_contains(F.array_compact(F.array(*map(tidy, columns))), tidy(value)), F.lit(False))
