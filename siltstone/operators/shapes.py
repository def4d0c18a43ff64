"""Nested JSON against a declared shape: each violation with its path, as column expressions over variants.

A shape is declared with the classes below and compiled to one expression that gives
array<struct<path, kind>>; no row leaves the JVM. Kinds of violations: `missing`, `null`,
`type`, `value` (not one of the choices, no day, no id), `range`, `extra` (a key of a closed
object that is not declared), `order` (a rule between fields), `unknown_code` and `wrong_field`
(codes against a table). A field that has a violation of its own is not looked into further.

Values are read as leniently as common validators do: a whole number may be a number without
a fraction or its text, a number may be text, a flag may be 0, 1 or a word for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "array<struct<path:string,kind:string>>"


def _none() -> Column:
    return F.array().cast(_LIST)


def _one(path: Column, kind: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind")))


def _part(value: Column, kind: str, at: str = "$") -> Column:
    return F.try_variant_get(value, at, kind)


@dataclass(frozen=True, kw_only=True)
class Kind:
    """required: the key must be there; nullable: it may be null."""

    required: bool = True
    nullable: bool = False

    def found(self, value: Column, path: Column) -> Column:
        """Violations of a value that is there and not null."""
        return _none()

    def check(self, value: Column, path: Column) -> Column:
        absent = _one(path, "missing") if self.required else _none()
        empty = _none() if self.nullable else _one(path, "null")
        return F.when(value.isNull(), absent).when(F.is_variant_null(value), empty).otherwise(self.found(value, path))


def _type(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


@dataclass(frozen=True, kw_only=True)
class Anything(Kind):
    pass


@dataclass(frozen=True, kw_only=True)
class Text(Kind):
    def found(self, value: Column, path: Column) -> Column:
        return F.when(_type(value) == "STRING", _none()).otherwise(_one(path, "type"))


@dataclass(frozen=True, kw_only=True)
class Matching(Kind):
    """Text of a pattern, such as an id."""

    pattern: str

    def found(self, value: Column, path: Column) -> Column:
        return F.when(_type(value) != "STRING", _one(path, "type")).when(_part(value, "string").rlike(self.pattern), _none()).otherwise(_one(path, "value"))


@dataclass(frozen=True, kw_only=True)
class Day(Kind):
    def found(self, value: Column, path: Column) -> Column:
        return F.when(_type(value) != "STRING", _one(path, "type")).when(F.try_to_date(_part(value, "string"), "yyyy-MM-dd").isNotNull(), _none()).otherwise(_one(path, "value"))


@dataclass(frozen=True, kw_only=True)
class Choice(Kind):
    values: tuple[str, ...]

    def found(self, value: Column, path: Column) -> Column:
        return F.when((_type(value) == "STRING") & _part(value, "string").isin(*self.values), _none()).otherwise(_one(path, "value"))


@dataclass(frozen=True, kw_only=True)
class Number(Kind):
    """whole: without a fraction; least: the least value."""

    whole: bool = False
    least: float | None = None

    def found(self, value: Column, path: Column) -> Column:
        text = F.trim(_part(value, "string"))
        number = F.when(~_type(value).isin("BOOLEAN", "ARRAY", "OBJECT"), text.try_cast("double"))
        bad = number.isNull() | (F.floor(number) != number if self.whole else F.lit(False))
        low = F.lit(False) if self.least is None else number < self.least
        return F.when(F.coalesce(bad, F.lit(True)), _one(path, "type")).when(low, _one(path, "range")).otherwise(_none())


@dataclass(frozen=True, kw_only=True)
class Flag(Kind):
    def found(self, value: Column, path: Column) -> Column:
        word = F.lower(_part(value, "string")).isin("true", "false", "0", "1", "yes", "no", "on", "off", "t", "f", "y", "n")
        return F.when((_type(value) == "BOOLEAN") | (_type(value).isin("STRING", "BIGINT") & word), _none()).otherwise(_one(path, "type"))


@dataclass(frozen=True, kw_only=True)
class ListOf(Kind):
    item: Kind

    def found(self, value: Column, path: Column) -> Column:
        each = F.flatten(F.transform(_part(value, "array<variant>"), lambda x, i: self.item.check(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(_type(value) == "ARRAY", each).otherwise(_one(path, "type"))


@dataclass(frozen=True, kw_only=True)
class MapOf(Kind):
    item: Kind

    def found(self, value: Column, path: Column) -> Column:
        entries = F.map_entries(_part(value, "map<string,variant>"))
        each = F.flatten(F.transform(entries, lambda e: self.item.check(e["value"], F.concat(path, F.lit("."), e["key"]))))
        return F.when(_type(value) == "OBJECT", each).otherwise(_one(path, "type"))


@dataclass(frozen=True, kw_only=True)
class Shape(Kind):
    """fields by name; no other keys; ordered: (low, high) number fields of which the first may not be greater."""

    fields: dict[str, Kind] = field(default_factory=dict)
    ordered: tuple[tuple[str, str], ...] = ()

    def found(self, value: Column, path: Column) -> Column:
        below = lambda name: F.concat(path, F.when(path == "", F.lit("")).otherwise("."), F.lit(name) if isinstance(name, str) else name)
        known = F.array(*[F.lit(n) for n in self.fields])
        extra = F.array_except(F.map_keys(_part(value, "map<string,variant>")), known)
        parts = [F.transform(extra, lambda n: F.struct(below(n).alias("path"), F.lit("extra").alias("kind")))]
        parts += [kind.check(_part(value, "variant", f"$.{name}"), below(name)) for name, kind in self.fields.items()]
        for low, high in self.ordered:
            parts.append(F.when(_part(value, "double", f"$.{low}") > _part(value, "double", f"$.{high}"), _one(below(high), "order")).otherwise(_none()))
        return F.when(_type(value) == "OBJECT", F.concat(*parts)).otherwise(_one(path, "type"))


def violations(shape: Kind, value: Column) -> Column:
    """array<struct<path, kind>> of a variant; empty for one that fits."""
    return shape.check(value, F.lit(""))


def _optional(kind: type, **more) -> Kind:
    return kind(required=False, nullable=True, **more)


_COUNT = _optional(Number, whole=True, least=0)
_UUID = "^[{]?[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[}]?$"
_PASSAGE = Shape(fields={"field": Text(), "value": Anything(nullable=True), "passage": Text(), "offset_start": Number(whole=True, least=0), "offset_end": Number(whole=True, least=0)}, ordered=(("offset_start", "offset_end"),))
_NUMBERS = Shape(required=False, fields={n: ListOf(required=False, item=Text()) for n in ("case_number", "permit_number", "apn")})

#: The fields of a project that an extraction names, and their choices.
REFERENCE = Shape(fields={
    **{f"candidate_{n}": _optional(Text) for n in ("name", "address", "city", "developer", "delivery_year_text", "neighborhood")},
    **{f"candidate_{n}": _COUNT for n in ("unit_total", "unit_affordable", "unit_market_rate", "unit_workforce", "stories")},
    "candidate_product_type": _optional(Choice, values=("apartment", "condo", "townhome", "single_family", "micro_co_living", "other")),
    "candidate_age_restriction": _optional(Choice, values=("non_age_restricted", "senior", "student", "unknown")),
    "candidate_status_signal": _optional(Choice, values=("Conceptual", "Proposed", "Pending", "Approved", "Under Construction", "Pre-Leasing/Pre-Selling", "Complete", "Stalled", "Inactive")),
    "candidate_delivery_year_normalized": _optional(Day), "candidate_signal_flags": MapOf(required=False, item=Flag()), "candidate_identifiers": _NUMBERS,
    "candidate_lat": _optional(Number), "candidate_lng": _optional(Number), "candidate_confidence": Choice(values=("high", "medium", "low")),
    "passage_excerpts": ListOf(required=False, item=_PASSAGE), "registry_developer_id": _optional(Matching, pattern=_UUID), "registry_project_id": _optional(Matching, pattern=_UUID),
})
EXTRACTION = Shape(fields={"relevance": Choice(values=("confirmed", "rejected", "unclear")), "rejected_reason": _optional(Text), "project_references": ListOf(required=False, item=REFERENCE), "diagnostic": MapOf(required=False, item=Anything(nullable=True))})

_ANCHOR = Shape(fields={"text": Text(), "offset_start": _COUNT, "offset_end": _COUNT, "field_name": _optional(Text), "metadata": MapOf(required=False, item=Anything(nullable=True))}, ordered=(("offset_start", "offset_end"),))
_OPEN = MapOf(required=False, item=Anything(nullable=True))
INTERPRETATION = Shape(fields={
    "field_name": Text(), "canonical_value": Anything(required=False, nullable=True), "confidence": Choice(values=("high", "medium", "low")), "reason_code": Text(), "signal_flags": _OPEN,
    "source_anchors": ListOf(required=False, item=_ANCHOR), "requires_corroboration": Flag(required=False), "metadata": _OPEN,
})
SEMANTIC = Shape(fields={"interpretations": ListOf(required=False, item=INTERPRETATION), "diagnostic": _OPEN})


def parsed(answers: DataFrame, key: str, shape: Kind, root_list: str | None = None, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, value, status, found) of answers (key, raw, stop): the variant, the parse state and the violations.

    States: truncated, refused (by the stop reason), parse_error, schema_invalid, ok. A fence
    around the JSON is taken off; a list at the root becomes the object's `root_list` where given.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    if root_list:
        text = F.when(text.startswith("["), F.concat(F.lit(f'{{"{root_list}": '), text, F.lit("}"))).otherwise(text)
    rows = answers.select(key, "stop", F.try_parse_json(text).alias("value"))
    found = rows.withColumn("found", F.when(F.col("value").isNotNull(), violations(shape, F.col("value"))).otherwise(_none()))
    return found.select(key, "value", _state().alias("status"), "found")


def _state() -> Column:
    return F.when(F.col("stop") == "max_tokens", "truncated").when(F.col("stop") == "refusal", "refused").when(F.col("value").isNull(), "parse_error").when(F.size("found") > 0, "schema_invalid").otherwise("ok")


def code_violations(rows: DataFrame, key: str, codes: DataFrame, profile: str) -> DataFrame:
    """(key, path, kind) of reason codes that `codes` (code, profile, field_name) does not have, or has for another profile or field.

    `codes` may be of any size: references and codes meet in an equi-join.
    """
    items = _part(F.col("value"), "array<variant>", "$.interpretations")
    named = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("interpretations["), i.cast("string"), F.lit("].reason_code")).alias("path"), _part(x, "string", "$.reason_code").alias("code"), _part(x, "string", "$.field_name").alias("named")))
    refs = rows.select(key, F.inline(named)).filter("code IS NOT NULL")
    joined = refs.join(codes.select("code", F.col("profile").alias("_p"), F.col("field_name").alias("_f")), "code", "left")
    kind = F.when(F.col("_p").isNull(), "unknown_code").when(F.col("_p") != profile, "wrong_profile").when(~F.col("_f").eqNullSafe(F.col("named")), "wrong_field")
    return joined.select(key, "path", kind.alias("kind")).filter("kind IS NOT NULL")


def extraction_answers(answers: DataFrame, key: str) -> DataFrame:
    """(key, status, found): parse states of extractions, found as `path:kind` by path."""
    return _listed(parsed(answers, key, EXTRACTION), key)


def semantic_answers(answers: DataFrame, key: str, codes: DataFrame, profile: str = "news_v1") -> DataFrame:
    """The same of interpretations, whose codes must be those of the table; a bare list is the list of interpretations."""
    rows = parsed(answers, key, SEMANTIC, "interpretations")
    wrong = code_violations(rows.filter("status = 'ok'"), key, codes, profile).groupBy(key).agg(F.collect_list(F.struct("path", "kind")).alias("_wrong"))
    both = rows.join(wrong, key, "left").withColumn("found", F.coalesce("_wrong", "found"))
    return _listed(both.withColumn("status", F.when(F.col("_wrong").isNotNull(), "schema_invalid").otherwise(F.col("status"))), key)


def _listed(rows: DataFrame, key: str) -> DataFrame:
    text = F.array_join(F.array_sort(F.transform("found", lambda x: F.concat(x["path"], F.lit(":"), x["kind"]))), ";")
    return rows.select(key, "status", F.when(F.col("status") == "schema_invalid", text).otherwise("").alias("found"))
