"""Review rules as column expressions, and the tables that decisions and overrides turn into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.scores import haversine_meters
from siltstone.functions.text import developer_name, mapped
from siltstone.operators.resolution import RANK

#: Fixed value: which fields count units.
UNIT_FIELDS = ("units", "total_units", "affordable_units", "market_rate_units", "workforce_units")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for when, name in pairs]))


def contradiction_priority(field: Column, tier: Column, kept: Column, proposed: Column, large: int = 50) -> Column:
    """High for tier 1, for status, and for units that differ by more than `large`."""
    off = F.coalesce(F.abs(proposed.try_cast("int") - kept.try_cast("int")), F.lit(0))
    return F.when((tier == 1) | (field == "pipeline_status") | (field.isin(*UNIT_FIELDS) & (off > large)), "high").otherwise("medium")


def unit_priority(units: Column) -> Column:
    return F.when(units >= 100, "high").when(units >= 25, "medium").otherwise("low")


def discovery_priority(item_type: Column, units: Column) -> Column:
    return F.when(item_type == "possible_match", "medium").otherwise(unit_priority(units))


def regression_priority(source: Column, rank_delta: Column, current_rank: Column, quiet: str = "vendor_a", partner: str = "vendor_b") -> Column:
    """Low for the quiet vendor; for the partner high from two ranks or from a project that is leasing on, else medium; high otherwise."""
    late = (rank_delta >= 2) | (current_rank >= RANK["Pre-Leasing/Pre-Selling"])
    return F.when(source == quiet, "low").when(source == partner, F.when(late, "high").otherwise("medium")).otherwise("high")


def unit_delta_exceeds(current: Column, new: Column, share: float) -> Column:
    """Whether units differ by more than a share of the current ones; unknown ones do not."""
    return F.coalesce((current != new) & (F.abs(new - current) / F.greatest(F.abs(current), F.lit(1)) > share), F.lit(False))


def compared(ours: Column, theirs: Column) -> Column:
    """match, missing_ours, missing_theirs or mismatch."""
    return F.when(ours.eqNullSafe(theirs), "match").when(ours.isNull(), "missing_ours").when(theirs.isNull(), "missing_theirs").otherwise("mismatch")


def compared_location(lat: Column, lng: Column, other_lat: Column, other_lng: Column, address: Column, other_address: Column, most: float = 100.0) -> Column:
    """By distance where both have a point, else by who lacks one, and by address where both do."""
    here, there = lat.isNotNull() & lng.isNotNull(), other_lat.isNotNull() & other_lng.isNotNull()
    near = F.when(haversine_meters(lat, lng, other_lat, other_lng) <= most, "match").otherwise("mismatch")
    return F.when(here & there, near).when(here, "missing_theirs").when(there, "missing_ours").otherwise(compared(address, other_address))


def auto_apply(enabled: bool, override: Column, outcome: Column, verdict: Column, current: Column, proposed: Column, stated_current: Column, stated_proposed: Column, confidence: Column, most_rank: int = RANK["Approved"], least: float = 0.90) -> Column:
    """Whether an agent's confirmed regression may apply by itself: it agrees with the group, goes back, from no late status, and is sure."""
    agrees = F.coalesce(stated_current, current).eqNullSafe(current) & F.coalesce(stated_proposed, proposed).eqNullSafe(proposed)
    good = override.isNull() & (outcome == "completed") & (verdict == "confirm_regression") & agrees & (proposed < current) & (current <= most_rank) & (confidence >= least)
    return F.lit(enabled) & F.coalesce(good, F.lit(False))


def overlaps(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose values are known and equal on both sides."""
    return reasons(*[(a == b, name) for name, (a, b) in pairs.items()])


def first_owners(identifiers: DataFrame, owned: DataFrame) -> DataFrame:
    """New (kind, value, project_id) rows: values that no project owns, each given to the first project that brings it."""
    fresh = identifiers.filter("value IS NOT NULL").join(owned, ["kind", "value"], "left_anti")
    return fresh.groupBy("kind", "value").agg(F.min_by("project_id", F.struct("loaded", "project_id")).alias("project_id"))


def upserted_overrides(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One active override for each (project, field): incoming values over existing ones, whose owner stays unless given."""
    a = existing.filter("NOT cleared").select("project_id", "field", F.col("value").alias("_v"), F.col("owner").alias("_w"), F.lit(True).alias("_a"))
    b = incoming.select("project_id", "field", F.col("value").alias("_n"), F.col("owner").alias("_x"), F.lit(True).alias("_b"))
    both = a.join(b, ["project_id", "field"], "full_outer")
    action = F.when(F.col("_b").isNull(), "keep").when(F.col("_a").isNull(), "insert").otherwise("update")
    return both.select("project_id", "field", F.when(F.col("_b"), F.col("_n")).otherwise(F.col("_v")).alias("value"), F.coalesce("_x", "_w").alias("owner"), action.alias("action"))


def cleared_overrides(overrides: DataFrame, fields: list[str], by: str) -> DataFrame:
    """Active overrides of the fields are closed; all rows stay."""
    closes = ~F.col("cleared") & F.col("field").isin(*fields)
    return overrides.select("project_id", "field", (F.col("cleared") | closes).alias("cleared"), F.when(closes, by).alias("cleared_by"))


def applied_decisions(decisions: DataFrame) -> DataFrame:
    """What each staged decision does once committed: to the override table and to the item."""
    staged = decisions.filter("state = 'staged'")
    discovery = F.col("item_type") == "new_candidate"
    route = F.when(discovery, F.when(F.col("decision_type") == "accept_new", "create_project").when(F.col("decision_type") == "keep_old", "reject").otherwise("link_project")).otherwise(
        F.when(F.col("decision_type") == "defer", "defer").when(F.col("decision_type") != "accept_new", "write_override").when(F.col("item_type") == "override_contradiction", "clear_override").otherwise("accept")
    )
    state = F.when(F.col("decision_type") == "defer", "open").otherwise("committed")
    return staged.select("item_id", "project_id", route.alias("effect"), state.alias("state"))


def decision_field(column: Column, payload: Column) -> Column:
    """The field that a decision is about: the item's, its payload's, or that of the first change."""
    at = lambda path: F.try_variant_get(F.try_parse_json(payload), path, "string")
    return F.coalesce(column, at("$.field_name"), at("$.changes[0].field"))


def kept_value(payload: Column) -> Column:
    """The value that keeping the old one keeps: the override's, the current one, or that of the first change."""
    at = lambda path: F.try_variant_get(F.try_parse_json(payload), path, "string")
    return F.coalesce(at("$.current_override.value"), at("$.current_value"), at("$.changes[0].old"))


def same_developer(a: Column, b: Column) -> Column:
    return F.coalesce(developer_name(a) == developer_name(b), F.lit(False))


def summary(item_type: Column, field: Column, project: Column, given: Column | None = None) -> Column:
    """The given summary, else one by the item's type, else a general one."""
    by_type = mapped(item_type, {"field_change": "Field change", "new_candidate": "New project candidate", "possible_match": "Possible match", "status_regression": "Status regression"})
    text = F.when(by_type.isNotNull(), F.concat(by_type, F.lit(": "), F.coalesce(field, F.lit("project")), F.lit(" of "), project.cast("string"))).otherwise("Review item")
    return text if given is None else F.coalesce(F.nullif(F.trim(given), F.lit("")), text)


def snippet(source: Column, field: Column, value: Column, day: Column) -> Column:
    """A line on an evidence row, by its source type."""
    label = mapped(source, {"city_permit": "Permit", "news_article": "Article"}, F.lit("Vendor"))
    return F.concat_ws(" ", label, F.concat(field, F.lit(":")), value, F.when(day.isNotNull(), F.concat(F.lit("("), day.cast("string"), F.lit(")"))))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows if there are at most n, else n of them, those first by a hash of seed and key; the same at each run."""
    place = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("_h", place).orderBy("_h", key).limit(n).drop("_h")


def failing_sources(runs: DataFrame, source: str, at: str, key: str, failed: Column, pause_from: int = 3, latest: int = 10) -> DataFrame:
    """(source, streak, action): the run of failures that a source's latest runs begin with; an alert, and a pause from `pause_from` on."""
    newest = Window.partitionBy(source).orderBy(F.desc(at), F.desc(key))
    rows = runs.select(source, F.row_number().over(newest).alias("_r"), failed.alias("_f")).filter(F.col("_r") <= latest)
    streak = F.coalesce(F.min(F.when(~F.col("_f"), F.col("_r"))) - 1, F.max("_r"))
    found = rows.groupBy(source).agg(streak.cast("int").alias("streak"))
    return found.withColumn("action", F.when(F.col("streak") >= pause_from, "pause").when(F.col("streak") > 0, "alert").otherwise("none"))


#: The fields by which a subject and a candidate are compared, with their types.
COMPARABLE = {
    "project_name": "text", "canonical_address": "text", "developer": "text", "total_units": "integer", "market_rate_units": "integer", "affordable_units": "integer",
    "workforce_units": "integer", "product_type": "enum", "age_restriction": "enum", "pipeline_status": "enum", "stories": "integer",
}


def typed_deltas(pairs: DataFrame, keys: list[str], subject: str = "s_", candidate: str = "c_") -> DataFrame:
    """(keys..., field, field_type, current_value, evidence_value): comparable fields that the subject knows and the candidate has otherwise or not.

    Texts are compared trimmed, and a blank one is unknown; whole numbers by value, so 12 and 12.0 are
    the same. `pairs` has the fields of both sides under their prefixes.
    """

    def value(name: str, kind: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.when(text != "", F.coalesce(text.try_cast("double").try_cast("long").cast("string"), text) if kind == "integer" else text)

    one = lambda f, kind: F.struct(F.lit(f).alias("field"), F.lit(kind).alias("field_type"), value(f"{candidate}{f}", kind).alias("current_value"), value(f"{subject}{f}", kind).alias("evidence_value"))
    rows = pairs.select(*keys, F.inline(F.array(*[one(f, kind) for f, kind in COMPARABLE.items()])))
    return rows.filter(F.col("evidence_value").isNotNull() & ~F.col("evidence_value").eqNullSafe(F.col("current_value")))
