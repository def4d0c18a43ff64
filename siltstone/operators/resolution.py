"""Field resolution over evidence: ordering, winners, the status ladder, confidence and likelihood.

Everything is set-based and clustered by project, so one exchange of the evidence serves
all windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.dates import effective_date, estimated_delivery, months_ago
from siltstone.functions.text import mapped

SOURCE_PRIORITY = {"city_permit": 0, "vendor_a": 1, "vendor_b": 2}
RANK = {s: i for i, s in enumerate(fixed.STATUS_ORDER)}
APPROVED, BUILDING, COMPLETE = RANK["Approved"], RANK["Under Construction"], RANK["Complete"]
PERMIT, INSPECTION, OCCUPANCY = "building_permit_issued", "building_inspection_recorded", "certificate_of_occupancy_issued"


def observation_order(priority: dict[str, int] = SOURCE_PRIORITY) -> list[Column]:
    """Newest effective date, newest collection (whole seconds), best source, best tier; then the id."""
    return [
        effective_date(F.col("evidence_date"), F.col("collected_at")).desc(), F.unix_timestamp("collected_at").desc(),
        mapped(F.col("source_type"), priority, F.lit(len(priority))).asc(), F.col("tier").asc(), F.col("evidence_id").asc(),
    ]


def inferred_confidence(tier: Column, day: Column, sources: Column, as_of: Column, explicit: Column | None = None, fresh_days: int = 180) -> Column:
    """Stated confidence, else high for tier 1, and for fresh evidence high with two sources or medium of tier 2 or 3; else low."""
    fresh = day >= F.date_sub(as_of, fresh_days)
    out = F.when(tier == 1, "high").when(fresh & (sources >= 2), "high").when(fresh & tier.isin(2, 3), "medium").otherwise("low")
    return out if explicit is None else F.coalesce(explicit, out)


def most_recent(evidence: DataFrame, field: str, as_of: Column, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(project_id, value, evidence_id, confidence): the most recent known value, of allowed sources if given."""
    rows = evidence.filter(F.col(field).isNotNull())
    if allowed is not None:
        rows = rows.filter(F.col("source_type").isin(*allowed))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("project_id").orderBy(*observation_order()))).filter("_r <= 2")
    first = lambda c: F.max(F.when(F.col("_r") == 1, c))
    top = rows.groupBy("project_id").agg(
        first(F.col(field)).alias("value"), first(F.col("evidence_id")).alias("evidence_id"), first(F.col("tier")).alias("tier"),
        first(effective_date(F.col("evidence_date"), F.col("collected_at"))).alias("day"), F.countDistinct("source_type").alias("sources"),
    )
    return top.select("project_id", "value", "evidence_id", inferred_confidence(F.col("tier"), F.col("day"), F.col("sources"), as_of).alias("confidence"))


def resolve_status(evidence: DataFrame, projects: DataFrame, as_of: Column) -> DataFrame:
    """(project_id, status_rank, confidence, rule, needs_review) by a ladder that never goes back by itself.

    `evidence` has status_rank (stated, may be null) and signal (a kind of official evidence,
    may be null); `projects` has the current status_rank, null for the manual statuses. A
    certificate of occupancy makes a project complete. Otherwise the highest supported status
    wins; under construction needs tier 1, a permit or two other sources. A lower one keeps
    the current status, and a manual status is only left by review.
    """
    by_project = Window.partitionBy("project_id")
    stated = F.col("status_rank")
    outside = F.when((stated == BUILDING) & (F.col("tier") > 1), F.col("source_type"))
    rows = evidence.withColumns({
        "_permit": F.max(F.when(F.col("signal") == PERMIT, 1)).over(by_project).isNotNull(),
        "_outside": F.size(F.collect_set(outside).over(by_project)),
        "_nth": F.row_number().over(Window.partitionBy("project_id", "signal").orderBy(*observation_order())),
    })
    good = stated.isNotNull() & ((stated != BUILDING) | (F.col("tier") == 1) | F.col("_permit") | (F.col("_outside") >= 2))
    official = mapped(F.col("signal"), {k: RANK[v] for k, v in fixed.EVIDENCE_STATUS.items()})
    both = F.array_compact(F.array(
        F.when(good, F.struct(stated.cast("int").alias("rank"), F.lit(0).alias("kind"))),
        F.when(official.isNotNull() & (F.col("_nth") == 1), F.struct(official.alias("rank"), F.lit(1).alias("kind"))),
    ))
    found = rows.select("project_id", "source_type", "tier", "evidence_date", "collected_at", "evidence_id", "signal", "_permit", "_outside", F.inline(both))
    top = found.withColumn("_best", F.max("rank").over(by_project)).withColumn("_cofo", F.max(F.when((F.col("kind") == 1) & (F.col("signal") == OCCUPANCY), 1)).over(by_project))
    top = top.withColumn("_inspected", F.max(F.when((F.col("kind") == 1) & (F.col("signal") == INSPECTION), 1)).over(by_project)).filter("rank = _best")
    top = top.withColumn("_r", F.row_number().over(by_project.orderBy("kind", *observation_order())))
    first = lambda c: F.max(F.when(F.col("_r") == 1, c))
    best = top.groupBy("project_id").agg(
        F.max("rank").alias("chosen"), F.max("_cofo").isNotNull().alias("cofo"), F.max("_permit").alias("permit"), F.max("_outside").alias("outside"), F.min("tier").alias("least_tier"), first(F.col("tier")).alias("tier"),
        first(effective_date(F.col("evidence_date"), F.col("collected_at"))).alias("day"), F.countDistinct(F.when(F.col("_r") <= 2, F.col("source_type"))).alias("sources"),
        F.max("_inspected").isNull().alias("uninspected"), F.bool_and(F.col("kind") == 1).alias("only_official"),
    )
    building = F.when((F.col("least_tier") == 1) | F.col("permit"), "high").when(F.col("outside") >= 2, "medium").otherwise("low")
    strength = F.when(F.col("chosen") == BUILDING, building).otherwise(inferred_confidence(F.col("tier"), F.col("day"), F.col("sources"), as_of))
    now, chosen = F.col("current"), F.col("chosen")
    joined = projects.select("project_id", F.col("status_rank").alias("current")).join(best, "project_id", "left")
    rule = (
        F.when(chosen.isNull(), "no_status_evidence").when(F.col("cofo"), "direct_cofo_evidence").when(now.isNull(), "manual_status_review_preserve_current")
        .when((chosen < now) & (now == COMPLETE), "terminal_regression_dropped").when(chosen < now, "forward_only_preserve_current").otherwise("highest_status_wins")
    )
    out = joined.withColumn("rule", rule)
    wins = F.col("rule") == "highest_status_wins"
    status = F.when(F.col("rule") == "direct_cofo_evidence", COMPLETE).when(wins, chosen).otherwise(now)
    confidence = F.when(F.col("rule") == "direct_cofo_evidence", "high").when(wins, strength).otherwise("low")
    review = (wins & (chosen == APPROVED) & F.col("only_official") & F.col("uninspected")) | (F.col("rule") == "manual_status_review_preserve_current")
    return out.select("project_id", status.cast("int").alias("status_rank"), confidence.alias("confidence"), "rule", F.coalesce(review, F.lit(False)).alias("needs_review"))


def likelihood(status: Column, last: Column, permits: Column, top_tier: Column, as_of: Column) -> Column:
    """Base rate of the status and what recent, missing or official activity adds; 1 under construction, else .02 to .98."""
    base = mapped(status, fixed.BASE_RATES, F.lit(0.08))
    recent = F.when(last >= F.date_sub(as_of, 90), 0.05).otherwise(0.0)
    quiet = F.when(last.isNull() | (last < months_ago(as_of, 24)), -0.20).when(last < months_ago(as_of, 12), -0.10).otherwise(0.0)
    total = base + recent + F.when(permits, 0.08).otherwise(0.0) + F.when(top_tier, 0.05).otherwise(0.0) + quiet
    return F.when(status == "Under Construction", 1.0).otherwise(F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.98), total)), 6))


def with_override(value: Column, override: Column, mode: Column, by_system: Column, newer: Column) -> Column:
    """An override wins, unless a system one that lasts until newer evidence is outdated."""
    outdated = (mode == "until_newer_evidence") & by_system & newer
    return F.when(override.isNotNull() & ~F.coalesce(outdated, F.lit(False)), override).otherwise(value)


def delivery(stated: Column, current: Column, status: Column, units: Column, as_of: Column) -> Column:
    """The stated date (none of the future once complete), else the current one, else an estimate."""
    future = lambda d: F.coalesce((status == "Complete") & (d > as_of), F.lit(False))
    keep = lambda d: F.when(~future(d), d)
    return F.coalesce(keep(stated), keep(current), estimated_delivery(status, units, as_of))


def suggestion(current: Column, kind: Column) -> Column:
    """The status that a kind of official evidence suggests, if it is a higher one."""
    rank = lambda c: mapped(c, RANK)
    proposed = mapped(kind, fixed.EVIDENCE_STATUS)
    higher = current.isNull() | (rank(current).isNull() & (current != proposed)) | (rank(proposed) > rank(current))
    return F.when(higher, proposed)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, old, new, priority) of fields that differ, null-safe; fields maps names to priorities."""
    both = before.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields]).join(after.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields]), key)
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new"), F.lit(fields[f]).alias("priority"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), one(f)) for f in fields]))
    return both.select(key, F.inline(changed))


def delta_shape(old: Column, new: Column) -> Column:
    """How a value changed; null and '' are the same."""
    a, b = F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))
    return F.when(a.eqNullSafe(b), "unchanged").when(a.isNull(), "null_to_value").when(b.isNull(), "value_to_null").otherwise("value_changed")


def upsert_cards(active: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What becomes of review cards of one key: kept, refreshed, replaced or created; both sides have one `proposed` per key."""
    a, b = active.select(*keys, F.col("proposed").alias("_a"), F.lit(True).alias("_has")), incoming.select(*keys, F.col("proposed").alias("_b"), F.lit(True).alias("_new"))
    joined = a.join(b, keys, "full_outer")
    action = F.when(F.col("_new").isNull(), "keep").when(F.col("_has").isNull(), "create").when(F.col("_a").eqNullSafe(F.col("_b")), "refresh").otherwise("replace")
    return joined.select(*keys, action.alias("action"), F.when(F.col("_new").isNull(), F.col("_a")).otherwise(F.col("_b")).alias("proposed"))


def contradicts(field: Column, override: Column, value: Column) -> Column:
    """Whether a resolved value speaks against an override: units by more than 5, dates by more than 30 days, else by text."""
    units = F.abs(override.try_cast("double") - value.try_cast("double")) > 5
    days = F.abs(F.datediff(F.try_to_date(override, "yyyy-MM-dd"), F.try_to_date(value, "yyyy-MM-dd"))) > 30
    return F.coalesce(F.when(field == "total_units", units).when(field == "date_delivery", days).otherwise(F.lower(F.trim(override)) != F.lower(F.trim(value))), F.lit(False))
