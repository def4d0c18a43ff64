"""References of articles: scope, match ladder, extracted fields, and what a new extraction supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import has_zip
from siltstone.operators.matching import by_identifier


def current_references(references: DataFrame) -> DataFrame:
    """References of their article's current extraction; of articles without one, all."""
    return references.filter(F.col("current_extraction_id").isNull() | (F.col("extraction_id") == F.col("current_extraction_id")))


def scope_sizes(references: DataFrame, projects: DataFrame, market: str = "market_id") -> DataFrame:
    """(reference_id, n): how many projects an article may name: those of its market, or all if it is of none.

    Counted by market first, so no pair is made.
    """
    counts = projects.groupBy(market).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.unionByName(counts.agg(F.sum("_n").alias("_n")).select(F.lit(None).cast(projects.schema[market].dataType).alias(market), "_n"))
    met = references.select("reference_id", F.col(market).alias("_m")).join(sizes, F.col("_m").eqNullSafe(F.col(market)))
    return met.select("reference_id", F.col("_n").alias("n"))


def address_composite(references: DataFrame, projects: DataFrame, confirmed: float = 0.75, possible: float = 0.40) -> DataFrame:
    """(reference_id, status, project_id, score, candidates): projects of the reference's market and address, scored.

    An equal address is .50, one that adds a ZIP .40 (only where none is equal); the name
    adds .15, the developer .20, units within a quarter .05. The top one is confirmed if it
    is alone at the top and reaches `confirmed`. References that agree in all that is compared
    meet, once for all of them, projects that agree in it, with their number and least id, so
    that copies make no pairs; nothing is broadcast.
    """
    seen = lambda rows: rows.filter("address IS NOT NULL").withColumns({"name": F.lower("name"), "developer": F.lower("developer")})
    place, compared = ["market_id", "address"], ["name", "developer", "units"]
    p = seen(projects).groupBy(*place, *[F.col(c).alias(f"_{c}") for c in compared]).agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).alias("_k"))
    want = seen(references).select(*place, *compared).distinct()
    equal = want.join(p.hint("merge"), place).withColumn("_base", F.lit(0.50))
    rest = want.filter(~has_zip(F.col("address"))).join(p.select(*place).distinct().hint("merge"), place, "left_anti")
    bare = p.filter(has_zip(F.col("address"))).withColumn("address", F.regexp_replace("address", r" \d{5}$", ""))
    both = equal.unionByName(rest.join(bare.hint("merge"), place).withColumn("_base", F.lit(0.40)))
    adds = lambda when, value: F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)
    near = F.try_divide(F.abs(F.col("units") - F.col("_units")), F.greatest("units", "_units")) <= 0.25
    score = F.round(F.col("_base") + adds(F.col("name") == F.col("_name"), 0.15) + adds(F.col("developer") == F.col("_developer"), 0.20) + adds(near, 0.05), 6)
    scored = both.select(*place, *compared, score.alias("score"), "project_id", F.col("_k").alias("_alone"), F.col("_k").alias("candidates"))

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        """The top score of each key, how many projects have it, the least of them, and how many there are in all."""
        each = rows.groupBy(*keys, "score").agg(F.min("project_id").alias("project_id"), F.sum("_alone").alias("_alone"), F.sum("candidates").alias("candidates"))
        top = each.groupBy(*keys).agg(F.max_by(F.struct("project_id", "_alone"), "score").alias("_b"), F.max("score").alias("score"), F.sum("candidates").alias("candidates"))
        return top.select(*keys, "_b.*", "score", "candidates")

    tops = best(scored, *place, *compared).filter(F.col("score") >= possible).withColumnsRenamed({c: f"_{c}" for c in place + compared})
    same = [F.col(c) == F.col(f"_{c}") for c in place] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compared]
    found = best(seen(references).select("reference_id", *place, *compared).join(tops.hint("merge"), same), "reference_id")
    status = F.when((F.col("score") >= confirmed) & (F.col("_alone") == 1), "confirmed").otherwise("possible")
    return found.select("reference_id", status.alias("status"), F.when(status == "confirmed", F.col("project_id")).alias("project_id"), "score", "candidates")


def identifier_step(identifiers: DataFrame, owned: DataFrame) -> DataFrame:
    """(reference_id, status, project_id, score): references whose case, permit or parcel numbers one project owns, or several.

    `identifiers` is (reference_id, kind, value), `owned` (kind, value, project_id); values are compared
    by their letters and digits. A reference may have several numbers, which count together.
    """
    plain = lambda rows: rows.withColumn("value", F.regexp_replace(F.upper("value"), "[^A-Z0-9]", "")).filter("value <> ''")
    named = plain(identifiers).select("reference_id", "kind", "value").distinct()
    found = by_identifier(named, plain(owned).select("kind", "value", "project_id").distinct(), "reference_id", ["kind", "value"], "project_id")
    return found.select("reference_id", F.when(F.col("possible"), "possible").otherwise("confirmed").alias("status"), F.when(~F.col("possible"), F.col("owner")).alias("project_id"), F.col("confidence").alias("score"))


def hint_step(hints: DataFrame, projects: DataFrame, score: float = 0.96) -> DataFrame:
    """(reference_id, status, project_id, score): references for which the extraction named a project that exists."""
    known = hints.join(projects.select("project_id").hint("merge"), "project_id").groupBy("reference_id").agg(F.min("project_id").alias("project_id"))
    return known.select("reference_id", F.lit("confirmed").alias("status"), "project_id", F.lit(score).alias("score"))


def ladder(references: DataFrame, steps: list[tuple[str, DataFrame]], strong: Column) -> DataFrame:
    """The first step that finds something; else a new candidate where the signals are strong, else discarded.

    Each step is (reference_id, status, project_id, score).
    """
    out = references
    for name, found in steps:
        out = out.join(found.select("reference_id", F.struct(F.lit(name).alias("step"), "status", "project_id", "score").alias(f"_{name}")).hint("merge"), "reference_id", "left")
    first = F.coalesce(*[F.col(f"_{name}") for name, _ in steps])
    rest = F.when(strong, "new_candidate").otherwise("discarded")
    return out.select("reference_id", F.coalesce(first["step"], rest).alias("step"), F.coalesce(first["status"], rest).alias("status"), first["project_id"].alias("project_id"), first["score"].alias("score"))


def extracted_fields(values: dict[str, Column], confidence: Column) -> Column:
    """map(field, struct(value, confidence)) of the fields that have a value."""
    entry = lambda f, v: F.struct(F.lit(f).alias("key"), F.struct(v.cast("string").alias("value"), confidence.alias("confidence")).alias("value"))
    return F.map_from_entries(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(v.cast("string")) != "", F.lit(False)), entry(f, v)) for f, v in values.items()])))


def superseded_references(references: DataFrame, terminal: tuple[str, ...] = ("confirmed", "discarded")) -> DataFrame:
    """References with their status: those of earlier extractions that are not settled become superseded."""
    old = F.coalesce(F.col("extraction_id") != F.col("current_extraction_id"), F.lit(False)) & ~F.col("match_status").isin(*terminal)
    return references.select("reference_id", F.when(old, "superseded").otherwise(F.col("match_status")).alias("status"))


def stale_evidence(evidence: DataFrame, articles: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence whose raw JSON names one of the articles and that is not among its current evidence."""
    named = evidence.withColumn("article_id", F.try_variant_get(F.try_parse_json("raw"), "$.article_id", "bigint"))
    return named.join(articles.select("article_id").distinct(), "article_id", "left_semi").join(current.select("evidence_id"), "evidence_id", "left_anti").select("evidence_id", "article_id")


def parcel_projects(evidence: DataFrame, parcels: list[str]) -> DataFrame:
    """Projects of evidence whose raw or extracted JSON has one of the parcel's spellings."""
    at = lambda c, path: F.try_variant_get(F.try_parse_json(c), path, "string")
    hit = at(F.col("raw"), "$.apn").isin(*parcels) | at(F.col("extracted"), "$.apn.value").isin(*parcels)
    return evidence.filter(F.coalesce(hit, F.lit(False)) & F.col("project_id").isNotNull()).select("project_id").distinct()


def first_signal(signals: Column, extractors: list[str]) -> Column:
    """Of an array(struct(extractor, canonical)) the first canonical value of one of the extractors."""
    return F.get(F.filter(signals, lambda s: s["extractor"].isin(*extractors)), F.lit(0))["canonical"]
