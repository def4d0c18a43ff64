"""Review queries: priorities, triggers, comparisons, overrides and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import fields as fields_op
from siltstone.operators import resolution as resolution_op
from siltstone.operators import review as op
from siltstone.operators.ranking import numbered
from siltstone.registry import query
from siltstone.session import table

_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2))))"
_UNITS = "CASE WHEN {0} >= 100 THEN 'high' WHEN {0} >= 25 THEN 'medium' ELSE 'low' END"


@query(
    """SELECT evidence_id, f.field, CASE WHEN tier = 1 OR f.field = 'pipeline_status' OR (f.field = 'units' AND abs(e.units - p.units) > 30) THEN 'high' ELSE 'medium' END AS priority
       FROM fielded e JOIN project p USING (project_id), (SELECT unnest(['units', 'pipeline_status', 'developer']) AS field) f""",
    "fielded", "project",
)
def contradiction_priorities(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "fielded", "project")
    rows = evidence.select("evidence_id", "project_id", "tier", F.col("units").alias("proposed")).join(project.select("project_id", F.col("units").alias("kept")), "project_id")
    rows = rows.withColumn("field", F.explode(F.array(F.lit("units"), F.lit("pipeline_status"), F.lit("developer"))))
    return rows.select("evidence_id", "field", op.contradiction_priority(F.col("field"), F.col("tier"), F.col("kept"), F.col("proposed"), 30).alias("priority"))


@query(f"SELECT reference_id, {_UNITS.format('units')} AS candidate, CASE WHEN match_status = 'possible' THEN 'medium' ELSE {_UNITS.format('units')} END AS discovery FROM reference", "reference")
def candidate_priorities(spark, sf_dir):
    (refs,) = views(spark, sf_dir, "reference")
    kind = F.when(F.col("match_status") == "possible", "possible_match").otherwise("new_candidate")
    return refs.select("reference_id", op.unit_priority(F.col("units")).alias("candidate"), op.discovery_priority(kind, F.col("units")).alias("discovery"))


@query(
    """SELECT evidence_id, CASE source_type WHEN 'vendor_a' THEN 'low' WHEN 'vendor_b' THEN CASE WHEN p.status_rank - e.status_rank >= 2 OR p.status_rank >= 5 THEN 'high' ELSE 'medium' END ELSE 'high' END AS priority
       FROM fielded e JOIN project p USING (project_id) WHERE e.status_rank < p.status_rank""",
    "fielded", "project",
)
def status_regression_priority(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "fielded", "project")
    rows = evidence.join(project.select("project_id", F.col("status_rank").alias("now")), "project_id").filter("status_rank < now")
    return rows.select("evidence_id", op.regression_priority(F.col("source_type"), F.col("now") - F.col("status_rank"), F.col("now")).alias("priority"))


@query(
    """SELECT evidence_id, array_to_string(list_filter([CASE WHEN p.project_id IS NULL THEN 'new_candidate' END, CASE WHEN e.units <> p.units AND abs(e.units - p.units) / greatest(abs(p.units), 1) > 0.25 THEN 'unit_delta' END,
         CASE WHEN p.project_id IS NOT NULL AND e.status_rank < p.status_rank THEN 'status_regression_candidate' END], lambda x: x IS NOT NULL), ',') AS triggers
       FROM fielded e LEFT JOIN (SELECT * FROM project WHERE project_id % 3 <> 0) p USING (project_id) WHERE source_type = 'city_permit'""",
    "fielded", "project",
)
def permit_agent_triggers(spark, sf_dir):
    """What a permit record asks of an agent: a new candidate if unmatched, else unit changes and regressions."""
    evidence, project = views(spark, sf_dir, "fielded", "project")
    known = project.filter("project_id % 3 <> 0").select("project_id", F.col("units").alias("now_units"), F.col("status_rank").alias("now"), F.lit(True).alias("known"))
    rows = evidence.filter("source_type = 'city_permit'").join(known, "project_id", "left")
    triggers = op.reasons((F.col("known").isNull(), "new_candidate"), (op.unit_delta_exceeds(F.col("now_units"), F.col("units"), 0.25), "unit_delta"), (F.col("status_rank") < F.col("now"), "status_regression_candidate"))
    return rows.select("evidence_id", F.array_join(triggers, ",").alias("triggers"))


@query(
    """SELECT reference_id, array_to_string(list_filter([CASE WHEN abs(r.units - p.units) / greatest(abs(p.units), 1) > 0.10 OR lower(r.developer) <> lower(p.developer) THEN 'material_contradiction' END, CASE WHEN match_status = 'new_candidate' THEN 'new_candidate' END,
         CASE WHEN match_status = 'possible' AND candidates > 0 THEN 'possible_multi_candidate' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS triggers
       FROM reference r LEFT JOIN project p USING (project_id)""",
    "reference", "project",
)
def reference_agent_triggers(spark, sf_dir):
    refs, project = views(spark, sf_dir, "reference", "project")
    rows = refs.join(project.select("project_id", F.col("units").alias("now"), F.col("developer").alias("current")), "project_id", "left")
    material = F.coalesce(F.abs(F.col("units") - F.col("now")) / F.greatest(F.abs("now"), F.lit(1)) > 0.10, F.lit(False)) | F.coalesce(~op.same_developer(F.col("developer"), F.col("current")) & F.col("developer").isNotNull() & F.col("current").isNotNull(), F.lit(False))
    status = F.col("match_status")
    triggers = op.reasons((material, "material_contradiction"), (status == "new_candidate", "new_candidate"), ((status == "possible") & (F.col("candidates") > 0), "possible_multi_candidate"), (F.col("confidence") == "low", "low_confidence"))
    return rows.select("reference_id", F.array_join(triggers, ",").alias("triggers"))


@query(
    """SELECT reference_id, 'units' AS field, CAST(p.units AS VARCHAR) AS current, CAST(r.units AS VARCHAR) AS candidate, round(abs(r.units - p.units) / greatest(abs(p.units), 1), 4) AS ratio FROM reference r JOIN project p USING (project_id) WHERE match_status = 'confirmed' AND abs(r.units - p.units) / greatest(abs(p.units), 1) > 0.10
       UNION ALL SELECT reference_id, 'developer', p.developer, r.developer, NULL FROM reference r JOIN project p USING (project_id) WHERE match_status = 'confirmed' AND lower(r.developer) <> lower(p.developer)""",
    "reference", "project",
)
def material_contradictions(spark, sf_dir):
    refs, project = views(spark, sf_dir, "reference", "project")
    rows = refs.filter("match_status = 'confirmed'").join(project.select("project_id", F.col("units").alias("now"), F.col("developer").alias("current")), "project_id")
    ratio = F.abs(F.col("units") - F.col("now")) / F.greatest(F.abs("now"), F.lit(1))
    entry = lambda f, a, b, r: F.struct(F.lit(f).alias("field"), a.cast("string").alias("current"), b.cast("string").alias("candidate"), r.alias("ratio"))
    units = F.when(ratio > 0.10, entry("units", F.col("now"), F.col("units"), F.round(ratio, 4)))
    differs = F.col("developer").isNotNull() & F.col("current").isNotNull() & ~op.same_developer(F.col("developer"), F.col("current"))
    developer = F.when(differs, entry("developer", F.col("current"), F.col("developer"), F.lit(None).cast("double")))
    return rows.select("reference_id", F.inline(F.array_compact(F.array(units, developer))))


@query(
    """SELECT reference_id, coalesce(r.status_rank < p.status_rank AND p.status_rank <= 3 AND score >= 0.90 AND match_status = 'confirmed' AND confidence = 'high' AND o.project_id IS NULL, FALSE) AS applies
       FROM reference r JOIN project p USING (project_id) LEFT JOIN (SELECT project_id FROM override WHERE NOT cleared AND field = 'developer') o USING (project_id)""",
    "reference", "project", "override",
)
def auto_apply_gate(spark, sf_dir):
    refs, project, overrides = views(spark, sf_dir, "reference", "project", "override")
    held = overrides.filter("NOT cleared AND field = 'developer'").select("project_id", F.col("value").alias("held"))
    rows = refs.join(project.select("project_id", F.col("status_rank").alias("now")), "project_id").join(held, "project_id", "left")
    none = F.lit(None).cast("int")
    gate = op.auto_apply(True, F.col("held"), F.when(F.col("match_status") == "confirmed", "completed"), F.when(F.col("confidence") == "high", "confirm_regression"), F.col("now"), F.col("status_rank"), none, none, F.col("score"))
    return rows.select("reference_id", gate.alias("applies"))


_PAIRS = "FROM project a JOIN project b ON b.project_id = a.project_id + 7"


def _neighbours(spark, sf_dir):
    """Each project with the one whose id is greater by 7, columns prefixed a_ and b_."""
    (project,) = views(spark, sf_dir, "project")
    side = lambda p: project.select(*[F.col(c).alias(f"{p}_{c}") for c in project.columns])
    return side("a").join(side("b"), F.col("b_project_id") == F.col("a_project_id") + 7)


@query(f"""SELECT a.project_id, array_to_string(list_filter([CASE WHEN a.developer = b.developer THEN 'developer' END, CASE WHEN a.units = b.units THEN 'units' END, CASE WHEN a.product_type = b.product_type THEN 'product_type' END, CASE WHEN a.status_rank = b.status_rank THEN 'status' END], lambda x: x IS NOT NULL), ',') AS overlaps {_PAIRS}""", "project")
def candidate_overlaps(spark, sf_dir):
    names = {"developer": "developer", "units": "units", "product_type": "product_type", "status": "status_rank"}
    found = op.overlaps({label: (F.col(f"a_{c}"), F.col(f"b_{c}")) for label, c in names.items()})
    return _neighbours(spark, sf_dir).select(F.col("a_project_id").alias("project_id"), F.array_join(found, ",").alias("overlaps"))


@query(
    f"""SELECT * FROM (SELECT a.project_id, 'address' AS field, a.address AS subject, b.address AS candidate {_PAIRS} UNION ALL SELECT a.project_id, 'units', CAST(a.units AS VARCHAR), CAST(b.units AS VARCHAR) {_PAIRS}
       UNION ALL SELECT a.project_id, 'developer', a.developer, b.developer {_PAIRS}) WHERE subject IS NOT NULL AND subject IS DISTINCT FROM candidate""",
    "project",
)
def candidate_deltas(spark, sf_dir):
    """Fields that the subject knows and the candidate has otherwise or not."""
    each = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("subject"), F.col(f"b_{f}").cast("string").alias("candidate"))
    rows = _neighbours(spark, sf_dir).select(F.col("a_project_id").alias("project_id"), F.inline(F.array(*[each(f) for f in ("address", "units", "developer")])))
    return rows.filter(F.col("subject").isNotNull() & ~F.col("subject").eqNullSafe(F.col("candidate")))


_SIDES = {
    "project_name": ("concat(' ', name, ' ')", "name"), "canonical_address": ("address", "address"), "developer": ("CASE WHEN project_id % 5 = 0 THEN '  ' ELSE developer END", "developer"), "total_units": ("CAST(units AS VARCHAR(9))", "concat(CAST(units AS VARCHAR(9)), '.0')"),
    "market_rate_units": ("CAST(units % 9 AS VARCHAR(9))", "CAST(units % 8 AS VARCHAR(9))"), "affordable_units": ("NULL", "CAST(units % 3 AS VARCHAR(9))"), "workforce_units": ("CAST(units % 2 AS VARCHAR(9))", "NULL"), "product_type": ("product_type", "product_type"),
    "age_restriction": ("CASE WHEN project_id % 2 = 0 THEN 'Senior' END", "CASE WHEN project_id % 3 = 0 THEN 'Senior' ELSE 'Unknown' END"), "pipeline_status": ("concat('S', CAST(status_rank AS VARCHAR(9)))", "concat('S', CAST(status_rank % 4 AS VARCHAR(9)))"), "stories": ("CAST(units % 5 AS VARCHAR(9))", "CAST(units % 5 AS VARCHAR(9))"),
}
_WHOLE = "coalesce(CAST(TRY_CAST(TRY_CAST(trim({0}) AS DOUBLE) AS BIGINT) AS VARCHAR), trim({0}))"
_TYPED = " UNION ALL ".join(
    f"SELECT s.project_id AS subject_id, c.project_id AS candidate_id, '{f}' AS field, '{kind}' AS field_type, CASE WHEN trim(c.c_{f}) <> '' THEN {(_WHOLE if kind == 'integer' else 'trim({0})').format('c.c_' + f)} END AS current_value, CASE WHEN trim(s.s_{f}) <> '' THEN {(_WHOLE if kind == 'integer' else 'trim({0})').format('s.s_' + f)} END AS evidence_value FROM sub s JOIN can c ON c.project_id = s.project_id + 7"
    for f, kind in op.COMPARABLE.items()
)


@query(
    f"""WITH sub AS (SELECT project_id, {", ".join(f"CAST({a} AS VARCHAR) AS s_{f}" for f, (a, _) in _SIDES.items())} FROM project), can AS (SELECT project_id, {", ".join(f"CAST({b} AS VARCHAR) AS c_{f}" for f, (_, b) in _SIDES.items())} FROM project)
      SELECT * FROM ({_TYPED}) WHERE evidence_value IS NOT NULL AND evidence_value IS DISTINCT FROM current_value""",
    "project",
)
def comparable_deltas(spark, sf_dir):
    """All eleven comparable fields of subjects and candidates, by their types."""
    (project,) = views(spark, sf_dir, "project")
    side = lambda name, prefix, k: project.select(F.col("project_id").alias(name), *[F.expr(x[k]).cast("string").alias(f"{prefix}{f}") for f, x in _SIDES.items()])
    pairs = side("subject_id", "s_", 0).join(side("candidate_id", "c_", 1), F.col("candidate_id") == F.col("subject_id") + 7)
    return op.typed_deltas(pairs, ["subject_id", "candidate_id"])


_COMPARE = "CASE WHEN {0} IS NOT DISTINCT FROM {1} THEN 'match' WHEN {0} IS NULL THEN 'missing_ours' WHEN {1} IS NULL THEN 'missing_theirs' ELSE 'mismatch' END"
_POINTS = """a AS (SELECT project_id, units, address, CASE WHEN project_id % 6 <> 0 THEN lat END AS lat, lng FROM project), b AS (SELECT project_id, CASE WHEN project_id % 5 <> 0 THEN CASE WHEN project_id % 4 = 0 THEN units + 1 ELSE units END END AS units,
  CASE WHEN project_id % 9 <> 0 THEN address END AS address, CASE WHEN project_id % 7 <> 0 AND project_id % 12 <> 0 THEN CASE WHEN project_id % 4 = 0 THEN lat + 0.002 ELSE lat END END AS lat, lng FROM project)"""


def _both(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    a = project.select("project_id", "units", "address", F.when(p % 6 != 0, F.col("lat")).alias("lat"), "lng")
    b = project.select(
        "project_id", F.when(p % 5 != 0, F.when(p % 4 == 0, F.col("units") + 1).otherwise(F.col("units"))).alias("b_units"), F.when(p % 9 != 0, F.col("address")).alias("b_address"),
        F.when((p % 7 != 0) & (p % 12 != 0), F.when(p % 4 == 0, F.col("lat") + 0.002).otherwise(F.col("lat"))).alias("b_lat"), F.col("lng").alias("b_lng"),
    )
    return a.join(b, "project_id")


@query(
    f"""WITH {_POINTS} SELECT project_id, {_COMPARE.format("a.units", "b.units")} AS units, CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN CASE WHEN {_HAVERSINE} <= 100 THEN 'match' ELSE 'mismatch' END WHEN a.lat IS NOT NULL THEN 'missing_theirs' WHEN b.lat IS NOT NULL THEN 'missing_ours'
         ELSE {_COMPARE.format("a.address", "b.address")} END AS location FROM a JOIN b USING (project_id)""",
    "project",
)
def record_comparison(spark, sf_dir):
    c = F.col
    location = op.compared_location(c("lat"), c("lng"), c("b_lat"), c("b_lng"), c("address"), c("b_address"))
    return _both(spark, sf_dir).select("project_id", op.compared(c("units"), c("b_units")).alias("units"), location.alias("location"))


@query(
    f"""WITH {_POINTS}, j AS (SELECT project_id, {_COMPARE.format("a.units", "b.units")} AS units, a.address, regexp_extract(coalesce(a.address, b.address), '[0-9]{{5}}$') AS zip, make_date(1999, 1, 1) + CAST(project_id % 900 AS INT) AS seen FROM a JOIN b USING (project_id)),
       f AS (SELECT * FROM j WHERE zip IN ('90001', '90005', '90011', '90021') AND seen BETWEEN DATE '1999-03-01' AND DATE '2000-12-31')
       SELECT project_id, units, CAST(row_number() OVER (PARTITION BY zip ORDER BY CASE units WHEN 'match' THEN 1 ELSE 0 END, address NULLS LAST, project_id) AS INT) AS place FROM f""",
    "project",
)
def comparison_order(spark, sf_dir):
    """Rows of some ZIPs of either side, seen within a window, disagreements first within a ZIP."""
    c = F.col
    zip_code = F.regexp_extract(F.coalesce("address", "b_address"), r"(\d{5})$", 1)
    rows = _both(spark, sf_dir).select("project_id", op.compared(c("units"), c("b_units")).alias("units"), "address", zip_code.alias("zip"), F.date_add(F.lit("1999-01-01").cast("date"), (c("project_id") % 900).cast("int")).alias("seen"))
    rows = rows.filter(c("zip").isin("90001", "90005", "90011", "90021") & c("seen").between("1999-03-01", "2000-12-31"))
    order = [F.when(c("units") == "match", 1).otherwise(0).asc(), c("address").asc_nulls_last(), c("project_id").asc()]
    return numbered(rows, ["zip"], order, "place").select("project_id", "units", c("place").cast("int").alias("place"))


@query(
    """WITH o AS (SELECT project_id, field FROM override WHERE NOT cleared), e AS (SELECT DISTINCT project_id FROM fielded WHERE NOT superseded AND developer IS NOT NULL)
       SELECT p.project_id, CASE WHEN o.project_id IS NOT NULL THEN 'override' WHEN e.project_id IS NOT NULL THEN 'evidence' WHEN p.project_id % 2 = 0 THEN 'seed' ELSE 'unknown' END AS provenance
       FROM project p LEFT JOIN o ON o.project_id = p.project_id AND o.field = 'developer' LEFT JOIN e ON e.project_id = p.project_id""",
    "project", "override", "fielded",
)
def field_provenance(spark, sf_dir):
    """Where a project's developer comes from: an override, evidence, or its class's default."""
    project, overrides, evidence = views(spark, sf_dir, "project", "override", "fielded")
    held = overrides.filter("NOT cleared AND field = 'developer'").select("project_id", F.lit(True).alias("o"))
    seen = evidence.filter("NOT superseded AND developer IS NOT NULL").select("project_id", F.lit(True).alias("e")).distinct()
    rows = project.select("project_id").join(held, "project_id", "left").join(seen, "project_id", "left")
    return rows.select("project_id", F.when(F.col("o"), "override").when(F.col("e"), "evidence").when(F.col("project_id") % 2 == 0, "seed").otherwise("unknown").alias("provenance"))


@query(
    """SELECT item_id, concat(CASE item_type WHEN 'field_change' THEN 'Field change' WHEN 'new_candidate' THEN 'New project candidate' WHEN 'possible_match' THEN 'Possible match' ELSE 'Status regression' END, ': ', CASE WHEN item_id % 3 = 0 THEN 'units' ELSE 'project' END, ' of ', CAST(project_id AS VARCHAR)) AS summary FROM review_item""",
    "review_item",
)
def human_summaries(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    return items.select("item_id", op.summary(F.col("item_type"), F.when(F.col("item_id") % 3 == 0, "units"), F.col("project_id"), F.lit(" ")).alias("summary"))


@query(
    """SELECT evidence_id, concat(CASE source_type WHEN 'city_permit' THEN 'Permit' WHEN 'news_article' THEN 'Article' ELSE 'Vendor' END, ' units: ', CAST(units AS VARCHAR), CASE WHEN evidence_date IS NULL THEN '' ELSE concat(' (', CAST(evidence_date AS VARCHAR), ')') END) AS snippet FROM fielded""",
    "fielded",
)
def evidence_snippets(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "fielded")
    return evidence.select("evidence_id", op.snippet(F.col("source_type"), F.lit("units"), F.col("units").cast("string"), F.col("evidence_date")).alias("snippet"))


@query(
    """WITH r AS (SELECT source_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY source_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM activity), t AS (SELECT * FROM r WHERE n <= 10),
       s AS (SELECT source_id, CAST(coalesce(min(CASE WHEN NOT failed THEN n END) - 1, max(n)) AS INT) AS streak FROM t GROUP BY source_id)
       SELECT source_id, streak, CASE WHEN streak >= 3 THEN 'pause' WHEN streak > 0 THEN 'alert' ELSE 'none' END AS action FROM s""",
    "activity",
)
def failure_policy(spark, sf_dir):
    (runs,) = views(spark, sf_dir, "activity")
    return op.failing_sources(runs, "source_id", "occurred_at", "event_id", F.col("event_type") == "error")


@query(
    """WITH i AS (SELECT 'permit' AS kind, record_id AS value, project_id, evidence_id AS loaded FROM fielded), o AS (SELECT 'permit' AS kind, concat('R', CAST(project_id AS VARCHAR)) AS value FROM project WHERE project_id % 3 = 0)
       SELECT kind, value, project_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY loaded, project_id) AS r FROM i ANTI JOIN o USING (kind, value)) WHERE r = 1""",
    "fielded", "project",
)
def identifiers_first_owner(spark, sf_dir):
    evidence, project = views(spark, sf_dir, "fielded", "project")
    brought = evidence.select(F.lit("permit").alias("kind"), F.col("record_id").alias("value"), "project_id", F.col("evidence_id").alias("loaded"))
    owned = project.filter("project_id % 3 = 0").select(F.lit("permit").alias("kind"), F.concat(F.lit("R"), F.col("project_id").cast("string")).alias("value"))
    return op.first_owners(brought, owned)


@query("SELECT project_id, string_agg(concat(field, '=', value), ',' ORDER BY field) AS active FROM override WHERE NOT cleared GROUP BY project_id", "override")
def active_overrides(spark, sf_dir):
    (overrides,) = views(spark, sf_dir, "override")
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return overrides.filter("NOT cleared").groupBy("project_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["field"], F.lit("="), e["value"])), ",").alias("active"))


_INCOMING = "SELECT project_id, CASE WHEN project_id % 2 = 0 THEN field ELSE 'delivery' END AS field, concat('new ', value) AS value, CASE WHEN project_id % 5 = 0 THEN 'editor' END AS owner FROM override WHERE project_id % 4 <> 1"


@query(
    f"""WITH a AS (SELECT project_id, field, value, 'owner' AS owner FROM override WHERE NOT cleared), b AS ({_INCOMING})
       SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.field, b.field) AS field, CASE WHEN b.project_id IS NULL THEN a.value ELSE b.value END AS value, coalesce(b.owner, a.owner) AS owner,
         CASE WHEN b.project_id IS NULL THEN 'keep' WHEN a.project_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM a FULL OUTER JOIN b ON a.project_id = b.project_id AND a.field = b.field""",
    "override",
)
def override_upsert(spark, sf_dir):
    (overrides,) = views(spark, sf_dir, "override")
    p = F.col("project_id")
    incoming = overrides.filter("project_id % 4 <> 1").select("project_id", F.when(p % 2 == 0, F.col("field")).otherwise("delivery").alias("field"), F.concat(F.lit("new "), F.col("value")).alias("value"), F.when(p % 5 == 0, "editor").alias("owner"))
    return op.upserted_overrides(overrides.withColumn("owner", F.lit("owner")), incoming)


@query("SELECT project_id, field, cleared OR field = 'units' AS cleared, CASE WHEN NOT cleared AND field = 'units' THEN 'editor' END AS cleared_by FROM override", "override")
def override_clear(spark, sf_dir):
    (overrides,) = views(spark, sf_dir, "override")
    return op.cleared_overrides(overrides, ["units"], "editor")


@query(
    """SELECT evidence_id, abs(e.units - TRY_CAST(o.value AS INT)) > 5 AND (o.mode <> 'keep') AND (evidence_date > base_date OR (evidence_date = base_date AND tier < base_tier)) AS reopens
       FROM (SELECT * FROM fielded WHERE evidence_date IS NOT NULL AND NOT superseded) e JOIN (SELECT * FROM override WHERE NOT cleared AND field = 'units') o USING (project_id)""",
    "fielded", "override",
)
def override_reopen(spark, sf_dir):
    """Whether an evidence row contradicts an unprotected override and is newer than what it was set on."""
    evidence, overrides = views(spark, sf_dir, "fielded", "override")
    held = overrides.filter("NOT cleared AND field = 'units'").select("project_id", "value", "mode", "base_date", "base_tier")
    rows = evidence.filter("evidence_date IS NOT NULL AND NOT superseded").join(held, "project_id")
    speaks = resolution_op.contradicts(F.lit("total_units"), F.col("value"), F.col("units").cast("string"))
    return rows.select("evidence_id", (speaks & (F.col("mode") != "keep") & fields_op.newer(F.col("evidence_date"), F.col("tier"), F.col("base_date"), F.col("base_tier"))).alias("reopens"))


@query(
    """SELECT item_id, project_id, CASE WHEN item_type = 'new_candidate' THEN CASE decision_type WHEN 'accept_new' THEN 'create_project' WHEN 'keep_old' THEN 'reject' ELSE 'link_project' END WHEN decision_type = 'defer' THEN 'defer' WHEN decision_type <> 'accept_new' THEN 'write_override'
         WHEN item_type = 'override_contradiction' THEN 'clear_override' ELSE 'accept' END AS effect, CASE WHEN decision_type = 'defer' THEN 'open' ELSE 'committed' END AS state FROM decision WHERE state = 'staged'""",
    "decision",
)
def commit_staged_decisions(spark, sf_dir):
    (decisions,) = views(spark, sf_dir, "decision")
    return op.applied_decisions(decisions)


@query(
    """SELECT count(*) FILTER (WHERE state = 'staged' AND decision_type <> 'defer') AS decisions, count(DISTINCT CASE WHEN state = 'staged' THEN project_id END) AS projects, count(DISTINCT CASE WHEN state = 'staged' THEN jurisdiction_id END) AS jurisdictions,
         count(*) FILTER (WHERE state = 'open') AS remaining, count(*) FILTER (WHERE state = 'staged' AND decision_type = 'defer') AS deferred FROM decision""",
    "decision",
)
def commit_dry_run(spark, sf_dir):
    """What a commit would do, and what stays open or deferred."""
    (decisions,) = views(spark, sf_dir, "decision")
    staged, deferred = F.col("state") == "staged", F.col("decision_type") == "defer"
    return decisions.agg(
        F.count_if(staged & ~deferred).alias("decisions"), F.count_distinct(F.when(staged, F.col("project_id"))).alias("projects"), F.count_distinct(F.when(staged, F.col("jurisdiction_id"))).alias("jurisdictions"),
        F.count_if(F.col("state") == "open").alias("remaining"), F.count_if(staged & deferred).alias("deferred"),
    )


@query("SELECT jurisdiction_id, count(*) FILTER (WHERE decision_type = 'defer') AS deferred, count(*) FILTER (WHERE state = 'open') AS open FROM decision GROUP BY jurisdiction_id", "decision")
def deferred_and_open_counts(spark, sf_dir):
    (decisions,) = views(spark, sf_dir, "decision")
    return decisions.groupBy("jurisdiction_id").agg(F.count_if(F.col("decision_type") == "defer").alias("deferred"), F.count_if(F.col("state") == "open").alias("open"))


@query("SELECT item_id, coalesce(field_column, json_extract_string(payload, '$.field_name'), json_extract_string(payload, '$.changes[0].field')) AS field FROM decision", "decision")
def decision_fields(spark, sf_dir):
    (decisions,) = views(spark, sf_dir, "decision")
    return decisions.select("item_id", op.decision_field(F.col("field_column"), F.col("payload")).alias("field"))


@query("SELECT item_id, coalesce(json_extract_string(payload, '$.current_override.value'), json_extract_string(payload, '$.current_value'), json_extract_string(payload, '$.changes[0].old')) AS kept FROM decision", "decision")
def kept_old_values(spark, sf_dir):
    (decisions,) = views(spark, sf_dir, "decision")
    return decisions.select("item_id", op.kept_value(F.col("payload")).alias("kept"))


@query(
    """SELECT item_id, CASE WHEN state = 'open' AND item_type = 'field_change' THEN 'invalidated' ELSE state END AS state, CASE WHEN state = 'open' AND item_type = 'field_change' THEN 'superseded' END AS reason FROM decision""",
    "decision",
)
def card_invalidation(spark, sf_dir):
    (decisions,) = views(spark, sf_dir, "decision")
    ends = (F.col("state") == "open") & (F.col("item_type") == "field_change")
    return decisions.select("item_id", F.when(ends, "invalidated").otherwise(F.col("state")).alias("state"), F.when(ends, "superseded").alias("reason"))


@query(
    """WITH v AS (SELECT project_id, CASE WHEN project_id % 4 = 0 THEN '' WHEN project_id % 4 = 1 THEN NULL ELSE developer END AS a, CASE WHEN project_id % 6 = 0 THEN NULL WHEN project_id % 6 = 3 THEN upper(developer) ELSE developer END AS b FROM project)
       SELECT project_id, CASE WHEN nullif(a, '') IS NOT DISTINCT FROM nullif(b, '') THEN 'unchanged' WHEN nullif(a, '') IS NULL THEN 'null_to_value' WHEN nullif(b, '') IS NULL THEN 'value_to_null' ELSE 'value_changed' END AS shape FROM v""",
    "project",
)
def delta_shapes(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p, d = F.col("project_id"), F.col("developer")
    return project.select("project_id", resolution_op.delta_shape(F.when(p % 4 == 0, "").when(p % 4 != 1, d), F.when(p % 6 == 3, F.upper(d)).when(p % 6 != 0, d)).alias("shape"))


@query("SELECT project_id, units FROM project ORDER BY sha256(concat('7:', CAST(project_id AS VARCHAR))), project_id LIMIT 25", "project")
def delivery_spot_check(spark, sf_dir):
    """Twenty-five projects for a check by hand: a sample is the feature."""
    (project,) = views(spark, sf_dir, "project")
    return op.sampled(project.select("project_id", "units"), "project_id", 25, 7)


@query(
    """WITH g AS (SELECT project_id, p.status_rank AS current_rank, e.status_rank AS proposed_rank, count(*) AS n, min(evidence_id) AS first_evidence FROM fielded e JOIN project p USING (project_id) WHERE NOT superseded AND e.status_rank < p.status_rank AND source_type = 'news_article' GROUP BY ALL)
       SELECT * FROM g ANTI JOIN (SELECT project_id FROM review_item WHERE state = 'open' AND item_type = 'status_regression') USING (project_id)""",
    "fielded", "project", "review_item",
)
def regression_review_upsert(spark, sf_dir):
    """One card for each project's (current, proposed) statuses, unless the project has an open one."""
    evidence, project, items = views(spark, sf_dir, "fielded", "project", "review_item")
    rows = evidence.filter("NOT superseded AND source_type = 'news_article'").join(project.select("project_id", F.col("status_rank").alias("current_rank")), "project_id").filter("status_rank < current_rank")
    groups = rows.groupBy("project_id", "current_rank", F.col("status_rank").alias("proposed_rank")).agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("first_evidence"))
    return groups.join(items.filter("state = 'open' AND item_type = 'status_regression'").select("project_id"), "project_id", "left_anti")


@query(
    """WITH c AS (SELECT CAST(project_id % 3 AS INT) + 1 AS layer, project_id, CASE WHEN project_id % 4 = 0 THEN NULL ELSE units END AS units, price AS likelihood, market_id, jurisdiction_id FROM project)
       SELECT project_id, CAST(row_number() OVER (PARTITION BY market_id, jurisdiction_id ORDER BY layer, units DESC NULLS LAST, likelihood DESC, project_id) AS INT) AS place FROM c""",
    "project",
)
def candidate_order(spark, sf_dir):
    """Candidates of a market and jurisdiction by layer, a chosen field (nulls last), likelihood and id."""
    (project,) = views(spark, sf_dir, "project")
    rows = project.select("project_id", "market_id", "jurisdiction_id", ((F.col("project_id") % 3).cast("int") + 1).alias("layer"), F.when(F.col("project_id") % 4 != 0, F.col("units")).alias("units"), "price")
    order = [F.asc("layer"), F.col("units").desc_nulls_last(), F.desc("price"), F.asc("project_id")]
    return numbered(rows, ["market_id", "jurisdiction_id"], order, "place").select("project_id", F.col("place").cast("int").alias("place"))


@query(
    """WITH d AS (SELECT item_id, project_id, decided_at, decision_type, jurisdiction_id FROM decision WHERE state = 'committed')
       SELECT item_id, CAST(row_number() OVER (PARTITION BY jurisdiction_id ORDER BY decided_at DESC, item_id) AS INT) AS newest, CAST(row_number() OVER (PARTITION BY jurisdiction_id ORDER BY decided_at, item_id) AS INT) AS oldest, CAST(row_number() OVER (PARTITION BY jurisdiction_id ORDER BY decision_type, decided_at DESC, item_id) AS INT) AS by_decider, CAST(row_number() OVER (PARTITION BY jurisdiction_id ORDER BY project_id, decided_at DESC, item_id) AS INT) AS by_project FROM d""",
    "decision",
)
def reviewed_orders(spark, sf_dir):
    """Each jurisdiction's reviewed items in each of the four orders offered."""
    (decisions,) = views(spark, sf_dir, "decision")
    rows = decisions.filter("state = 'committed'")
    rows, newest, item = rows.select("item_id", "project_id", "decided_at", "decision_type", "jurisdiction_id"), F.desc("decided_at"), F.asc("item_id")
    orders = {"newest": [newest, item], "oldest": [F.asc("decided_at"), item], "by_decider": [F.asc("decision_type"), newest, item], "by_project": [F.asc("project_id"), newest, item]}
    for name, order in orders.items():
        rows = numbered(rows, ["jurisdiction_id"], order, name)
    return rows.select("item_id", *[F.col(name).cast("int").alias(name) for name in orders])


@query(
    """WITH e AS (SELECT project_id, evidence_id, row_number() OVER (PARTITION BY project_id ORDER BY evidence_id) AS r FROM fielded WHERE source_type = 'vendor_a'), o AS (SELECT project_id, unnest([project_id * 10, project_id * 10 + 1]) AS id, unnest([1, 2]) AS r FROM project)
       SELECT project_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k, r) AS ids FROM (SELECT project_id, id, min(k) AS k, min(r) AS r FROM (SELECT project_id, id, 0 AS k, r FROM o UNION ALL SELECT project_id, evidence_id, 1, r FROM e WHERE r <= 3) GROUP BY project_id, id) GROUP BY project_id""",
    "fielded", "project",
)
def evidence_id_merge(spark, sf_dir):
    """The ids that a card has, then those of new evidence (its first three of a source), each once, in order."""
    evidence, project = views(spark, sf_dir, "fielded", "project")
    few = evidence.filter("source_type = 'vendor_a'").withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("evidence_id"))).filter("r <= 3")
    fresh = few.groupBy("project_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("fresh"))
    held = F.array(F.col("project_id") * 10, F.col("project_id") * 10 + 1)
    rows = project.select("project_id", held.alias("held")).join(fresh, "project_id", "left")
    merged = F.array_distinct(F.concat("held", F.coalesce("fresh", F.array().cast("array<bigint>"))))
    return rows.select("project_id", F.array_join(merged.cast("array<string>"), ",").alias("ids"))
