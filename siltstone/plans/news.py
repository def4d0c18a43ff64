"""Queries on references of articles, runs and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.model import views
from siltstone.operators import extraction as extraction_op
from siltstone.operators import news as op
from siltstone.operators import pipelines
from siltstone.registry import query
from siltstone.session import table


@query("SELECT article_id, count(*) AS n, min(reference_id) AS first_reference FROM reference WHERE extraction_id = current_extraction_id GROUP BY article_id", "reference")
def current_references(spark, sf_dir):
    (refs,) = views(spark, sf_dir, "reference")
    return op.current_references(refs).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.min("reference_id").alias("first_reference"))


@query("SELECT reference_id, CASE WHEN extraction_id <> current_extraction_id AND match_status NOT IN ('confirmed', 'discarded') THEN 'superseded' ELSE match_status END AS status FROM reference", "reference")
def superseded_references(spark, sf_dir):
    (refs,) = views(spark, sf_dir, "reference")
    return op.superseded_references(refs)


_SCOPED = "r AS (SELECT project_id AS reference_id, CASE WHEN project_id % 200 <> 0 THEN market_id END AS market_id FROM project WHERE project_id % 100 = 0)"


@query(f"WITH {_SCOPED} SELECT reference_id, count(*) AS n FROM r JOIN project p ON r.market_id IS NULL OR r.market_id = p.market_id GROUP BY reference_id", "project")
def article_scope(spark, sf_dir):
    """How many projects each of a set of articles may name: of its market, or all for one of none."""
    (project,) = views(spark, sf_dir, "project")
    refs = project.filter("project_id % 100 = 0").select(F.col("project_id").alias("reference_id"), F.when(F.col("project_id") % 200 != 0, F.col("market_id")).alias("market_id"))
    return op.scope_sizes(refs, project.filter("market_id IS NOT NULL"))


_NAMED = """r AS (SELECT project_id + 1000000 AS reference_id, market_id, CASE project_id % 4 WHEN 0 THEN NULL WHEN 1 THEN regexp_replace(address, ' [0-9]{5}$', '') ELSE address END AS address, CASE WHEN project_id % 3 = 0 THEN upper(name) ELSE 'other' END AS name,
  CASE WHEN project_id % 5 < 3 THEN developer END AS developer, units + CAST(project_id % 20 AS INT) AS units, CASE project_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence FROM project),
  eq AS (SELECT r.*, p.project_id, p.name AS n, p.developer AS d, p.units AS u, 0.50 AS base FROM r JOIN project p ON p.market_id = r.market_id AND p.address = r.address),
  tol AS (SELECT r.*, p.project_id, p.name AS n, p.developer AS d, p.units AS u, 0.40 AS base FROM r JOIN project p ON p.market_id = r.market_id AND regexp_replace(p.address, ' [0-9]{5}$', '') = r.address AND p.address <> r.address WHERE NOT regexp_matches(r.address, ' [0-9]{5}$') AND r.reference_id NOT IN (SELECT reference_id FROM eq)),
  sc AS (SELECT reference_id, project_id, CAST(round(base + CASE WHEN lower(name) = lower(n) THEN 0.15 ELSE 0 END + CASE WHEN lower(developer) = lower(d) THEN 0.20 ELSE 0 END + CASE WHEN abs(units - u) / nullif(greatest(units, u), 0) <= 0.25 THEN 0.05 ELSE 0 END, 6) AS DOUBLE) AS score FROM (SELECT * FROM eq UNION ALL SELECT * FROM tol)),
  tp AS (SELECT *, max(score) OVER (PARTITION BY reference_id) AS top, row_number() OVER (PARTITION BY reference_id ORDER BY score DESC, project_id) AS k FROM sc),
  composite AS (SELECT reference_id, CASE WHEN max(score) >= 0.75 AND count(*) FILTER (WHERE score = top) = 1 THEN 'confirmed' ELSE 'possible' END AS status, min(CASE WHEN k = 1 THEN project_id END) AS best, max(score) AS score, count(*) AS candidates FROM tp GROUP BY reference_id)"""


def _named(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    refs = project.select(
        (p + 1000000).alias("reference_id"), "market_id", F.when(p % 4 == 1, F.regexp_replace("address", " [0-9]{5}$", "")).when(p % 4 != 0, F.col("address")).alias("address"), F.when(p % 3 == 0, F.upper("name")).otherwise("other").alias("name"),
        F.when(p % 5 < 3, F.col("developer")).alias("developer"), (F.col("units") + (p % 20).cast("int")).alias("units"), F.when(p % 3 == 0, "high").when(p % 3 == 1, "low").otherwise("medium").alias("confidence"),
    )
    return refs, project


@query(f"WITH {_NAMED} SELECT reference_id, status, CASE WHEN status = 'confirmed' THEN best END AS project_id, score, candidates FROM composite", "project")
def address_composite(spark, sf_dir):
    return op.address_composite(*_named(spark, sf_dir))


@query(
    f"""WITH {_NAMED}, idn AS (SELECT reference_id, 'confirmed' AS status, reference_id - 1000000 AS project_id, 0.97::DOUBLE AS score FROM r WHERE reference_id % 10 = 0), hint AS (SELECT reference_id, 'confirmed' AS status, reference_id - 1000000 AS project_id, 0.96::DOUBLE AS score FROM r WHERE reference_id % 7 = 0),
       j AS (SELECT r.*, i.status AS s1, i.project_id AS p1, i.score AS c1, h.status AS s2, h.project_id AS p2, h.score AS c2, c.status AS s3, CASE WHEN c.status = 'confirmed' THEN best END AS p3, c.score AS c3, (address IS NOT NULL OR (developer IS NOT NULL AND units > 0)) AND confidence IN ('high', 'medium') AND units >= 10 AS strong
             FROM r LEFT JOIN idn i USING (reference_id) LEFT JOIN hint h USING (reference_id) LEFT JOIN composite c USING (reference_id))
       SELECT reference_id, CASE WHEN s1 IS NOT NULL THEN 'identifier' WHEN s2 IS NOT NULL THEN 'hint' WHEN s3 IS NOT NULL THEN 'address' WHEN strong THEN 'new_candidate' ELSE 'discarded' END AS step, coalesce(s1, s2, s3, CASE WHEN strong THEN 'new_candidate' ELSE 'discarded' END) AS status,
         CASE WHEN s1 IS NOT NULL THEN p1 WHEN s2 IS NOT NULL THEN p2 ELSE p3 END AS project_id, coalesce(c1, c2, c3) AS score FROM j""",
    "project",
)
def article_ladder(spark, sf_dir):
    """Identifier, registry hint, address composite; then new candidates and what is discarded."""
    refs, project = _named(spark, sf_dir)
    stated = lambda n, score: refs.filter(F.col("reference_id") % n == 0).select("reference_id", F.lit("confirmed").alias("status"), (F.col("reference_id") - 1000000).alias("project_id"), F.lit(score).alias("score"))
    strong = (F.col("address").isNotNull() | (F.col("developer").isNotNull() & (F.col("units") > 0))) & F.col("confidence").isin("high", "medium") & (F.col("units") >= 10)
    return op.ladder(refs, [("identifier", stated(10, 0.97)), ("hint", stated(7, 0.96)), ("address", op.address_composite(refs, project))], F.coalesce(strong, F.lit(False)))


@query(
    """SELECT reference_id, array_to_string(list_filter([CASE WHEN developer IS NOT NULL THEN concat('developer=', developer, '/', coalesce(confidence, '')) END, CASE WHEN units IS NOT NULL THEN concat('total_units=', CAST(units AS VARCHAR), '/', coalesce(confidence, '')) END], lambda x: x IS NOT NULL), ';') AS fields FROM reference""",
    "reference",
)
def news_extracted_fields(spark, sf_dir):
    (refs,) = views(spark, sf_dir, "reference")
    found = op.extracted_fields({"developer": F.col("developer"), "total_units": F.col("units")}, F.col("confidence"))
    line = F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("/"), F.coalesce(e["value"]["confidence"], F.lit(""))))
    return refs.select("reference_id", F.array_join(line, ";").alias("fields"))


_RAW = """SELECT evidence_id, project_id, concat(chr(123), '"article_id":', CAST(evidence_id % 500 AS VARCHAR(20)), ',"apn":"', CAST(evidence_id % 300 AS VARCHAR(20)), '"', chr(125)) AS raw, concat(chr(123), '"apn":', chr(123), '"value":"', CAST(evidence_id % 70 AS VARCHAR(20)), '"', chr(125), chr(125)) AS extracted FROM fielded"""


def _raw(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "fielded")
    text = lambda n: (F.col("evidence_id") % n).cast("string")
    raw = F.concat(F.lit('{"article_id":'), text(500), F.lit(',"apn":"'), text(300), F.lit('"}'))
    return evidence.select("evidence_id", "project_id", "evidence_date", "source_type", raw.alias("raw"), F.concat(F.lit('{"apn":{"value":"'), text(70), F.lit('"}}')).alias("extracted"))


@query("SELECT evidence_id, evidence_id % 500 AS article_id FROM fielded WHERE evidence_id % 500 IN (SELECT article_id FROM reference) AND evidence_id % 3 <> 0", "fielded", "reference")
def stale_article_evidence(spark, sf_dir):
    """Evidence of articles by a path of its raw JSON, without what the current extraction wrote."""
    (refs,) = views(spark, sf_dir, "reference")
    rows = _raw(spark, sf_dir)
    return op.stale_evidence(rows, refs, rows.filter("evidence_id % 3 = 0"))


@query("SELECT DISTINCT project_id FROM fielded WHERE CAST(evidence_id % 300 AS VARCHAR) IN ('17', '0017') OR CAST(evidence_id % 70 AS VARCHAR) IN ('17', '0017')", "fielded")
def parcel_projects(spark, sf_dir):
    """Projects of one parcel, in either spelling, by raw or extracted JSON."""
    return op.parcel_projects(_raw(spark, sf_dir), ["17", "0017"])


@query(
    """SELECT evidence_id, CAST(r AS INT) AS place FROM (SELECT evidence_id, row_number() OVER (ORDER BY evidence_date DESC NULLS LAST, evidence_id DESC) AS r FROM fielded WHERE source_type = 'city_permit' AND CAST(evidence_id % 300 AS VARCHAR) = '17') WHERE r <= 20""",
    "fielded",
)
def permits_for_parcel(spark, sf_dir):
    """The twenty newest permits of a parcel: a stated limit of the report."""
    hit = F.try_variant_get(F.try_parse_json("raw"), "$.apn", "string") == "17"
    rows = _raw(spark, sf_dir).filter((F.col("source_type") == "city_permit") & hit).orderBy(F.col("evidence_date").desc_nulls_last(), F.desc("evidence_id")).limit(20)
    return rows.agg(F.collect_list("evidence_id").alias("ids")).select(F.posexplode("ids").alias("place", "evidence_id")).select("evidence_id", (F.col("place") + 1).alias("place"))


@query("SELECT article_id, 'townhome' AS stated, 'senior' AS age, CAST(20 + article_id % 900 AS VARCHAR) AS units FROM article", "article")
def structural_disagreement_values(spark, sf_dir):
    """Per article the first signal of each extractor that a field is compared with."""
    (articles,) = views(spark, sf_dir, "article")
    wanted = F.col("extractor").isin("product_type_phrase", "age_restriction_phrase", "unit_count")
    found = extraction_op.signals(articles, "article_id", "body").groupBy("article_id").agg(F.array_sort(F.collect_list(F.when(wanted, F.struct("start", "extractor", "canonical")))).alias("s"))
    first = lambda *names: op.first_signal(F.col("s"), list(names))
    return found.select("article_id", first("product_type_phrase").alias("stated"), first("age_restriction_phrase").alias("age"), first("unit_count").alias("units"))


@query("SELECT project_id, max(CASE WHEN delivery <> 'soon' THEN delivery END) AS last_date FROM fielded GROUP BY project_id", "fielded")
def latest_iso_date(spark, sf_dir):
    """The greatest ISO date among a project's texts; others do not count."""
    (evidence,) = views(spark, sf_dir, "fielded")
    return evidence.groupBy("project_id").agg(F.max(F.try_to_date("delivery", "yyyy-MM-dd")).cast("string").alias("last_date"))


@query("SELECT source_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT day) AS days FROM activity GROUP BY source_id", "activity")
def run_link_counts(spark, sf_dir):
    (runs,) = views(spark, sf_dir, "activity")
    return runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("day").alias("days"))


@query(
    """SELECT confidence, count(*) AS n, count(*) FILTER (WHERE match_status = 'confirmed') AS confirmed, round(avg(score), 6) AS mean_score, round(count(*) FILTER (WHERE match_status = 'confirmed') / count(*), 6) AS rate FROM reference GROUP BY confidence""",
    "reference",
)
def harness_summary(spark, sf_dir):
    """Counts, means and rates of a comparison's results by group."""
    (refs,) = views(spark, sf_dir, "reference")
    good = F.count_if(F.col("match_status") == "confirmed")
    return refs.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), good.alias("confirmed"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.try_divide(good, F.count(F.lit(1))), 6).alias("rate"))


@query(
    """SELECT project_id, kind, value FROM (SELECT o_custkey AS project_id, substring(o_orderpriority, 1, 1) AS kind, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey, substring(o_orderpriority, 1, 1) ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def latest_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.substring("o_orderpriority", 1, 1).alias("kind"), F.col("o_orderkey").alias("value"), "o_orderdate")
    return extraction_op.latest_per_kind(notes, ["project_id", "kind"], [F.desc("o_orderdate"), F.desc("value")]).select("project_id", "kind", "value")


@query(
    """WITH r AS (SELECT e.project_id, count(*) FILTER (WHERE e.units <> p.units) AS changed FROM fielded e JOIN project p USING (project_id) WHERE NOT superseded GROUP BY e.project_id) SELECT CASE WHEN changed = 0 THEN 'unchanged' WHEN changed < 20 THEN 'few' ELSE 'many' END AS class, count(*) AS projects, CAST(sum(changed) AS BIGINT) AS changes FROM r GROUP BY 1""",
    "fielded", "project",
)
def resolve_all_counters(spark, sf_dir):
    """How many projects a run over all of them would change, and in how many rows."""
    evidence, project = views(spark, sf_dir, "fielded", "project")
    rows = evidence.filter("NOT superseded").select("project_id", F.col("units").alias("u")).join(project.select("project_id", "units"), "project_id")
    changed = rows.groupBy("project_id").agg(F.count_if(F.col("u") != F.col("units")).alias("changed"))
    kind = F.when(F.col("changed") == 0, "unchanged").when(F.col("changed") < 20, "few").otherwise("many")
    return changed.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("projects"), F.sum("changed").alias("changes"))


@query(
    f"""WITH {_NAMED}, cur AS (SELECT *, reference_id % 300 AS article_id, reference_id % 4 AS hash FROM r WHERE reference_id % 5 = 0 OR reference_id % 2 = 1),
       j AS (SELECT cur.*, c.status AS s, CASE WHEN c.status = 'confirmed' THEN best END AS p, CASE WHEN developer IS NOT NULL AND units >= 10 THEN 'new_candidate' ELSE 'discarded' END AS rest FROM cur LEFT JOIN composite c USING (reference_id)),
       k AS (SELECT reference_id % 300 AS article_id, reference_id % 4 AS hash, max(CASE WHEN reference_id % 16 <> 0 THEN reference_id - 1000000 END) AS owner FROM r WHERE reference_id % 8 = 0 GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY article_id, hash, p ORDER BY reference_id) AS nth FROM j WHERE s = 'confirmed'),
       w AS (SELECT n.reference_id, CASE WHEN nth > 1 THEN 'skip' WHEN k.article_id IS NULL THEN 'insert' WHEN owner IS NULL THEN 'link' ELSE 'skip' END AS action FROM n LEFT JOIN k USING (article_id, hash))
       SELECT reference_id, CASE WHEN s IS NOT NULL THEN 'address' ELSE rest END AS step, coalesce(s, rest) AS status, p AS project_id, action FROM j LEFT JOIN w USING (reference_id)""",
    "project",
)
def integrate_run(spark, sf_dir):
    """References of current extractions through match, evidence and review."""
    refs, project = _named(spark, sf_dir)
    k = F.col("reference_id")
    rows = refs.withColumns({"article_id": k % 300, "hash": k % 4, "extraction_id": (k % 2).cast("int"), "current_extraction_id": F.when(k % 5 != 0, 1)})
    existing = rows.filter("reference_id % 8 = 0").select(F.lit("news_article").alias("source_type"), F.col("article_id").cast("string").alias("record_id"), "hash", F.when(k % 16 != 0, k - 1000000).alias("project_id"))
    carded = project.select("project_id", F.lit("units").alias("field")).filter("project_id % 2 = 0")
    return pipelines.integrate(rows, project, existing, carded)[0]


@query(
    f"""WITH {_NAMED}, cur AS (SELECT * FROM r WHERE reference_id % 5 = 0 OR reference_id % 2 = 1) SELECT DISTINCT c.best AS project_id, 'units' AS field, cur.units AS proposed FROM cur JOIN composite c USING (reference_id) JOIN project p ON p.project_id = c.best WHERE status = 'confirmed' AND cur.units <> p.units AND c.best % 2 <> 0""",
    "project",
)
def integration_cards(spark, sf_dir):
    """Cards for what current references change on confirmed projects without an open card of the field."""
    refs, project = _named(spark, sf_dir)
    k = F.col("reference_id")
    rows = refs.withColumns({"article_id": k % 300, "hash": k % 4, "extraction_id": (k % 2).cast("int"), "current_extraction_id": F.when(k % 5 != 0, 1)})
    existing = rows.limit(0).select(F.lit("news_article").alias("source_type"), F.col("article_id").cast("string").alias("record_id"), "hash", k.alias("project_id"))
    return pipelines.integrate(rows, project, existing, project.filter("project_id % 2 = 0").select("project_id", F.lit("units").alias("field")))[1]


_APN = "concat(lpad(CAST({0} % 1500 AS VARCHAR(9)), 4, '0'), '{1}', '001{1}', lpad(CAST({0} % 3 AS VARCHAR(9)), 3, '0'))"
_STEPS = f"""{_NAMED}, cur AS (SELECT *, reference_id % 300 AS article_id, reference_id % 4 AS hash, developer AS dev FROM r WHERE reference_id % 5 = 0 OR reference_id % 2 = 1),
  own AS (SELECT project_id, {_APN.format("project_id", "")} AS v FROM project WHERE project_id % 3 <> 1),
  idn AS (SELECT reference_id, count(DISTINCT o.project_id) AS n, min(o.project_id) AS o FROM cur JOIN own o ON o.v = {_APN.format("(reference_id - 1000000)", "")} WHERE reference_id % 10 < 3 GROUP BY reference_id),
  hint AS (SELECT reference_id, reference_id - 1000000 AS o FROM cur WHERE reference_id % 14 = 0),
  j AS (SELECT cur.*, CASE WHEN i.n IS NOT NULL THEN 'identifier' WHEN h.o IS NOT NULL THEN 'hint' WHEN c.status IS NOT NULL THEN 'address' WHEN dev IS NOT NULL AND units >= 10 THEN 'new_candidate' ELSE 'discarded' END AS step,
      CASE WHEN i.n = 1 THEN 'confirmed' WHEN i.n > 1 THEN 'possible' WHEN h.o IS NOT NULL THEN 'confirmed' WHEN c.status IS NOT NULL THEN c.status WHEN dev IS NOT NULL AND units >= 10 THEN 'new_candidate' ELSE 'discarded' END AS status,
      CASE WHEN i.n = 1 THEN i.o WHEN i.n > 1 THEN NULL WHEN h.o IS NOT NULL THEN h.o WHEN c.status = 'confirmed' THEN c.best END AS p FROM cur LEFT JOIN idn i USING (reference_id) LEFT JOIN hint h USING (reference_id) LEFT JOIN composite c USING (reference_id))"""


def _integrated(spark, sf_dir):
    refs, project = _named(spark, sf_dir)
    k, p = F.col("reference_id"), F.col("reference_id") - 1000000
    apn = lambda c, gap: F.concat(F.lpad((c % 1500).cast("string"), 4, "0"), F.lit(f"{gap}001{gap}"), F.lpad((c % 3).cast("string"), 3, "0"))
    rows = refs.withColumns({"article_id": k % 300, "hash": k % 4, "extraction_id": (k % 2).cast("int"), "current_extraction_id": F.when(k % 5 != 0, 1)})
    identifiers = rows.filter(k % 10 < 3).select("reference_id", F.lit("apn").alias("kind"), apn(p, "-").alias("value"))
    owned = project.filter("project_id % 3 <> 1").select(F.lit("apn").alias("kind"), apn(F.col("project_id"), "").alias("value"), "project_id")
    hints = rows.filter(k % 7 == 0).select("reference_id", F.when(k % 14 == 0, p).otherwise(p + 1_000_000_000).alias("project_id"))
    existing = rows.filter("reference_id % 8 = 0").select(F.lit("news_article").alias("source_type"), F.col("article_id").cast("string").alias("record_id"), "hash", F.when(k % 16 != 0, p).alias("project_id"))
    carded = project.select("project_id", F.lit("units").alias("field")).filter("project_id % 2 = 0")
    return pipelines.integrate_current(rows, identifiers, owned, hints, project, existing, carded)


@query(
    f"""WITH {_STEPS}, k AS (SELECT reference_id % 300 AS article_id, reference_id % 4 AS hash, max(CASE WHEN reference_id % 16 <> 0 THEN reference_id - 1000000 END) AS owner FROM r WHERE reference_id % 8 = 0 GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY article_id, hash, p ORDER BY reference_id) AS nth FROM j WHERE status = 'confirmed'),
       w AS (SELECT n.reference_id, CASE WHEN nth > 1 THEN 'skip' WHEN k.article_id IS NULL THEN 'insert' WHEN owner IS NULL THEN 'link' ELSE 'skip' END AS action FROM n LEFT JOIN k USING (article_id, hash))
       SELECT reference_id, step, status, p AS project_id, action FROM j LEFT JOIN w USING (reference_id)""",
    "project",
)
def integrate_current(spark, sf_dir):
    """References of current extractions by their numbers, by the project that was named, and by address."""
    return _integrated(spark, sf_dir)[0]


@query(
    f"""WITH {_STEPS}, d AS (SELECT j.p AS project_id, j.units, p.units AS pu, dev, p.developer AS pd FROM j JOIN project p ON p.project_id = j.p WHERE status = 'confirmed')
       SELECT DISTINCT project_id, 'units' AS field, CAST(units AS VARCHAR) AS proposed FROM d WHERE units <> pu AND project_id % 2 <> 0 UNION SELECT DISTINCT project_id, 'developer', dev FROM d WHERE lower(trim(dev)) <> lower(trim(pd))""",
    "project",
)
def current_integration_cards(spark, sf_dir):
    """Cards for units and developers of confirmed projects that current references change."""
    return _integrated(spark, sf_dir)[1]
