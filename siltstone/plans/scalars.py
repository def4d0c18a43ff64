"""Queries that apply column functions to whole tables, and two whole runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siltstone.functions import dates, scores, text
from siltstone.model import views
from siltstone.operators import fields, filters, pipelines
from siltstone.operators import review as review_op
from siltstone.registry import query
from siltstone.session import table

_K = "CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(o_orderkey AS VARCHAR(20)), '.0') WHEN 1 THEN concat('1,', lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 3, '0'), '.5%') WHEN 2 THEN '--' WHEN 3 THEN ' 12-7 ' WHEN 4 THEN CAST(o_orderkey AS VARCHAR(20)) ELSE 'none' END"


@query(
    f"""WITH t AS (SELECT o_orderkey AS id, {_K} AS t FROM orders), c AS (SELECT id, t, CASE WHEN trim(t) <> '--' THEN trim(t) END AS c FROM t)
       SELECT id, TRY_CAST(regexp_replace(c, '[,%]', '', 'g') AS DOUBLE) AS number, CASE WHEN id % 6 = 3 THEN 7 WHEN id % 6 = 4 THEN id END AS low, CASE WHEN id % 6 = 3 THEN 12 WHEN id % 6 = 4 THEN id END AS high FROM c"""
)
def parsed_numbers(spark, sf_dir):
    """Numbers and house number ranges of untidy text."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_K).alias("t"))
    span = text.house_range(F.col("t"))
    return rows.select("id", text.parse_float(F.col("t")).alias("number"), span["low"].alias("low"), span["high"].alias("high"))


@query(
    """SELECT row_id, upper(concat(trim(regexp_replace(address, 'Main St', '')), ' NORTH FIFTH PLACE')) AS bad, concat(trim(regexp_replace(address, 'Main St', '')), ' NORTH 5TH STREET') AS street FROM feed""",
    "feed",
)
def loose_street_lines(spark, sf_dir):
    (feed,) = views(spark, sf_dir, "feed")
    number = F.trim(F.regexp_replace("address", "Main St", ""))
    return feed.select("row_id", F.upper(F.concat(number, F.lit(" north fifth place"))).alias("bad"), text.loose_street_line(F.concat(number, F.lit(" n. Fifth st"))).alias("street"))


@query(
    """SELECT row_id, CASE WHEN row_id % 4 = 0 THEN NULL ELSE lpad(CAST(row_id % 10000000 AS VARCHAR), 10, '1') END AS apn, CASE WHEN row_id % 3 <> 2 THEN concat(row_id % 50, '-', row_id, '-7') ELSE '' END AS permits, CASE WHEN row_id % 3 = 0 THEN 'exact' WHEN row_id % 3 = 1 THEN 'sub' ELSE 'other' END AS route FROM feed""",
    "feed",
)
def identifiers_and_hosts(spark, sf_dir):
    """Parcel digits, permit numbers in URLs, and which route a host takes."""
    (feed,) = views(spark, sf_dir, "feed")
    k = F.col("row_id")
    digits = F.lpad((k % 10000000).cast("string"), 10, "1")
    apn = text.parcel_digits(F.when(k % 4 == 0, F.lit("12-34")).otherwise(F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 3), F.lit(" "), F.substring(digits, 8, 3))))
    url = F.concat(F.lit("https://x.example/p?ID2="), k.cast("string"), F.lit("&id1="), (k % 50).cast("string"), F.lit("&id3=7"))
    urls = F.when(k % 3 != 2, F.array(url, url, F.lit("https://x.example/none?id1=4"))).otherwise(F.array(F.lit("https://x.example")))
    host = F.when(k % 3 == 0, "News.example").when(k % 3 == 1, "a.city.example").otherwise("city.example.org")
    route = F.when(text.host_matches(host, "news.example"), "exact").when(text.host_matches(host, "*.city.example"), "sub").otherwise("other")
    return feed.select("row_id", apn.alias("apn"), F.array_join(text.permit_ids_in_urls(urls), ",").alias("permits"), route.alias("route"))


@query(
    """SELECT item_id, CASE item_type WHEN 'new_candidate' THEN 'A new project' WHEN 'field_change' THEN 'Field Change' WHEN 'possible_match' THEN 'Possible Match' ELSE 'Status Regression' END AS label, concat_ws(',', priority, CASE WHEN state <> priority THEN state END, 'x') AS names FROM review_item""",
    "review_item",
)
def labels_and_lists(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    listed = text.ordered_distinct(F.array(F.col("priority"), F.lit(" "), F.col("state"), F.lit("x"), F.col("priority"), F.lit("x ")))
    return items.select("item_id", text.field_label(F.col("item_type"), {"new_candidate": "A new project"}).alias("label"), F.array_join(listed, ",").alias("names"))


@query(
    """SELECT row_id, CAST(coalesce(TRY_CAST(substr(issue_date, 1, 10) AS DATE), CAST(updated_at AS DATE)) AS VARCHAR) AS derived, CASE WHEN row_id % 3 = 0 THEN CAST(make_date(CAST(2000 + row_id % 20 AS INT), 3, 1) AS VARCHAR) END AS month,
         CAST(updated_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS within, CAST(make_date(2020, 5, 1 + CAST(row_id % 28 AS INT)) AS VARCHAR) AS mail FROM feed""",
    "feed",
)
def derived_dates(spark, sf_dir):
    """Dates from the first field that has one, months by name, a window of days, and mail dates."""
    (feed,) = views(spark, sf_dir, "feed")
    k = F.col("row_id")
    none = F.lit(None).cast("timestamp")
    derived = dates.derived_date([F.lit("soon"), F.col("issue_date")], F.col("updated_at").cast("timestamp"), none, none)
    month = dates.month_year(F.when(k % 3 == 0, F.concat(F.lit(" March "), (2000 + k % 20).cast("string"))).otherwise("the 3rd"))
    mail = dates.mail_or_iso(F.concat(F.lit("Fri, "), (1 + k % 28).cast("string"), F.lit(" May 2020 10:00:00 +0000")))
    within = dates.day_bounds(F.col("updated_at").cast("timestamp"), dt.date(1995, 1, 1), dt.date(1996, 12, 31))
    return feed.select("row_id", derived.cast("string").alias("derived"), month.cast("string").alias("month"), within.alias("within"), F.to_date(mail).cast("string").alias("mail"))


@query(
    """SELECT project_id, CASE WHEN units * 3 BETWEEN 0 AND 100 THEN round(units * 3 / 100.0, 6) END::DOUBLE AS share, NOT units * 3 BETWEEN 0 AND 100 AS issue, least(1.0, units / 30.0)::DOUBLE AS clamped, CAST(units * 1300 / 1000000.0 AS DECIMAL(18, 6)) AS usd,
         CASE WHEN project_id % 5 = 0 THEN 'none' WHEN project_id % 7 = 0 THEN 'low' WHEN project_id % 2 = 0 AND units >= 40 THEN 'high' WHEN units >= 25 THEN 'medium' ELSE 'low' END AS confidence FROM project""",
    "project",
)
def shares_costs_confidence(spark, sf_dir):
    """Bed shares, clamped scores, embedding costs and the confidence of geocodes."""
    (project,) = views(spark, sf_dir, "project")
    u, p = F.col("units"), F.col("project_id")
    share = scores.bed_share((u * 3).cast("double"))
    kind = F.when(p % 2 == 0, "rooftop").otherwise("range_interpolation")
    confidence = scores.geocode_confidence(kind, u / 50, p % 7 == 0, F.when(p % 5 != 0, F.col("lat")), F.col("lng"))
    return project.select("project_id", share["share"].alias("share"), share["issue"].alias("issue"), scores.clamped(u / 30).alias("clamped"), scores.token_cost([(u * 10000, "0.13")]).alias("usd"), confidence.alias("confidence"))


@query(
    """SELECT a.project_id, CASE WHEN a.units = b.units THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_units, a.units = b.units AS contributed, a.units IS NOT NULL AS searched FROM project a JOIN project b ON b.project_id = a.project_id + 3""",
    "project",
)
def signal_structs(spark, sf_dir):
    """A match signal with its score, whether it contributed and was searched, label and weight."""
    (project,) = views(spark, sf_dir, "project")
    both = project.select("project_id", "units").join(project.select((F.col("project_id") - 3).alias("project_id"), F.col("units").alias("v")), "project_id")
    s = scores.signal(F.when(F.col("units") == F.col("v"), 1.0).otherwise(0.0), F.col("units").isNotNull(), "Units", 0.10)
    return both.select("project_id", s["score"].alias("exact_units"), s["contributed"].alias("contributed"), s["searched"].alias("searched"))


@query(
    """SELECT reference_id, CASE WHEN developer IS NULL THEN '' WHEN reference_id % 3 = 0 THEN 'ein:4,permit:a|b' ELSE 'permit:a|b' END AS identifiers, CASE WHEN reference_id % 2 = 0 THEN reference_id % 50 ELSE 5 END AS "start", CASE WHEN reference_id % 2 = 0 THEN reference_id % 50 + 90 ELSE 9 END AS "end" FROM reference""",
    "reference",
)
def identifiers_and_spans(spark, sf_dir):
    """Identifier maps cleaned, and the span that a reference's excerpts cover, in either shape that they come in."""
    (refs,) = views(spark, sf_dir, "reference")
    k = F.col("reference_id")
    raw = F.when(F.col("developer").isNotNull(), F.create_map(F.lit("permit"), F.array(F.lit(" b "), F.lit("a"), F.lit("b"), F.lit("")), F.lit("ein"), F.when(k % 3 == 0, F.array(F.lit("4"))).otherwise(F.array(F.lit("  ")))))
    inner = F.when(k % 2 == 0, F.concat(F.lit('[{"start":'), (k % 50 + 7).cast("string"), F.lit(',"end":'), (k % 50 + 90).cast("string"), F.lit('},{"start":'), (k % 50).cast("string"), F.lit(',"end":'), (k % 50 + 20).cast("string"), F.lit("}]"))).otherwise('[{"start":5,"end":9}]')
    json = F.when(k % 3 == 0, inner).when(k % 3 == 1, F.concat(F.lit('{"excerpts":'), inner, F.lit("}"))).otherwise(F.concat(F.lit('{"items":'), inner, F.lit("}")))
    span = filters.excerpt_span(filters.excerpts(json))
    return refs.select("reference_id", filters.identifier_line(filters.clean_identifiers(raw)).alias("identifiers"), span["start"].alias("start"), span["end"].alias("end"))


@query(
    """SELECT evidence_id, f.field, CASE f.field WHEN 'stories' THEN trim(stories) ELSE trim(developer) END AS comparable FROM fielded, (SELECT unnest(['stories', 'developer']) AS field) f WHERE trim(CASE f.field WHEN 'stories' THEN stories ELSE developer END) <> ''""",
    "fielded",
)
def field_observations(spark, sf_dir):
    """One row for each meaningful value of a field, as comparable text."""
    (evidence,) = views(spark, sf_dir, "fielded")
    each = F.array(*[F.when(fields.meaningful(F.col(f)), F.struct(F.lit(f).alias("field"), F.trim(f).alias("comparable"))) for f in ("stories", "developer")])
    return evidence.select("evidence_id", F.inline(F.array_compact(each)))


@query(
    """SELECT evidence_id, CASE WHEN units % 3 = 0 THEN 'A' || CAST(units AS VARCHAR) WHEN units % 3 = 1 THEN 'B' || CAST(units AS VARCHAR) ELSE record_id END AS permit FROM fielded WHERE source_type = 'city_permit'""",
    "fielded",
)
def permit_number_from_evidence(spark, sf_dir):
    """The first of a permit's JSON fields that is there, else the record's own id."""
    (evidence,) = views(spark, sf_dir, "fielded")
    u = F.col("units")
    json = F.when(u % 3 == 0, F.concat(F.lit('{"pcis_permit":null,"permit_nbr":"A'), u.cast("string"), F.lit('"}'))).when(u % 3 == 1, F.concat(F.lit('{"permit":"B'), u.cast("string"), F.lit('"}'))).otherwise("{}")
    return evidence.filter("source_type = 'city_permit'").select("evidence_id", filters.first_json_text(json, F.col("record_id"), "pcis_permit", "permit_nbr", "permit", "permit_number").alias("permit"))


@query(
    """SELECT project_id, CASE WHEN project_id % 4 = 0 OR project_id % 4 = 1 THEN TRUE ELSE FALSE END AS same_place, CASE WHEN project_id % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS best_name FROM project""",
    "project",
)
def names_and_neighbourhoods(spark, sf_dir):
    """The best ratio over a project's names, and whether a neighbourhood is one of its four."""
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    place = filters.one_of(F.lit(" Echo  Park"), F.when(p % 4 == 0, "echo park"), F.lit(None).cast("string"), F.when(p % 4 == 1, "ECHO-PARK"), F.lit("Venice"))
    ratios = F.array(text.token_set_ratio(F.lit("999"), F.col("name")), text.token_set_ratio(F.lit("999"), F.when(p % 2 == 0, "999").otherwise("")))
    return project.select("project_id", place.alias("same_place"), F.array_max(ratios).alias("best_name"))


@query("SELECT 1 AS n, count(*) > 0 AS found FROM project s JOIN project p ON s.market_id = p.market_id AND s.project_id <> p.project_id AND s.address = p.address WHERE s.project_id % 100 = 0", "project")
def further_candidates_probe(spark, sf_dir):
    """Whether there is any further candidate: one row is enough."""
    (project,) = views(spark, sf_dir, "project")
    s = project.filter("project_id % 100 = 0").select(F.col("project_id").alias("s"), "market_id", "address")
    hit = s.join(project.select("project_id", "market_id", "address"), ["market_id", "address"]).filter("s <> project_id").limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found")).select(F.lit(1).alias("n"), "found")


_BOTH = """rec AS (SELECT project_id + 5000000 AS record_id, market_id, CASE WHEN project_id % 6 = 0 THEN NULL ELSE address END AS address, units, CASE WHEN project_id % 2 = 0 THEN 1 ELSE 2 END AS hash FROM project),
  ad AS (SELECT record_id, min(p.project_id) AS owner, count(DISTINCT p.project_id) AS owners FROM rec JOIN project p ON p.market_id = rec.market_id AND p.address = rec.address GROUP BY record_id)"""


@query(
    f"""WITH {_BOTH}, j AS (SELECT rec.*, CASE WHEN record_id % 4 = 0 THEN record_id - 5000000 END AS src, ad.owner, ad.owners FROM rec LEFT JOIN ad USING (record_id)),
       a AS (SELECT record_id, CASE WHEN src IS NOT NULL THEN 'source' WHEN owner IS NOT NULL THEN 'address' ELSE 'none' END AS step, coalesce(src, owner) AS owner, CASE WHEN hash = 1 AND record_id % 10 = 0 THEN 'unchanged' WHEN src IS NULL AND owner IS NULL THEN 'new_candidate' WHEN src IS NULL AND owners > 1 THEN 'possible_match' ELSE 'written' END AS action, units FROM j)
       SELECT record_id, step, owner, action, CASE action WHEN 'possible_match' THEN 'medium' WHEN 'new_candidate' THEN CASE WHEN units >= 100 THEN 'high' WHEN units >= 25 THEN 'medium' ELSE 'low' END END AS priority FROM a""",
    "project",
)
def collect_run(spark, sf_dir):
    """A source's records through match, write and review."""
    (project,) = views(spark, sf_dir, "project")
    p = F.col("project_id")
    records = project.select(
        (p + 5000000).alias("record_id"), "market_id", F.when(p % 6 != 0, F.col("address")).alias("address"), "units", "developer", F.when(p % 2 == 0, 1).otherwise(2).alias("hash"), F.lit("city_permit").alias("source_type"), F.lit(1).alias("tier"),
        F.lit("2001-01-01").cast("date").alias("evidence_date"), F.lit("2001-02-01 00:00:00").cast("timestamp").alias("collected_at"), (p + 9000000).alias("evidence_id"),
    )
    owners = records.filter("record_id % 4 = 0").select("record_id", (F.col("record_id") - 5000000).alias("project_id"))
    known = records.filter("record_id % 10 = 0").select("record_id", F.lit(1).alias("hash"))
    return pipelines.collect(records, project, owners, known, F.lit("2001-07-01").cast("date"))[0]


@query(
    """SELECT user_id AS source_id, count(*) AS discovered, count(*) FILTER (WHERE event_type = 'click') AS fetched, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS duplicate FROM events GROUP BY user_id"""
)
def scrape_counters(spark, sf_dir):
    kinds = {"click": "fetched", "error": "failed", "view": "duplicate"}
    outcomes = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), text.mapped(F.col("event_type"), kinds).alias("outcome"))
    return pipelines.scrape_counters(outcomes)


@query("SELECT reference_id, extraction_id = current_extraction_id AS current, round(abs(units - 50) / 50.0, 4)::DOUBLE AS delta, coalesce(abs(units - 50) / 50.0 > 0.25, FALSE) AS triggers FROM reference", "reference")
def unit_triggers(spark, sf_dir):
    (refs,) = views(spark, sf_dir, "reference")
    now = F.lit(50)
    return refs.select("reference_id", (F.col("extraction_id") == F.col("current_extraction_id")).alias("current"), F.round(F.abs(F.col("units") - now) / 50, 4).alias("delta"), review_op.unit_delta_exceeds(now, F.col("units"), 0.25).alias("triggers"))
