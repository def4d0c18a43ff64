"""Queries on sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siltstone.functions.text import canonical_url
from siltstone.model import views
from siltstone.operators import sinks as op
from siltstone.registry import query
from siltstone.session import table
from siltstone.sources import adapters, pages

_DAY = "1998-06-30"
_CLEAN = "CASE WHEN trim(permit) IN ('', '--') THEN NULL ELSE trim(permit) END"
_PADDED = "array_to_string(list_transform(string_split(permit, '-'), lambda x: CASE WHEN len(x) >= 5 THEN x ELSE lpad(x, 5, '0') END), '-')"
_APN = "CASE WHEN parcel <> 'x' THEN concat(lpad(book, 4, '0'), lpad(page, 3, '0'), lpad(parcel, 3, '0')) END"
_ISSUED = "TRY_CAST(substr(issue_date, 1, 10) AS DATE)"
_ROW = "SELECT '{0}' AS source, {1} AS record_id, trim(address) AS address, {2} AS evidence_type, CAST({3} AS VARCHAR) AS evidence_date, {4} AS apn, {5} AS lat, {6} AS lng, {7} AS housing_use FROM feed WHERE {8}"
_COFO = f"lower(trim(latest_status)) = 'cofo issued' AND {_ISSUED} IS NOT NULL"
_SEEN = f"{_ISSUED} >= DATE '{_DAY}' - 365 AND result IN ('Approved', 'Partial Approval', 'Completed') AND permit_status IN ('Issued', 'Pending CofO')"
_GOOD = "permit <> '--'"
_ADAPTED = " UNION ALL ".join([
    _ROW.format("permits", _CLEAN, "'building_permit_issued'", _ISSUED, "NULL", "NULL", "NULL", "NULL", _GOOD),
    _ROW.format("permit_activity", _CLEAN, "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", _GOOD),
    _ROW.format("new_housing", _CLEAN, "'building_permit_issued'", _ISSUED, _APN, "lat", "lng", "NULL", _GOOD),
    _ROW.format("occupancy", "cofo_number", f"CASE WHEN {_COFO} THEN 'certificate_of_occupancy_issued' END", f"CASE WHEN {_COFO} THEN {_ISSUED} END", _APN, "lat", "lng", "NULL", "cofo_number IS NOT NULL"),
    _ROW.format("live_permits", _PADDED, "'building_permit_issued'", _ISSUED, _APN, "lat", "lng", "CASE WHEN use_desc IN ('Apartment', 'Duplex') THEN use_desc END", _GOOD),
    _ROW.format("live_permit_activity", _PADDED, "NULL", "NULL", _APN, "lat", "lng", "NULL", _GOOD),
    _ROW.format("inspections", "CAST(row_id AS VARCHAR)", f"CASE WHEN {_SEEN} THEN 'building_inspection_recorded' END", f"CASE WHEN {_SEEN} THEN {_ISSUED} END", "NULL", "lat", "lng", "NULL", _GOOD),
])


@query(_ADAPTED, "feed")
def adapted_records(spark, sf_dir):
    """All rows of the feed by each of the seven adapters."""
    (feed,) = views(spark, sf_dir, "feed")
    as_of = F.lit(_DAY).cast("date")
    return reduce(lambda a, b: a.unionByName(b), [feed.transform(adapters.adapter(name, as_of)) for name in adapters.adapters(as_of)])


@query("SELECT event_id, sha256(concat(chr(123), '\"k\":', json_extract(props, '$.k'), chr(125))) AS hash FROM events")
def content_hash(spark, sf_dir):
    """A hash of each event's content: its keys sorted, those that begin with a colon left out."""
    return table(spark, sf_dir, "events").select("event_id", op.canonical_hash(F.col("props")).alias("hash"))


@query(
    """WITH f AS (SELECT 0 AS file, s_suppkey AS row, s_suppkey % 70 AS id, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 90 END, c_name FROM customer)
       SELECT id, name, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, row) AS r FROM f WHERE id IS NOT NULL) WHERE r = 1"""
)
def cross_file_first_seen(spark, sf_dir):
    """Of two files with headers of their own, the first row of each id."""
    one = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 70).alias(" Property  ID "), F.col("s_suppkey").alias("row"), F.col("s_name").alias("NAME"))
    other = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 90).alias("property id"), F.col("c_custkey").alias("row"), F.col("c_name").alias("Name "))
    headers = {"Property ID": "id", "row": "row", "Name": "name"}
    both = op.named(one, headers).withColumn("file", F.lit(0)).unionByName(op.named(other, headers).withColumn("file", F.lit(1)))
    return op.first_seen(both, "id", "file", "row").select("id", "name", "file")


@query(
    """SELECT CASE WHEN project_id % 13 = 0 THEN 'blank' WHEN jurisdiction_id NOT IN (1, 2, 3, 4, 5, 6) THEN 'other_city' WHEN status_rank = 6 THEN 'dismissed' ELSE 'project' END AS route, count(*) AS n FROM project GROUP BY 1""",
    "project",
)
def workbook_routing(spark, sf_dir):
    """Where a workbook's rows go: dropped without an id or of other cities, dismissed records, projects."""
    (project,) = views(spark, sf_dir, "project")
    key = F.when(F.col("project_id") % 13 != 0, F.col("project_id"))
    route = op.route(key, F.col("jurisdiction_id"), F.col("status_rank"), [1, 2, 3, 4, 5, 6], [6])
    return project.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, max(updated_at) - INTERVAL 24 HOUR AS cursor, 'incremental' AS mode FROM feed GROUP BY source_id UNION ALL SELECT 99, NULL, 'full'", "feed")
def incremental_cursors(spark, sf_dir):
    """Of each source what the next pull asks for; one that was never loaded has no cursor."""
    (feed,) = views(spark, sf_dir, "feed")
    never = spark.range(1).select(F.lit(99).alias("source_id"), F.lit(None).cast(feed.schema["updated_at"].dataType).alias("updated_at"))
    return op.incremental_cursor(feed.select("source_id", "updated_at").unionByName(never), 24)


@query(
    """WITH i AS (SELECT evidence_id, CASE WHEN evidence_id % 3 <> 0 THEN project_id END AS project_id, source_type, record_id, units % 5 AS hash FROM fielded), k AS (SELECT source_type, record_id, hash, max(project_id) AS owner FROM (SELECT * FROM i WHERE evidence_id % 40 = 0) GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY source_type, record_id, hash, project_id ORDER BY evidence_id) AS r FROM i)
       SELECT evidence_id, n.project_id, CASE WHEN r > 1 THEN 'skip' WHEN k.record_id IS NULL THEN 'insert' WHEN owner IS NULL AND n.project_id IS NOT NULL THEN 'link' ELSE 'skip' END AS action FROM n LEFT JOIN k USING (source_type, record_id, hash)""",
    "fielded",
)
def evidence_sink(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "fielded")
    rows = evidence.select("evidence_id", F.when(F.col("evidence_id") % 3 != 0, F.col("project_id")).alias("project_id"), "source_type", "record_id", (F.col("units") % 5).alias("hash"))
    return op.evidence_writes(rows, rows.filter("evidence_id % 40 = 0"))


@query(
    """SELECT a.project_id, CASE WHEN b.project_id IS NULL THEN 'inserted' WHEN a.hash = b.hash AND a.mapped IS NOT DISTINCT FROM b.mapped THEN 'unchanged' ELSE 'updated' END AS action
       FROM (SELECT project_id, units AS hash, CASE WHEN project_id % 5 = 0 THEN NULL ELSE developer END AS mapped FROM project) a LEFT JOIN (SELECT project_id, CASE WHEN project_id % 4 = 0 THEN units + 1 ELSE units END AS hash, CASE WHEN project_id % 10 = 0 THEN NULL ELSE developer END AS mapped FROM project WHERE project_id % 3 <> 0) b USING (project_id)""",
    "project",
)
def source_record_upsert(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    p, d = F.col("project_id"), F.col("developer")
    a = project.select("project_id", F.col("units").alias("hash"), F.when(p % 5 != 0, d).alias("mapped"))
    b = project.filter("project_id % 3 <> 0").select("project_id", F.when(p % 4 == 0, F.col("units") + 1).otherwise(F.col("units")).alias("hash"), F.when(p % 10 != 0, d).alias("mapped"))
    return op.record_upsert(a, b, ["project_id"])


@query(
    """WITH f AS (SELECT page_id AS place, concat('https://a.example/', CAST(page_id % 37 AS VARCHAR)) AS url, CASE WHEN page_id % 2 = 0 THEN 1000 + page_id END AS published, 5000 + page_id AS modified FROM pages), k AS (SELECT sha256('https://a.example/5') AS h UNION ALL SELECT sha256('https://a.example/11'))
       SELECT url, sha256(url) AS url_hash, coalesce(published, modified) AS published FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY place) AS r FROM f WHERE sha256(url) NOT IN (SELECT h FROM k)) WHERE r = 1"""
)
def article_inserts(spark, sf_dir):
    page = F.col("page_id")
    found = table(spark, sf_dir, "pages").select(page.alias("place"), F.concat(F.lit("https://a.example/"), (page % 37).cast("string")).alias("url"), F.when(page % 2 == 0, 1000 + page).alias("published"), (5000 + page).alias("modified"))
    known = found.filter("url IN ('https://a.example/5', 'https://a.example/11')").select(F.sha2("url", 256).alias("url_hash")).distinct()
    return op.article_inserts(found, known)


@query(
    """WITH a AS (SELECT event_id AS id, event_type AS key, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 3 AS VARCHAR) END AS scope, CASE WHEN value > 500 THEN 'high' ELSE 'low' END AS severity, ts AS m FROM events WHERE event_id % 4 <> 0)
       SELECT key, coalesce(scope, '{}') AS scope, arg_max(severity, struct_pack(a := m, i := id)) AS severity, arg_max(id, struct_pack(a := m, i := id)) AS last_id, count(*) AS times FROM a GROUP BY key, coalesce(scope, '{}')"""
)
def open_alerts(spark, sf_dir):
    raised = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 3).cast("string")).alias("scope"),
        F.when(F.col("value") > 500, "high").otherwise("low").alias("severity"), F.col("ts").alias("at"), (F.col("event_id") % 4 == 0).alias("resolved"),
    )
    return op.open_alerts(raised)


@query(
    """SELECT item_id, concat('https://n.example/', CAST(item_id AS VARCHAR)) AS url FROM (SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE item_id % 5 = 0 OR d >= DATE '1997-01-01'"""
)
def feed_scan(spark, sf_dir):
    """Feeds of one item for each order (every fifth without a date), read back and cut by date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("d"))
    date = F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit("<pubDate>"), F.date_format("d", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 +0000</pubDate>")))
    text = F.concat(F.lit("<rss><channel><title>t</title><item><link>https://n.example/"), F.col("item_id").cast("string"), F.lit("</link>"), date, F.lit("</item></channel></rss>"))
    entries = pages.since(pages.feed_entries(text), "published", F.lit("1997-01-01 00:00:00").cast("timestamp"))
    return orders.select("item_id", F.inline(entries)).select("item_id", "url")


@query("""SELECT item_id, concat('https://s.example/', CAST(item_id AS VARCHAR)) AS url, CAST(d AS VARCHAR) AS modified FROM (SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d >= DATE '1996-07-01'""")
def sitemap_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("d"))
    text = F.concat(F.lit("<urlset><url><loc>https://s.example/"), F.col("item_id").cast("string"), F.lit("</loc><lastmod>"), F.col("d").cast("string"), F.lit("</lastmod></url></urlset>"))
    entries = pages.since(pages.sitemap_entries(text), "modified", F.lit("1996-07-01 00:00:00").cast("timestamp"))
    return orders.select("item_id", F.inline(entries)).select("item_id", "url", F.to_date("modified").cast("string").alias("modified"))


@query("SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1")
def first_page_of_host(spark, sf_dir):
    """URLs once each, the first that was found staying; here by host."""
    host = F.regexp_extract(canonical_url(F.col("url")), "^[a-z]+://([^/?#]*)", 1)
    rows = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", host.alias("host"))
    return op.first_seen(rows, "host", "page_id").select("host", "page_id")


_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<noscript[^>]*>.*?</noscript>', ' ', 'gis')"
_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_FOLDED = "nullif(trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g')), '')"


@query(
    f"""WITH t AS (SELECT page_id, html, {_FOLDED.format(_DECODED.format("regexp_replace(" + _TEXT + ", '<[^>]*>', ' ', 'gs')"))} AS text FROM pages)
       SELECT page_id, {_FOLDED.format(_DECODED.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"))} AS title, nullif(regexp_extract(html, '<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1, 'is'), '') AS language, sha256(text) AS text_hash, length(text) AS n_chars,
         CASE WHEN length(text) < 300 AND regexp_matches(text, '\\b(subscribe|subscription|sign in|log in|login|register to read|already a subscriber)\\b', 'i') THEN 'metered' END AS paywall FROM t"""
)
def html_pages(spark, sf_dir):
    """Title, language, text and paywall state of every page."""
    # the text comes out of a generator, so that it is made once for what is read of it
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array(pages.html_text(F.col("html")))).alias("text"))
    found = pages.article(F.col("html"))
    return rows.select("page_id", found["title"].alias("title"), found["language"].alias("language"), F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"), pages.paywall(F.col("text")).alias("paywall"))
