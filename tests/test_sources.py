"""Paged pulls from a service, and scans of hand-written pages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from siltstone.sources import adapters, pages
from siltstone.sources.paged import pull_parameters, register

ROWS = [{"id": i, "name": None if i % 7 == 0 else f"n{i}"} for i in range(2345)]


@pytest.fixture
def service():
    failed, asked = set(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            low, n = int(q["$offset"]), int(q["$limit"])
            asked.append(q)
            if low % 900 == 0 and low not in failed:  # such a page fails once
                failed.add(low)
                self.send_error(503 if low > 10**6 else 502)
                return
            body = json.dumps(ROWS[low : low + n]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows.json", asked
    server.shutdown()


def test_paged_pull(spark, service):
    url, asked = service
    register(spark)
    parameters = pull_parameters(["name"], "name <> 'x'", ":updated_at", "incremental", "2024-01-01")
    pull = spark.read.format("paged_json").schema("id string, name string").option("url", url).option("pageSize", 300).option("rangeRecords", 900).option("pause", 0.01)
    got = pull.option("maxRecords", 4000).option("parameters", json.dumps(parameters)).load()
    assert sorted((int(r.id), r.name) for r in got.collect()) == [(r["id"], r["name"]) for r in ROWS]
    assert pull.option("maxRecords", 1000).load().count() == 1000
    assert {q.get("$where") for q in asked} >= {"(name <> 'x') AND :updated_at >= '2024-01-01'"}


def test_pull_parameters():
    assert pull_parameters(None, None, ":updated_at", "preview", None) == {"$select": ":*, *", "$order": ":updated_at DESC"}
    assert pull_parameters(["a", "b"], None, "d", "full", "x") == {"$select": ":id,:created_at,:updated_at,a,b", "$order": "d ASC"}


def test_unknown_adapter():
    with pytest.raises(KeyError):
        adapters.adapter("no such feed", None)


PAGE = """<html lang="en-US"><head><title> Plain &amp; simple
 </title><meta content="Og title" property="og:title"><meta name='author' content='A. Writer'><meta property="article:section" content="News">
<script type="application/ld+json">not json</script><script type="application/ld+json">{"@graph": [{"@type": "WebPage", "headline": "no"}, {"@type": ["NewsArticle"], "headline": "The headline", "author": {"name": "B. Author"}, "datePublished": "2024-05-01"}]}</script>
</head><body><!-- <p>hidden</p> --><p>One&nbsp;two</p><noscript>none</noscript><style>p{}</style></body></html>"""


def test_article(spark):
    found = spark.createDataFrame([(PAGE,), (PAGE.replace("application/ld+json", "text/x"),), ("",), (None,)], "h string").select(pages.article(F.col("h")).alias("a"), pages.html_text(F.col("h")).alias("t")).collect()
    assert tuple(found[0].a) == ("The headline", "B. Author", "2024-05-01", "News", "en-US") and found[0].t == "Plain & simple One two"
    assert tuple(found[1].a) == ("Og title", "A. Writer", None, "News", "en-US")
    assert all(tuple(r.a) == (None,) * 5 and r.t is None for r in found[2:])


def test_feeds(spark):
    rss = "<rss><channel><item><link> https://a/1 </link><pubDate>Wed, 01 May 2024 10:00:00 +0000</pubDate></item><item><link>https://a/2</link></item></channel></rss>"
    atom = '<feed><entry><link href="https://a/3"/><updated>2024-05-02T00:00:00Z</updated></entry></feed>'
    sitemap = "<urlset><url><loc>https://a/4</loc><lastmod>2024-04-01</lastmod></url><url><loc>https://a/5</loc></url></urlset>"
    row = spark.createDataFrame([(rss, atom, sitemap)], "r string, a string, s string")
    day = F.lit("2024-04-15").cast("timestamp")
    got = row.select(pages.since(pages.feed_entries(F.col("r")), "published", day).alias("r"), pages.atom_entries(F.col("a")).alias("a"), pages.since(pages.sitemap_entries(F.col("s")), "modified", day).alias("s")).first()
    assert [(e.url, e.published is None) for e in got.r] == [("https://a/1", False), ("https://a/2", True)]
    assert [(e.url, str(e.published)[:10]) for e in got.a] == [("https://a/3", "2024-05-02")]
    assert [e.url for e in got.s] == ["https://a/5"]


def test_paywall(spark):
    rows = spark.createDataFrame([("Subscribe to read",), ("Subscribe " * 60,), ("plain",), (None,)], "t string")
    assert [r.p for r in rows.select(pages.paywall(F.col("t")).alias("p")).collect()] == ["metered", None, None, None]
