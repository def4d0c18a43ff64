"""Scans of feeds, sitemaps and HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.dates import mail_or_iso

FEED = "channel struct<item: array<struct<link: string, pubDate: string>>>"
SITEMAP = "url array<struct<loc: string, lastmod: string>>"
ATOM = "entry array<struct<link: struct<_href: string>, updated: string>>"

#: Words of a page that asks for a subscription.
PAYWALL = r"(?i)\b(subscribe|subscription|sign in|log in|login|register to read|already a subscriber)\b"

#: Entities that pages use for markup characters; the ampersand is decoded last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def feed_entries(text: Column) -> Column:
    """array(struct(url, published)) of an RSS channel."""
    return F.transform(F.from_xml(text, FEED)["channel"]["item"], lambda i: F.struct(F.trim(i["link"]).alias("url"), mail_or_iso(i["pubDate"]).alias("published")))


def atom_entries(text: Column) -> Column:
    return F.transform(F.from_xml(text, ATOM)["entry"], lambda i: F.struct(F.trim(i["link"]["_href"]).alias("url"), mail_or_iso(i["updated"]).alias("published")))


def sitemap_entries(text: Column) -> Column:
    """array(struct(url, modified)) of a sitemap."""
    return F.transform(F.from_xml(text, SITEMAP)["url"], lambda i: F.struct(F.trim(i["loc"]).alias("url"), mail_or_iso(i["lastmod"]).alias("modified")))


def since(entries: Column, at: str, day: Column) -> Column:
    """Entries without those that are known to be older."""
    return F.filter(entries, lambda e: e[at].isNull() | (e[at] >= day))


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def spaced(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, "[ \t\r\n]+", " ")), F.lit(""))


def html_title(html: Column) -> Column:
    return spaced(decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def html_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, """(?is)<html[^>]*\\slang=["']?([A-Za-z-]+)""", 1), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of this name or property, whose attributes may come in either order."""
    key, content = rf"""(?:name|property)=["']{name}["']""", """content=["']([^"']*)["']"""
    first = F.regexp_extract(html, rf"(?is)<meta\s+[^>]*?{key}[^>]*?{content}", 1)
    other = F.regexp_extract(html, rf"(?is)<meta\s+[^>]*?{content}[^>]*?{key}", 1)
    return spaced(decoded(F.coalesce(F.nullif(first, F.lit("")), other)))


def json_ld(html: Column) -> Column:
    """Of the JSON-LD blocks, the first item that is an article, a news article or a blog posting, as JSON text; null without one."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    at = lambda text, path: F.try_variant_get(F.try_parse_json(text), path, "string")
    items = lambda text: F.coalesce(F.from_json(at(text, "$.@graph"), "array<string>"), F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    every = F.flatten(F.transform(blocks, lambda b: F.concat(F.when(F.trim(b).startswith("{"), F.array(b)).otherwise(F.array().cast("array<string>")), items(b))))
    kinds = lambda text: F.coalesce(F.from_json(at(text, "$.@type"), "array<string>"), F.array(at(text, "$.@type")))
    good = lambda text: F.exists(kinds(text), lambda k: F.coalesce(F.lower(k).isin("article", "newsarticle", "blogposting"), F.lit(False)))
    return F.get(F.filter(every, good), F.lit(0))


def article(html: Column) -> Column:
    """struct(title, author, published, section, language): from JSON-LD, else from meta tags, else from the page."""
    item = json_ld(html)
    at = lambda *paths: F.coalesce(*[spaced(F.try_variant_get(F.try_parse_json(item), p, "string")) for p in paths])
    return F.struct(
        F.coalesce(at("$.headline", "$.name"), meta(html, "og:title"), meta(html, "twitter:title"), html_title(html)).alias("title"),
        F.coalesce(at("$.author.name", "$.author[0].name", "$.author"), meta(html, "article:author"), meta(html, "author")).alias("author"),
        F.coalesce(at("$.datePublished", "$.dateCreated"), meta(html, "article:published_time"), meta(html, "date")).alias("published"),
        F.coalesce(at("$.articleSection"), meta(html, "article:section")).alias("section"),
        html_language(html).alias("language"),
    )


def html_text(html: Column) -> Column:
    """A page's text: no scripts, styles, noscript parts, comments or tags, blanks folded."""
    plain = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        plain = F.regexp_replace(plain, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return spaced(decoded(F.regexp_replace(plain, "(?s)<[^>]*>", " ")))


def paywall(text: Column) -> Column:
    """`metered` for a short text that asks for a subscription."""
    return F.when((F.length(text) < 300) & text.rlike(PAYWALL), "metered")
