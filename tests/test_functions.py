"""Column functions and operators on hand-written rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates, scores, text
from siltstone.operators import feed, filters, matching, resolution


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_clean_values(spark):
    lit = F.lit
    assert one(spark, text.clean_text(lit(" -- ")), text.clean_identifier(lit("12.0")), text.parse_float(lit("1,250.5%")), text.parse_int(lit("2.5")), text.zip_code(lit("CA 90012-1"))) == (None, "12", 1250.5, 2, "90012")


def test_addresses(spark):
    got = one(spark, text.address_parts(F.lit("123 N First St, Los Angeles, CA 90012")))[0]
    assert got.canonical == "123 NORTH 1ST STREET LOS ANGELES CA 90012"
    assert one(spark, text.address_parts(F.lit(None).cast("string")))[0].canonical is None
    assert one(spark, text.house_range(F.lit("120-110")))[0].asDict() == {"low": 110, "high": 120}


def test_names(spark):
    assert one(spark, text.developer_name(F.lit("The Related & Sons, LLC")), text.developer_name(F.lit("LLC")), text.legal_suffix_count(F.lit("Acme Co Inc"))) == ("RELATED AND SONS", "LLC", 2)
    assert one(spark, text.permit_number(F.lit("1-23-456")), text.parcel_number(F.lit("12"), F.lit("3"), F.lit("45")), text.parcel_digits(F.lit("1234-567-890"))) == ("00001-00023-00456", "0012003045", "1234567890")


def test_urls(spark):
    assert one(spark, text.canonical_url(F.lit("HTTPS://Www.Example.com/a/?b=2&utm_source=x&a=1#top")))[0] == "https://www.example.com/a?a=1&b=2"


def test_token_sets(spark):
    assert text.set_ratio("small ring", "ring small") == 100.0
    assert text.set_ratio("", "a") == 0.0
    assert text.common_subsequence("kitten", "sitting") == 4
    assert one(spark, F.round(text.token_set_ratio(F.lit("brand 2"), F.lit("brand 25")), 2), text.token_set_ratio(F.lit(None).cast("string"), F.lit("a"))) == (93.33, 0.0)


def test_dates(spark):
    got = one(spark, dates.delivery_target(F.lit("Q3 2027")), dates.delivery_target(F.lit("late 2027")), dates.delivery_target(F.lit("soon")), dates.month_year(F.lit("Mar 2024")))
    assert got == (dt.date(2027, 8, 1), dt.date(2027, 11, 1), None, dt.date(2024, 3, 1))
    now = dt.datetime(2024, 5, 6, 12, 0, tzinfo=dt.UTC)
    assert dates.previous_fire("0 6 * * 1", "UTC", now, 24, None) == dt.datetime(2024, 5, 6, 6, 0, tzinfo=dt.UTC)
    assert dates.previous_fire("0 6 * * 1", "UTC", now, 24, now) is None


def test_scores(spark):
    assert one(spark, scores.unit_proximity(F.lit(100), F.lit(103)), scores.unit_proximity(F.lit(0), F.lit(0)), scores.unit_proximity(F.lit(10), F.lit(30)), scores.unit_proximity(F.lit(None).cast("int"), F.lit(1))) == (1.0, 1.0, 0.0, 0.0)
    assert one(spark, scores.proximity(F.lit(0.0)), scores.proximity(F.lit(1000.0)), scores.clamped(F.lit(float("nan")))) == (1.0, 0.0, 0.0)
    only = {"name": (F.lit(0.5), F.lit(True)), "units": (F.lit(1.0), F.lit(False))}
    assert one(spark, scores.weighted_likelihood(only)) == (0.5,)


def test_overrides(spark):
    keep = resolution.with_override(F.lit("a"), F.lit("b"), F.lit("sticky"), F.lit(True), F.lit(True))
    drop = resolution.with_override(F.lit("a"), F.lit("b"), F.lit("until_newer_evidence"), F.lit(True), F.lit(True))
    person = resolution.with_override(F.lit("a"), F.lit("b"), F.lit("until_newer_evidence"), F.lit(False), F.lit(True))
    assert one(spark, keep, drop, person) == ("b", "a", "b")
    assert one(spark, resolution.delta_shape(F.lit(None).cast("string"), F.lit("")), resolution.delta_shape(F.lit("a"), F.lit(None).cast("string"))) == ("unchanged", "value_to_null")


def test_paperwork(spark):
    got = [one(spark, filters.paperwork(F.lit("city_permit"), F.lit(s)))[0] for s in ("Issued", " expired ", "odd")]
    assert [(g.benign, g.alert) for g in got] == [(True, False), (False, False), (True, True)]


def test_cursors():
    cursor = feed.encode_cursor([5, "item"], {"view": "all"})
    assert feed.decode_cursor(cursor, {"view": "all"}) == [5, "item"]
    for bad, scope in ((cursor, {"view": "none"}), ("%%", {}), ("bm8", {})):
        with pytest.raises(ValueError):
            feed.decode_cursor(bad, scope)


def test_nearest_vectors_in_blocks(spark):
    """Any number of queries, in blocks of any size, finds what a plain comparison finds; odd vectors take no part."""
    rows = [(i, [math.sin(i * j + 1.0) for j in range(1, 5)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v))
    far = lambda v, w: round(1 - sum(x * y for x, y in zip(v, w)) / (size(v) * size(w)), 6)
    good = rows[:60]
    want = {(i, r, j, d) for i, v in good for r, (d, j) in enumerate(sorted((far(v, w), j) for j, w in good if j != i)[:3], 1)}
    got = matching.nearest_by_cosine(vectors, vectors, 3, query_block=7, vector_block=9)
    assert {(r.query_id, r.rank, r.vec_id, r.distance) for r in got.collect()} == want


def test_radius_crosses_cells(spark):
    points = spark.createDataFrame([(1, 34.0, -118.0), (2, 34.001, -118.0), (3, 34.0, -118.002), (4, 35.0, -118.0), (5, None, -118.0)], "id int, lat double, lng double")
    pairs = matching.within_radius(points.withColumnRenamed("id", "a"), points.withColumnRenamed("id", "b"), 250.0)
    assert {(r.a, r.b) for r in pairs.filter("a < b").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert pairs.filter("a = 1 AND b IN (2, 3)").count() == 2 and pairs.filter("a = 4 AND b <> 4").count() == 0


def test_address_ladder_by_hand(spark):
    from siltstone.functions.text import address_ladder

    cases = {
        "123 Main St, Los Angeles, CA 90012": ("123 MAIN STREET", None, "LOS ANGELES", "CA", "90012", "segments"),
        "123 n main st los angeles ca 90012-1234": ("123 NORTH MAIN STREET", None, "LOS ANGELES", "CA", "90012", "walk"),
        "45-47 Park Place Ave Apt 3B La Jolla CA": ("45-47 PARK PLACE AVENUE", "APT 3B", "LA JOLLA", "CA", None, "walk"),
        "9 North St": ("9 NORTH STREET", None, None, None, None, "walk"),
        "12 Second Street NE #5 Boise ID 83702": ("12 2ND STREET NORTHEAST", "#5", "BOISE", "ID", "83702", "walk"),
        "Pier 39, San Francisco, CA 94133": ("PIER 39", None, "SAN FRANCISCO", "CA", "94133", "loose"),
        "500 Broadway": ("500 BROADWAY", None, None, None, None, "loose"),
        "  ": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string").select("a", address_ladder(F.col("a")).alias("x")).collect()
    for r in rows:
        want = cases.get(r.a)
        assert (r.x and (r.x.street, r.x.unit, r.x.city, r.x.state, r.x.zip, r.x.rung)) == want, r
