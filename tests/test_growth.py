"""What keeps the work of a query in step with its rows: tasks for all cores, steps computed once, pairs that are not made."""

import duckdb
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.functions import text
from siltstone.model import views
from siltstone.operators import matching

SF = "/root/testdata/sf0.001"


def test_small_tables_are_dealt_out_to_all_cores(spark):
    (articles,) = views(spark, SF, "article", spread_by="o_orderkey")
    assert articles.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    (plain,) = views(spark, SF, "article")
    assert sorted(articles.collect()) == sorted(plain.collect())


def test_steps_of_an_address_are_computed_once(spark):
    rows = spark.createDataFrame([("12 N Main St, #4, DTLA, CA 90012",), (None,), ("",), (",,",)], "a string")
    read = rows.select("a", text.address_parts(F.col("a"), market="los_angeles").alias("p"))
    assert read._jdf.queryExecution().analyzed().toString().count("split(upper(") == 1
    assert [tuple(r["p"]) for r in read.collect()] == [("12 NORTH MAIN STREET", "#4", "LOS ANGELES", "CA", "90012", "12 NORTH MAIN STREET LOS ANGELES CA 90012")] + 3 * [(None,) * 6]


def test_permits_of_customers_with_long_keys(spark, tmp_path):
    spark.sql("SELECT 130001L AS o_orderkey, 1234567L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog.queries()["permit_and_parcel_numbers"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        assert [tuple(r) for r in rows] == con.execute(catalog.oracle_sql()["permit_and_parcel_numbers"]).fetchall()


def test_names_that_many_rows_bear_are_compared_once(spark):
    subjects = spark.createDataFrame([(1, 1, "Ring Tower"), (2, 1, "tower ring"), (3, 2, "Ring"), (4, 1, None)], "subject_id long, market_id int, wanted string")
    rows = spark.createDataFrame([(i, 1 + i % 2, ("Ring tower", "The hot bolt", "Ring Towers", None)[i % 4]) for i in range(40)], "project_id long, market_id int, name string")
    compared = []
    found = matching.similar_names(subjects, rows)
    got = sorted(tuple(r) for r in found.collect())
    for s in subjects.collect():
        for p in rows.collect():
            ratio = round(text.set_ratio(s["wanted"] or "", p["name"] or ""), 4)
            if s["market_id"] == p["market_id"] and s["subject_id"] != p["project_id"] and ratio >= 85:
                compared.append((s["subject_id"], p["project_id"], ratio))
    assert got == sorted(compared) and len(got) > 20
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_hard_signals_of_single_ids_need_no_exchange_of_pairs(spark):
    schema = "project_id long, market_id int, address string, name string, developer string, units int, product_type string, lat double, lng double"
    rows = spark.createDataFrame([(i, i % 2, f"{i % 3} MAIN STREET", "n", "Dev, LLC", i % 4, "condo", 34.0 + i % 5 / 1000, -118.0) for i in range(40)], schema)
    found = matching.hard_signals(rows.filter("project_id % 10 = 0"), rows)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = matching.hard_signals(rows.filter("project_id % 10 = 0"), rows.unionAll(rows))
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(tuple(r) for r in twice.collect()) and len(got) == len(set(got)) > 40


def test_rows_of_a_crowded_cell_are_dealt_out(spark):
    points = spark.range(64).select("id", F.lit(34.0).alias("lat"), F.lit(-118.0).alias("lng"))
    pairs = matching.within_radius(points.filter("id = 0").withColumnRenamed("id", "a"), points, 250.0)
    assert pairs.count() == 64
    assert "_part" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_alike_references_and_projects_make_no_pairs(spark):
    from siltstone.operators import news

    schema = "market_id int, address string, name string, developer string, units int"
    alike = [(1, "1 A ST", "N", "D", 10)] * 300 + [(1, "1 A ST 90001", "n", None, 12)] * 300 + [(2, "1 A ST", None, "d", 10)] * 2
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(alike)], f"project_id long, {schema}")
    found = news.address_composite(rows.withColumnRenamed("project_id", "reference_id"), rows)
    got = {r.reference_id: (r.status, r.project_id, r.score, r.candidates) for r in found.collect()}
    assert got == {i: ("possible", None, 0.9, 300) for i in range(300)} | {i: ("possible", None, 0.7, 300) for i in range(300, 600)} | {i: ("possible", None, 0.75, 2) for i in (600, 601)}
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and joins.count("Aggregate [") >= 6


def test_rows_of_a_developer_meet_by_place_and_units_or_nearness(spark):
    from random import Random

    from siltstone.functions import scores

    rng = Random(3)
    rows = [(i, i % 2, rng.choice(["D", "E", None]), rng.choice([1, 2, None]), rng.choice([None, 0, -4, -3, 1, 3, 4, 9, 12, 16]), rng.choice(["a", "b"]), rng.choice([0, 1, 2, None]), rng.choice([34.0, 34.0006, 34.001, None]), rng.choice([-118.0, -118.0005])) for i in range(120)]
    p = spark.createDataFrame(rows, "project_id long, market_id int, developer string, jurisdiction_id int, units int, product_type string, status_rank int, lat double, lng double")
    s, c = p.withColumnsRenamed({x: f"s_{x}" for x in p.columns}), F.col
    score = matching.fingerprint_score(c("s_developer") == c("developer"), c("s_jurisdiction_id") == c("jurisdiction_id"), scores.within_share(c("s_units"), c("units")), c("s_product_type") == c("product_type"), scores.within_one(c("s_status_rank"), c("status_rank")), scores.within_meters(c("s_lat"), c("s_lng"), c("lat"), c("lng")))
    every = s.join(p, (c("s_market_id") == c("market_id")) & (c("s_developer") == c("developer")) & (c("s_project_id") != c("project_id")))
    want = sorted(map(tuple, every.select("s_project_id", "project_id", score.alias("x")).filter("x >= 0.8").collect()))
    found = matching.fingerprint_pairs(p, p)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    assert "_step" in found._jdf.queryExecution().optimizedPlan().toString()


def test_developers_of_one_name_are_compared_once(spark):
    from siltstone.operators import registry

    raw = spark.createDataFrame([("Boreallis Homes",), ("Atlas Residental",), ("Zenith",)], "raw_name string")
    names = spark.createDataFrame([(i, f"{n} LLC", i % 3 == 0, n, False) for i in range(200, 0, -1) for n in (["Borealis Homes", "Atlas Residential"][i % 2],)], "developer_id long, canonical_name string, top_tier boolean, name string, is_alias boolean")
    found = registry.fuzzy_matches(raw, names)
    assert {r.raw_name: (r.developer_id, r.match_type) for r in found.collect()} == {"Boreallis Homes": (6, "fuzzy_auto"), "Atlas Residental": (3, "fuzzy_auto")}
    assert "min(developer_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_many_rows_bear_are_compared_once(spark):
    from random import Random

    rng = Random(5)
    grams = lambda t: {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for i in range(len(w) + 1)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) | grams(b) else 0.0
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["1 Oak St", "2 Oak St", "17 Elm Road", "zzz", "", None]), rng.choice(["small ring", "hot bolt", "ring", "ring bolt", None])) for i in range(300)]
    p = spark.createDataFrame(rows, "project_id long, market_id int, address string, name string")
    s = p.filter("project_id % 3 = 0").withColumnRenamed("project_id", "subject_id")
    got = {}
    for r in matching.top_similar(s, p, "subject_id", "project_id", ["address", "name"], ["market_id"], most=5, ranked="r").collect():
        got.setdefault(r.subject_id, {})[r.r] = (r.project_id, round(r.total, 9))
    want = {}
    for i, m, a, n in rows[::3]:
        totals = {j: sum(x for x in (alike(a, b), alike(n, o)) if x >= 0.12) for j, k, b, o in rows if j != i and m is not None and k == m}
        best = sorted(((-round(x, 9), j) for j, x in totals.items() if x > 0))[:5]
        if best:
            want[i] = {k: (j, -x) for k, (x, j) in enumerate(best, 1)}
    assert got == want and len(want) > 50
    pairs = matching.similar_texts(s, p, "address", ["market_id"], 0.12, 500_000)
    assert pairs.count() == len(pairs.select("market_id", "_s", "_p").distinct().collect()) <= 2 * 36


_COPIED = "project_id long, market_id int, address string, name string, developer string, units int, product_type string, lat double, lng double"


def test_candidates_of_copies_are_made_by_class(spark):
    kinds = [(1, "1 OAK ST", "a tower", "D LLC", 10, "condo"), (1, None, "b tower", "D", 12, None), (1, "2 OAK ST", None, "E", None, "condo")]
    rows = spark.createDataFrame([(i, *kinds[i % 3], 34.0, -118.0) for i in range(120)], _COPIED)
    assert matching.classes(rows, rows.columns[1:]).count() == 3
    got = {}
    for r in matching.layered_candidates(rows, rows).collect():
        got.setdefault(r.subject_id, []).append((r["rank"], r.project_id, r.layer, r.likelihood))
    assert len(got) == 120
    for i, found in got.items():
        score = {j % 3: x for _, j, _, x in found}
        own = [j for j in range(i % 3, 120, 3) if j != i][:25]
        assert [(k, j, layer) for k, j, layer, _ in sorted(found)] == [(k, j, 1) for k, j in enumerate(own, 1)] and score == {i % 3: 1.0}


def test_hard_signals_of_copies_are_found_once(spark):
    rows = spark.createDataFrame([(i, 1, "1 OAK ST", "n", "D", 10, "condo", 34.0, -118.0) for i in range(300)], _COPIED)
    found = matching.hard_signals(rows.filter("project_id < 2"), rows)
    assert found.groupBy("name").count().count() == 3 and found.count() == 3 * 2 * 299
    of = matching.classes(rows, rows.columns[1:], size=100)
    s = matching.compared(of, "s_")
    pairs = matching.agreements(s, matching.compared(of, "p_"), F.col("s_c"), F.col("p_c"))
    assert pairs.count() == 3 and of.first()["_k"] == 3
    assert {r["_part"] for r in matching.members(rows, of, rows.columns[1:]).collect()} == {0, 1, 2}


def test_texts_of_many_rows_are_read_once(spark):
    from siltstone.operators import extraction

    texts = ["A 20-unit senior housing project at 586 North Main Street, Los Angeles, CA 90016 in March", None, "It opens in Q1 2027.", ""]
    rows = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "id long, body string")
    read = extraction.matches_of_texts(rows, "id", "body", most=4)
    assert sorted(tuple(r) for r in read.withColumn("id", F.explode("id")).collect()) == sorted(tuple(r) for r in extraction.matches(rows, "id", "body").collect())
    assert {len(r.id) for r in read.collect()} == {4, 2} and {len(r.id) for r in extraction.matches_of_texts(rows, "id", "body").collect()} == {10}
    once = extraction.signals(rows, "id", "body")
    assert "Deduplicate" not in once._jdf.queryExecution().analyzed().toString() and once.count() == 40
    twice = extraction.signals(rows.unionAll(rows), "id", "body")
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_articles_of_one_body_by_sql(spark, tmp_path):
    for name in ("structural_signals", "signals_by_sql", "structural_disagreement_values"):
        small = {r for r in catalog.queries()[name](spark, SF).collect()}
        orders = spark.read.parquet(f"{SF}/orders.parquet")
        # keys a period of the model's texts later: each body and title comes twice
        shift = 900 * 9000 * 10 * 7
        later = orders.withColumn("o_orderkey", F.col("o_orderkey") + shift)
        later.unionByName(orders).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        plain = lambda r: tuple(v % shift if k == "article_id" else v for k, v in r.asDict().items())
        assert len(got) == 2 * len(small) and {plain(r) for r in got} == {tuple(r) for r in small}


def test_every_project_is_a_subject(spark):
    for name, n in (("radius_join_250m", 200), ("layered_dedup_sweep", 200)):
        assert catalog.queries()[name](spark, SF).select("subject_id").distinct().count() > 0.5 * n, name
    assert "% 100" not in catalog.oracle_sql()["radius_join_250m"].split("WITH", 1)[1].split("SELECT s.project_id", 1)[1]
