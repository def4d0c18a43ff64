"""Join and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scores, text
from siltstone.model import views
from siltstone.operators import matching as op
from siltstone.operators.ranking import first_row
from siltstone.registry import query
from siltstone.session import table

_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lng - s.lng) / 2), 2))))"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIMILAR = "coalesce(len(list_intersect({0}, {1})) / nullif(len({0}) + len({1}) - len(list_intersect({0}, {1})), 0), 0)"


@query(
    """WITH r AS (SELECT item_id, project_id % 40 AS k, jurisdiction_id FROM review_item), o AS (SELECT project_id, project_id % 40 AS k, jurisdiction_id FROM project)
       SELECT item_id, min(o.project_id) AS owner, count(DISTINCT o.project_id) AS owners, CASE WHEN count(DISTINCT o.project_id) = 1 THEN 0.97::DOUBLE ELSE 0.70::DOUBLE END AS confidence, count(DISTINCT o.project_id) > 1 AS possible
       FROM r JOIN o USING (k, jurisdiction_id) GROUP BY item_id""",
    "review_item", "project",
)
def identifier_match_ambiguity(spark, sf_dir):
    items, project = views(spark, sf_dir, "review_item", "project")
    records = items.select("item_id", (F.col("project_id") % 40).alias("k"), "jurisdiction_id")
    return op.by_identifier(records, project.select("project_id", (F.col("project_id") % 40).alias("k"), "jurisdiction_id"), "item_id", ["k", "jurisdiction_id"], "project_id")


_RECORDS = """r AS (SELECT project_id + 100000 AS record_id, market_id, CASE WHEN project_id % 2 = 0 THEN regexp_replace(address, ' [0-9]{5}$', '') ELSE address END AS address FROM project),
       eq AS (SELECT record_id, min(p.project_id) AS owner, count(DISTINCT p.project_id) AS owners FROM r JOIN project p ON r.market_id = p.market_id AND r.address = p.address GROUP BY record_id),
       pre AS (SELECT record_id, min(p.project_id) AS owner, count(DISTINCT p.project_id) AS owners FROM r JOIN project p ON r.market_id = p.market_id AND regexp_replace(p.address, ' [0-9]{5}$', '') = r.address AND p.address <> r.address
         WHERE record_id NOT IN (SELECT record_id FROM eq) GROUP BY record_id), a AS (SELECT * FROM eq UNION ALL SELECT * FROM pre)"""


def _records(project):
    bare = F.when(F.col("project_id") % 2 == 0, F.regexp_replace("address", r" \d{5}$", "")).otherwise(F.col("address"))
    return project.select((F.col("project_id") + 100000).alias("record_id"), "market_id", bare.alias("address"))


@query(f"WITH {_RECORDS} SELECT record_id, owner, owners, CASE WHEN owners = 1 THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS confidence, owners > 1 AS possible FROM a", "project")
def address_zip_tolerant(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return op.by_address(_records(project), project, "record_id", "project_id")


@query(
    f"""WITH {_RECORDS}, src AS (SELECT record_id, record_id - 100000 AS owner FROM r WHERE record_id % 3 = 0)
       SELECT r.record_id, CASE WHEN src.owner IS NOT NULL THEN 'source' WHEN a.owner IS NOT NULL THEN 'address' ELSE 'none' END AS step, coalesce(src.owner, a.owner) AS owner,
              CASE WHEN src.owner IS NOT NULL THEN 0.99::DOUBLE WHEN a.owners = 1 THEN 0.9::DOUBLE WHEN a.owners > 1 THEN 0.65::DOUBLE END AS confidence, CASE WHEN src.owner IS NOT NULL THEN FALSE ELSE a.owners > 1 END AS possible
       FROM r LEFT JOIN src USING (record_id) LEFT JOIN a USING (record_id)""",
    "project",
)
def match_ladder(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    records = _records(project)
    source = records.filter("record_id % 3 = 0").select("record_id", (F.col("record_id") - 100000).alias("owner"), F.lit(0.99).alias("confidence"), F.lit(False).alias("possible"))
    return op.ladder(records, "record_id", ("source", source), ("address", op.by_address(records, project, "record_id", "project_id")))


@query(
    f"""SELECT s.project_id AS subject_id, p.project_id, round({_HAVERSINE}, 3) AS meters FROM project s JOIN project p ON s.project_id <> p.project_id WHERE {_HAVERSINE} <= 250""",
    "project",
)
def radius_join_250m(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    points = project.select("project_id", "lat", "lng")
    pairs = op.within_radius(points.withColumnRenamed("project_id", "subject_id"), points, 250.0)
    return pairs.filter("subject_id <> project_id").select("subject_id", "project_id", F.round("meters", 3).alias("meters"))


@query(
    f"""SELECT p.project_id, round(min({_HAVERSINE}) * 3.28084, 2) AS feet FROM project s JOIN project p ON TRUE WHERE s.project_id IN (100, 200, 300) GROUP BY p.project_id HAVING min({_HAVERSINE}) * 3.28084 <= 2000 AND min({_HAVERSINE}) > 0""",
    "project",
)
def radius_from_anchors(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    anchors = project.filter(F.col("project_id").isin(100, 200, 300)).select(F.col("project_id").alias("anchor_id"), "lat", "lng")
    near = op.within_radius(anchors, project.select("project_id", "lat", "lng"), 2000 / scores.FEET_PER_METER).groupBy("project_id").agg(F.min("meters").alias("m"))
    return near.filter("m > 0").select("project_id", F.round(F.col("m") * scores.FEET_PER_METER, 2).alias("feet"))


@query(
    f"""WITH g AS (SELECT project_id, market_id, {_GRAMS.format("coalesce(address, '')")} AS ga, {_GRAMS.format("name")} AS gn FROM project),
       pair AS (SELECT s.project_id AS subject_id, p.project_id, {_SIMILAR.format("s.ga", "p.ga")} AS a, {_SIMILAR.format("s.gn", "p.gn")} AS n FROM g s JOIN g p ON s.market_id = p.market_id AND s.project_id <> p.project_id WHERE s.project_id % 100 = 0),
       total AS (SELECT subject_id, project_id, CASE WHEN a >= 0.12 THEN a ELSE 0 END + CASE WHEN n >= 0.12 THEN n ELSE 0 END AS total FROM pair WHERE a >= 0.12 OR n >= 0.12)
       SELECT subject_id, project_id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(total, 9) DESC, project_id) AS r FROM total) WHERE r <= 75""",
    "project",
)
def trigram_top75(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    subjects = project.filter("project_id % 100 = 0").withColumnRenamed("project_id", "subject_id")
    return op.top_similar(subjects, project, "subject_id", "project_id", ["address", "name"], ["market_id"]).withColumn("total", F.round("total", 6))


_TOKENS = "list_distinct(list_filter(string_split_regex(upper({0}), '[^A-Z0-9]+'), lambda t: len(t) > 2))"
_NUMBERED = "SELECT project_id, unnest([concat('apn:', project_id % 700), concat('vendor:', project_id % 900)]) AS n FROM project WHERE project_id % 3 <> 1"


@query(
    f"""WITH num AS ({_NUMBERED}), pair AS (SELECT s.project_id AS subject_id, p.project_id, s.address AS sa, p.address AS pa, s.developer AS sd, p.developer AS pd, s.units AS su, p.units AS pu, s.market_id = p.market_id AS near_market, {_HAVERSINE} AS m
         FROM project s JOIN project p ON s.project_id <> p.project_id WHERE s.project_id % 100 = 0),
       d AS (SELECT subject_id, project_id, array_to_string(list_filter([CASE WHEN m <= 1000 THEN 'nearby location' END, CASE WHEN len(list_intersect({_TOKENS.format("sa")}, {_TOKENS.format("pa")})) >= 3 THEN 'partial address' END, CASE WHEN su = pu THEN 'unit count' END], lambda x: x IS NOT NULL), ', ') AS why FROM pair WHERE near_market AND sd = pd)
       SELECT subject_id, project_id, 'address' AS name, 'exact address' AS detail FROM pair WHERE near_market AND sa = pa UNION ALL SELECT subject_id, project_id, 'geographic', 'within 250m' FROM pair WHERE m <= 250
       UNION ALL SELECT subject_id, project_id, 'developer', concat('developer plus ', why) FROM d WHERE why <> '' UNION ALL SELECT x.subject_id, x.project_id, 'identifier', a.n FROM pair x JOIN num a ON a.project_id = x.subject_id JOIN num b ON b.project_id = x.project_id AND b.n = a.n WHERE near_market""",
    "project",
)
def hard_signals(spark, sf_dir):
    """Hard agreements of subjects with all projects: identifiers, addresses, places, and developers with their second reasons."""
    (project,) = views(spark, sf_dir, "project")
    k = F.col("project_id")
    entry = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (k % n).cast("string").alias("value"))
    numbers = project.filter(k % 3 != 1).select("project_id", F.inline(F.array(entry("apn", 700), entry("vendor", 900))))
    subjects = k % 100 == 0
    return op.hard_signals(project.filter(subjects), project, numbers.filter(subjects), numbers)


@query()
def layered_dedup(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return op.layered_candidates(project.filter("project_id % 100 = 0"), project)


@query()
def layered_dedup_sweep(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    return op.layered_candidates(project, project, sweep=True)


@query(
    f"""WITH pair AS (SELECT s.project_id AS subject_id, p.project_id, CASE WHEN s.developer = p.developer THEN 0.4 ELSE 0 END + CASE WHEN s.jurisdiction_id = p.jurisdiction_id THEN 0.2 ELSE 0 END
         + CASE WHEN coalesce(abs(s.units - p.units) / nullif(greatest(s.units, p.units), 0) <= 0.25, FALSE) THEN 0.2 ELSE 0 END + CASE WHEN s.product_type = p.product_type THEN 0.05 ELSE 0 END
         + CASE WHEN abs(s.status_rank - p.status_rank) <= 1 THEN 0.05 ELSE 0 END + CASE WHEN {_HAVERSINE} <= 75 THEN 0.2 ELSE 0 END AS score
         FROM project s JOIN project p ON s.market_id = p.market_id AND s.developer = p.developer AND s.project_id <> p.project_id WHERE s.address IS NULL)
       SELECT subject_id, project_id, CAST(round(score, 6) AS DOUBLE) AS score FROM pair WHERE round(score, 6) >= 0.80""",
    "project",
)
def developer_fingerprint(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    cols = ["project_id", "market_id", "developer", "jurisdiction_id", "units", "product_type", "status_rank", "lat", "lng"]
    return op.fingerprint_pairs(project.filter("address IS NULL").select(*cols), project.select(*cols))


@query()
def fuzzy_name_join(spark, sf_dir):
    """Names of one market whose token-set ratio is at least 85, for subjects whose id is divisible by 100 against all rows."""
    (project,) = views(spark, sf_dir, "project")
    subjects = project.filter("project_id % 100 = 0").select(F.col("project_id").alias("subject_id"), "market_id", F.col("name").alias("wanted"))
    return op.similar_names(subjects, project.select("project_id", "market_id", "name"))


@query()
def project_search(spark, sf_dir):
    """The ten best projects for a search by name and developer."""
    (project,) = views(spark, sf_dir, "project")
    ratio = lambda c, q: text.token_set_ratio(c, F.lit(q))
    score = op.search_score(F.col("address").startswith("110 BRAND#7"), F.lit(0.0), ratio(F.col("name"), "small ring"), ratio(F.col("developer"), "Brand#7"), ratio(F.col("name"), "ring small plaza"), ratio(F.col("developer"), "brand 7"))
    return project.select("project_id", "name", score.alias("score")).filter("score >= 0.20").orderBy(F.desc("score"), "name", "project_id").limit(10)


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
       d AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 6) AS distance FROM q JOIN v ON q.vec_id <> v.vec_id)
       SELECT query_id, CAST(r AS INT) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM d) WHERE r <= 10"""
)
def vector_topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op.nearest_by_cosine(vectors.filter("vec_id % 100 = 0"), vectors, 10)


@query(
    """SELECT p.project_id, i.item_id AS item_id, CASE WHEN i.item_id IS NULL THEN 'none' WHEN i.item_type = 'field_change' THEN 'by_type' ELSE 'only' END AS how FROM project p LEFT JOIN (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE item_type WHEN 'field_change' THEN 0 WHEN 'new_candidate' THEN 1 ELSE 2 END, item_id) AS r FROM review_item) WHERE r = 1) i ON p.project_id = i.project_id""",
    "project", "review_item",
)
def reference_lateral_top1(spark, sf_dir):
    project, items = views(spark, sf_dir, "project", "review_item")
    rank = F.when(F.col("item_type") == "field_change", 0).when(F.col("item_type") == "new_candidate", 1).otherwise(2)
    best = first_row(items, ["project_id"], [rank, F.col("item_id")]).select("project_id", "item_id", "item_type")
    how = F.when(F.col("item_id").isNull(), "none").when(F.col("item_type") == "field_change", "by_type").otherwise("only")
    return project.select("project_id").join(best, "project_id", "left").select("project_id", "item_id", how.alias("how"))


@query(
    """SELECT o.item_id, coalesce(n, 0) AS n, coalesce(n_returned, 0) AS n_returned, n_name AS jurisdiction, r_name AS market FROM review_item o
         LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.item_id
         LEFT JOIN nation ON n_nationkey = o.jurisdiction_id LEFT JOIN region ON r_regionkey = n_regionkey""",
    "review_item",
)
def decision_counts_with_dimensions(spark, sf_dir):
    (items,) = views(spark, sf_dir, "review_item")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    # left to the planner: it broadcasts the dimensions where their size allows it
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("jurisdiction_id"), F.col("n_name").alias("jurisdiction"), F.col("r_name").alias("market"))
    rows = items.select("item_id", "jurisdiction_id").join(counts, "item_id", "left").na.fill(0, ["n", "n_returned"])
    return rows.join(places, "jurisdiction_id", "left").drop("jurisdiction_id")


@query(
    """SELECT o_orderkey AS article_id, n_refs, n_pending FROM orders o JOIN (SELECT l_orderkey, count(*) AS n_refs, count(*) FILTER (WHERE l_linestatus = 'O') AS n_pending FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
       WHERE n_pending > 0 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_returnflag = 'A') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = o_orderkey AND e.event_type = 'error')"""
)
def stranded_anti_joins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "article_id")
    refs = lines.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("l_linestatus") == "O").alias("n_pending")).filter("n_pending > 0")
    agent = lines.filter("l_returnflag = 'A'").select("article_id")
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("article_id"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"))
    return refs.join(known, "article_id", "left_semi").join(agent, "article_id", "left_anti").join(failed, "article_id", "left_anti")


@query(
    """WITH rel AS (SELECT l_orderkey AS a, l_partkey * 2 AS b FROM lineitem WHERE l_linenumber = 1)
       SELECT a, b, p.project_id AS from_project, q.project_id AS to_project, CASE WHEN p.project_id IS NULL AND q.project_id IS NULL THEN 'both' WHEN p.project_id IS NULL THEN 'from' WHEN q.project_id IS NULL THEN 'to' ELSE 'none' END AS unresolved
       FROM rel LEFT JOIN project p ON p.project_id = rel.a LEFT JOIN project q ON q.project_id = rel.b""",
    "project",
)
def relationship_resolution(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    rel = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 2).alias("b"))
    end = lambda key, name: project.select(F.col("project_id").alias(key), F.col("project_id").alias(name))
    out = rel.join(end("a", "from_project"), "a", "left").join(end("b", "to_project"), "b", "left")
    a, b = F.col("from_project").isNull(), F.col("to_project").isNull()
    return out.withColumn("unresolved", F.when(a & b, "both").when(a, "from").when(b, "to").otherwise("none"))


@query(
    """WITH o AS (SELECT evidence_id, source_type, CASE WHEN evidence_id % 4 = 0 THEN NULL ELSE project_id END AS owner, project_id AS target, evidence_id // 100 AS record FROM evidence)
       SELECT evidence_id, coalesce(owner, target) AS project_id, owner IS NULL AS linked, coalesce(bool_or(owner <> target) OVER (PARTITION BY record, source_type, target), FALSE) AS conflict FROM o""",
    "evidence",
)
def orphan_evidence_link(spark, sf_dir):
    (evidence,) = views(spark, sf_dir, "evidence")
    owner = F.when(F.col("evidence_id") % 4 != 0, F.col("project_id"))
    rows = evidence.select("evidence_id", "source_type", owner.alias("owner"), F.col("project_id").alias("target"), F.floor(F.col("evidence_id") / 100).alias("record"))
    keys = ["record", "source_type", "target"]
    conflict = rows.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("owner") != F.col("target")), F.lit(False)).alias("conflict"))
    return rows.join(conflict, keys).select("evidence_id", F.coalesce("owner", "target").alias("project_id"), F.col("owner").isNull().alias("linked"), "conflict")


@query(
    """SELECT c.c_custkey AS seed_id, p.project_id FROM customer c LEFT JOIN project p ON p.project_id = c.c_custkey AND p.address IS NOT NULL""",
    "project",
)
def seed_coverage_join(spark, sf_dir):
    (project,) = views(spark, sf_dir, "project")
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed_id"))
    return seeds.join(project.filter("address IS NOT NULL").select(F.col("project_id").alias("seed_id"), "project_id"), "seed_id", "left")
