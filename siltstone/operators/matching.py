"""Record matching: identifier, address, geographic, developer and similarity joins, and what is made of them.

Every join is an equi-join on a block: an identifier, an address, a grid cell, a developer's
normal name or a trigram within a market. Conditions joined by OR are unions of such joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scores, text
from siltstone.session import ensure_checkpoint_dir

METERS_PER_DEGREE = 111_194.9


def by_identifier(records: DataFrame, owned: DataFrame, record: str, keys: list[str], owner: str, single: float = 0.97, several: float = 0.70) -> DataFrame:
    """Per record with a hit: owner (the least of them), how many, the confidence and whether it is only possible."""
    rows = records.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(record)))
    # a key's owners are counted before the join, so a record of one key meets one row, however many own it
    counted = owned.groupBy(*keys).agg(F.min(owner).alias("owner"), F.countDistinct(owner).alias("owners"))
    one = rows.filter("_n = 1").join(counted.filter("owners > 0").hint("merge"), keys).select(record, "owner", "owners")
    more = rows.filter("_n > 1").join(owned.filter(F.col(owner).isNotNull()).select(*keys, F.col(owner).alias("_o")).distinct().hint("merge"), keys)
    hits = one.unionByName(more.groupBy(record).agg(F.min("_o").alias("owner"), F.countDistinct("_o").alias("owners")))
    return hits.withColumn("confidence", F.when(F.col("owners") == 1, single).otherwise(several)).withColumn("possible", F.col("owners") > 1)


def ladder(records: DataFrame, record: str, *steps: tuple[str, DataFrame]) -> DataFrame:
    """The first step that has a match for each record: step, owner, confidence, possible; step `none` without any."""
    out = records.select(record).distinct()
    for name, found in steps:
        out = out.join(found.select(record, F.struct(F.lit(name).alias("step"), "owner", "confidence", "possible").alias(f"_{name}")), record, "left")
    first = F.coalesce(*[F.col(f"_{name}") for name, _ in steps])
    return out.select(record, F.coalesce(first["step"], F.lit("none")).alias("step"), first["owner"].alias("owner"), first["confidence"].alias("confidence"), first["possible"].alias("possible"))


def by_address(records: DataFrame, projects: DataFrame, record: str, owner: str, market: str = "market_id", address: str = "address") -> DataFrame:
    """Equal canonical addresses of one market; addresses that end without a ZIP also meet those that add one, if none is equal."""
    want = records.filter(F.col(address).isNotNull()).select(record, market, address)
    have = projects.filter(F.col(address).isNotNull()).select(owner, market, address)
    equal = by_identifier(want, have, record, [market, address], owner, 0.90, 0.65)
    bare = have.filter(text.has_zip(F.col(address))).withColumn(address, F.regexp_replace(address, r" \d{5}$", ""))
    rest = want.filter(~text.has_zip(F.col(address))).join(equal.select(record), record, "left_anti")
    return equal.unionByName(by_identifier(rest, bare, record, [market, address], owner, 0.90, 0.65))


def dealt(left: DataFrame, right: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with `_part`: a row of the right is in one part, by its keys, one of the left in all, so that what many rows share is no single task."""
    return left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), right.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def classes(rows: DataFrame, columns: list[str], size: int = 4096) -> DataFrame:
    """Each combination of values of `columns` once, nulls too: `_c`, a number of it, `_n`, how many rows bear it, and `_k`, how many parts of `size` rows these make."""
    ensure_checkpoint_dir(rows.sparkSession)
    few = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    # written once, since the numbers are only the same for what is not computed again
    return few.select(*columns, F.monotonically_increasing_id().alias("_c"), "_n", F.ceil(F.col("_n") / size).cast("int").alias("_k")).checkpoint()


def members(rows: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with `_c` and `_part` of their class (see `classes`) in place of `columns`; the rows of a large class are dealt out to its parts."""
    others = [c for c in rows.columns if c not in columns]
    value = F.struct(*columns).alias("_v")
    return rows.select(*others, value).join(of.select(value, "_c", "_k"), "_v").select(*others, "_c", F.pmod(F.xxhash64(*others), F.col("_k")).cast("int").alias("_part"))


def borne(pairs: DataFrame, side: str, rows: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the rows of a side's classes in place of `<side>_c` and `<side>_k`."""
    keys = [f"{side}_c", "_part"]
    parts = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col(f"{side}_k") - 1))).drop(f"{side}_k")
    # few rows make many here, so they are dealt out by number: by their size they would go to few tasks
    tasks = max(8 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(tasks, *keys).join(members(rows, of, columns).withColumnRenamed("_c", f"{side}_c"), keys).drop(*keys)


def within_radius(left: DataFrame, right: DataFrame, meters: float, parts: int = 16) -> DataFrame:
    """Pairs of (lat, lng) at most `meters` apart, by a grid and the exact distance.

    Distinct points are compared, so a point costs the same however many rows lie at it; the
    right's points of a cell are dealt out to `parts` parts, and the rows of a point to parts
    of bounded size. The globe is cut into rows as high as the radius. Each row has a whole
    number of cells around the globe, as wide as the radius at its end nearer a pole or wider,
    so a point of the left meets three rows of cells, and of each the cells that its reach in
    longitude touches, also across the 180th meridian; next to a pole these are all (few)
    cells of the row. Longitudes are of -180 to 180 degrees.
    """
    high = meters / METERS_PER_DEGREE * (1 + 1e-9)
    row = lambda lat: F.floor((lat + 90) / high)
    edge = lambda y: F.least(F.lit(90.0), F.greatest(F.abs(y * high - 90), F.abs((y + 1) * high - 90)))
    cells = lambda y: F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge(y))) / high)).cast("long")
    column = lambda lng, n: F.pmod(F.floor((lng + 180) / (F.lit(360.0) / n)).cast("long"), n)
    spot = ["lat", "lng"]
    left, right = (rows.filter("lat IS NOT NULL AND lng IS NOT NULL") for rows in (left, right))
    of = classes(right, spot)
    l, r = dealt(classes(left, spot).select(*spot), of.select(*spot, F.col("_c").alias("_right_c"), F.col("_k").alias("_right_k")), spot, parts)
    l = l.withColumn("_y", F.explode(F.array(*[row(F.col("lat")) + i for i in (-1, 0, 1)]))).withColumn("_n", cells(F.col("_y")))
    # reach in degrees of longitude: exact for a cap of this radius, all around if it holds a pole
    angle = math.radians(high)
    sine = math.sin(angle) / F.cos(F.radians("lat"))
    reach = F.when((F.abs("lat") + high >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(sine)))
    first, last = (F.floor((F.col("lng") + 180 + side * reach) / (F.lit(360.0) / F.col("_n"))).cast("long") for side in (-1, 1))
    l = l.withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("_n") - 1)), lambda x: F.pmod(x, F.col("_n")))))).drop("_n")
    r = r.withColumn("_y", row(F.col("lat"))).withColumn("_x", column(F.col("lng"), cells(F.col("_y")))).withColumnsRenamed({"lat": "_lat", "lng": "_lng"})
    # a row of cells is as high as the radius, so latitudes tell most pairs apart before the distance is computed
    pairs = l.join(r, ["_y", "_x", "_part"]).filter(F.abs(F.col("lat") - F.col("_lat")) <= high).withColumn("meters", scores.haversine_meters(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")))
    near = pairs.filter(F.col("meters") <= meters).select(*spot, "_right_c", "_right_k", "meters")
    return borne(left.join(near, spot), "_right", right, of, spot)


def similar_texts(a: DataFrame, b: DataFrame, text_column: str, block: list[str], least: float, most_grams: int) -> DataFrame:
    """(block, _s, _p, similarity) of distinct texts of one block whose trigram Jaccard is at least `least`, by their shared trigrams."""

    def grams(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select(*block, F.coalesce(F.col(text_column), F.lit("")).alias(side)).distinct().withColumn("_g", text.trigrams(F.col(side)))
        return rows.select(*block, side, F.size("_g").alias(f"{side}n"), F.explode("_g").alias("_g"))

    s, p = grams(a, "_s"), grams(b, "_p")
    if s.count() <= most_grams:
        s = F.broadcast(s)
    shared = s.join(p, [*block, "_g"]).groupBy(*block, "_s", "_p", "_sn", "_pn").agg(F.count(F.lit(1)).alias("_n"))
    similarity = F.try_divide(F.col("_n").cast("double"), F.col("_sn") + F.col("_pn") - F.col("_n"))
    return shared.select(*block, "_s", "_p", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def top_similar(subjects: DataFrame, projects: DataFrame, subject: str, project: str, columns: list[str], block: list[str], most: int = 75, least: float = 0.12, most_grams: int = 500_000, ranked: str | None = None) -> DataFrame:
    """Per subject, the projects of its block of greatest summed similarity: the trigram Jaccard of each of two columns, where it is at least `least`.

    Distinct texts are compared. With one text of the first column and one of the second,
    only the first text's similarity tells projects apart, so of these only the classes
    (projects of the same two texts) that fewer than `most` + 1 projects precede can come into
    a result; what they add up to is ranked by class again, and of a class only its least ids
    are ranked by project. Projects that are similar by the second column alone come from one
    list for each of its texts: what precedes a project there also precedes it in the result.
    Distinct texts of up to `most_grams` trigrams in all are broadcast; more of them meet by
    block and trigram. The place of a project is kept in the column `ranked`, if given.
    """
    one, other = columns
    enough = most + 1  # a subject does not find itself
    texts = [F.coalesce(F.col(c), F.lit("")).alias(t) for c, t in ((one, "1"), (other, "2"))]
    keyed = lambda rows, key, side: rows.select(F.col(key), *block, *[t.alias(f"{side}{i}") for i, t in enumerate(texts, 1)])
    s, p = keyed(subjects, subject, "_s"), keyed(projects, project, "_p")
    first = similar_texts(subjects, projects, one, block, least, most_grams).withColumnsRenamed({"_s": "_s1", "_p": "_p1", "similarity": "_x"})
    second = similar_texts(subjects, projects, other, block, least, most_grams).withColumnsRenamed({"_s": "_s2", "_p": "_p2", "similarity": "_y"})
    asked = s.select(*block, "_s1", "_s2").distinct()
    borne_by = p.groupBy(*block, "_p1", "_p2").agg(F.count(F.lit(1)).alias("_n"))
    leasts = lambda keys, n: p.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(project))).filter(F.col("_i") <= n).drop("_i")

    def foremost(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        """Rows that fewer than `enough` projects surely precede: steps of two billionths keep those apart that rounding might not."""
        step = F.round(-F.col(value) * 1_000_000_000).cast("long")
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_o").rangeBetween(Window.unboundedPreceding, -3))
        return rows.withColumn("_o", step).withColumn("_before", before).filter(F.coalesce(F.col("_before"), F.lit(0)) < enough).drop("_o", "_before")

    by_first = foremost(first.join(borne_by, [*block, "_p1"]), [*block, "_s1", "_p2"], "_x")
    both = asked.join(by_first, [*block, "_s1"]).join(second, [*block, "_s2", "_p2"], "left").withColumn("total", F.col("_x") + F.coalesce("_y", F.lit(0.0)))
    both = foremost(both, [*block, "_s1", "_s2"], "total").join(leasts([*block, "_p1", "_p2"], enough), [*block, "_p1", "_p2"])
    place = lambda keys, value: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(value, 9)), project))
    by_second = second.join(leasts([*block, "_p2"], enough), [*block, "_p2"]).withColumn("_i", place([*block, "_s2"], "_y")).filter(F.col("_i") <= enough)
    by_second = asked.join(by_second, [*block, "_s2"]).withColumn("total", F.col("_y"))
    columns_kept = [*block, "_s1", "_s2", project]
    # a project's whole total is at least the one by its second column alone
    scored = both.select(*columns_kept, "total").unionByName(by_second.select(*columns_kept, "total")).groupBy(*columns_kept).agg(F.max("total").alias("total")).filter("total > 0")
    best = scored.withColumn("_r", place([*block, "_s1", "_s2"], "total")).filter(F.col("_r") <= enough).drop("_r")
    found = s.join(best, [*block, "_s1", "_s2"]).filter(F.col(subject) != F.col(project)).select(subject, project, "total")
    found = found.withColumn("_r", place([subject], "total")).filter(F.col("_r") <= most)
    return found.withColumnRenamed("_r", ranked) if ranked else found.drop("_r")


def address_tokens(c: Column) -> Column:
    """Tokens of more than two characters."""
    return F.filter(F.split(F.upper(c), "[^A-Z0-9]+"), lambda t: F.length(t) > 2)


def compared(rows: DataFrame, prefix: str) -> DataFrame:
    """The columns that agreements and `likelihood` compare, with a prefix, of `classes`; what depends on one side alone is computed here, once a class and not once a pair."""
    columns = ["_c", "_n", "_k", "market_id", "address", "developer", "units", "lat", "lng", *[c for c in ("numbers",) if c in rows.columns]]
    known = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    # three letters or digits are a number of 24 bits, which is cheaper to compare than a text
    grams = lambda c: F.transform(text.trigrams(F.col(c)), lambda g: F.conv(F.hex(g), 16, 10).cast("long"))
    made = {
        "developer_name": text.developer_name(F.col("developer")), "tokens": address_tokens(F.col("address")), "type": scores.product_type(F.col("product_type")), "address_grams": grams("address"), "has_address": known("address"), "has_developer": known("developer"),
        **({"name_grams": grams("name"), "has_name": known("name")} if "name" in rows.columns else {}),
    }
    return rows.select(*[F.col(c).alias(f"{prefix}{c.removeprefix('_')}") for c in columns], *[m.alias(f"{prefix}{n}") for n, m in made.items()])


def with_alike_developers(s: DataFrame, p: DataFrame, least: float = 85.0) -> DataFrame:
    """The subjects with `s_alike`, the normal names of projects' developers that are similar to their own but not equal; distinct names are compared."""
    a = s.select("s_developer_name").distinct().filter("s_developer_name IS NOT NULL")
    b = p.select("p_developer_name").distinct().filter("p_developer_name IS NOT NULL")
    met = a.crossJoin(b).filter("s_developer_name <> p_developer_name").filter(text.token_set_ratio(F.col("s_developer_name"), F.col("p_developer_name")) >= least)
    return s.join(met.groupBy("s_developer_name").agg(F.collect_set("p_developer_name").alias("s_alike")), "s_developer_name", "left")


def likelihood(s: str, p: str) -> Column:
    """Weighted agreement of a subject's columns (prefix s) and a project's (prefix p), both made by `compared`; the subject's with `with_alike_developers`."""
    names = ["lat", "lng", "address_grams", "has_address", "developer_name", "has_developer", "name_grams", "has_name", "units", "type"]
    pair = F.struct(*[F.col(f"{side}{n}") for side in (s, p) for n in names], F.col(f"{s}alike"))

    def score(r: Column) -> Column:
        c = lambda side, name: r[f"{side}{name}"]
        distance = scores.haversine_meters(c(s, "lat"), c(s, "lng"), c(p, "lat"), c(p, "lng"))
        developer = F.when(c(s, "developer_name") == c(p, "developer_name"), 1.0).when(F.array_contains(c(s, "alike"), c(p, "developer_name")), 0.7).otherwise(0.0)
        return scores.weighted_likelihood({
            "geographic": (text.bound(distance, lambda m: scores.proximity(m)), c(s, "lat").isNotNull() & c(s, "lng").isNotNull()),
            "address": (text.set_similarity(c(s, "address_grams"), c(p, "address_grams")), c(s, "has_address")),
            "developer": (developer, c(s, "has_developer")),
            "name": (text.set_similarity(c(s, "name_grams"), c(p, "name_grams")), c(s, "has_name")),
            "units": (scores.unit_proximity(c(s, "units"), c(p, "units")), c(s, "units").isNotNull()),
            "product_type": (scores.same_type_score(c(s, "type"), c(p, "type")), c(s, "type").isNotNull()),
        })

    # bound to one value, the terms are not written out into one method too long for the JVM to compile
    return text.bound(pair, score)


def agreements(s: DataFrame, p: DataFrame, *kept: Column, numbers: bool = False) -> DataFrame:
    """(name, detail, kept...) of hard agreements of `compared` classes: address, geographic (250 m), developer with a second reason, and numbers if both sides hold them.

    A pair of classes comes once for each kind (with numbers: for each number). What is kept
    is made where both sides' columns are at hand, so pairs are never exchanged with them.
    """
    one = lambda pairs, name, detail: pairs.select(F.lit(name).alias("name"), detail.alias("detail"), *kept)
    address = s.join(p, (F.col("s_market_id") == F.col("p_market_id")) & (F.col("s_address") == F.col("p_address")))
    spots = lambda rows, side: rows.withColumns({"lat": F.col(f"{side}_lat"), "lng": F.col(f"{side}_lng")})
    near = within_radius(spots(s, "s"), spots(p, "p"), 250.0)
    distance = scores.haversine_meters(F.col("s_lat"), F.col("s_lng"), F.col("p_lat"), F.col("p_lng"))
    reasons = F.array_compact(F.array(
        F.when(distance <= 1000, "nearby location"), F.when(F.lower("s_type") == F.lower("p_type"), "product type"),
        F.when(F.size(F.array_intersect("s_tokens", "p_tokens")) >= 3, "partial address"), F.when(F.col("s_units") == F.col("p_units"), "unit count"),
    ))
    named = lambda rows, side: rows.withColumn("_d", F.col(f"{side}_developer_name")).withColumn("_m", F.col(f"{side}_market_id"))
    by_name, of_name = dealt(named(s, "s"), named(p, "p"), ["p_c"], 16)
    same = by_name.join(of_name, ["_d", "_m", "_part"]).withColumn("_why", reasons).filter(F.size("_why") > 0)
    found = one(address, "address", F.lit("exact address")).unionByName(one(near, "geographic", F.lit("within 250m")))
    found = found.unionByName(one(same, "developer", F.concat(F.lit("developer plus "), F.array_join("_why", ", "))))
    if numbers:
        of = lambda rows, side: rows.withColumn("_number", F.explode(f"{side}_numbers")).withColumn("_m", F.col(f"{side}_market_id"))
        found = found.unionByName(one(of(s, "s").join(of(p, "p"), ["_number", "_m"]), "identifier", F.col("_number")))
    return found


def hard_signals(subjects: DataFrame, projects: DataFrame, subject_numbers: DataFrame | None = None, project_numbers: DataFrame | None = None) -> DataFrame:
    """(subject_id, project_id, name, detail) of hard agreements: identifier, address, geographic (250 m) and developer with a second reason.

    Numbers are (project_id, kind, value); only those of one market count. A pair of equal developers
    needs at least one of: within 1 km, equal type, three shared address tokens, equal units; its
    detail names all that hold. Every signal is said once: where ids, and their numbers, come once,
    so do signals, and pairs need no exchange to drop others. Rows that are equal in all that
    counts are a class, and classes are compared; a row's pairs are made last, of those of its class.
    """
    columns = ["market_id", "address", "developer", "units", "product_type", "lat", "lng"]
    once = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1").isEmpty()
    s_of, p_of = classes(subjects, columns), classes(projects, columns)
    pairs = agreements(compared(s_of, "s_"), compared(p_of, "p_"), *[F.col(c) for c in ("s_c", "s_k", "p_c", "p_k")])
    side = lambda rows, key: rows.select(F.col("project_id").alias(key), *columns)
    found = borne(borne(pairs, "s", side(subjects, "subject_id"), s_of, columns), "p", side(projects, "project_id"), p_of, columns)
    found = found.select("subject_id", "project_id", "name", "detail")
    unique = once(subjects, "project_id") and once(projects, "project_id")
    if subject_numbers is not None and project_numbers is not None:
        of = lambda numbers, rows, key: numbers.join(rows.select("project_id", "market_id"), "project_id").select(F.col("project_id").alias(key), "kind", "value", "market_id")
        number = F.concat_ws(":", "kind", "value")
        met = of(subject_numbers, subjects, "subject_id").join(of(project_numbers, projects, "project_id"), ["kind", "value", "market_id"])
        found = found.unionByName(met.select("subject_id", "project_id", F.lit("identifier").alias("name"), number.alias("detail")))
        unique = unique and all(once(n.select("project_id", number.alias("n")), "project_id", "n") for n in (subject_numbers, project_numbers))
    found = found.filter("subject_id <> project_id")
    return found if unique else found.distinct()


def layered_candidates(subjects: DataFrame, projects: DataFrame, limit: int = 25, sweep: bool = False, sweep_limit: int = 100, numbers: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """Per subject, projects in layers: 1 hard agreement, 2 similar text, 3 (if asked for) all near or similar ones.

    Hard: see `hard_signals`, which may have the numbers of both sides. A later layer leaves out the earlier ones,
    and is searched only for subjects whose hard agreements leave a place for it.
    Ordered by layer, likelihood and id. Both tables: project_id, market_id, address, name,
    developer, units, product_type, lat, lng.

    Rows that are equal in all that counts are a class, and classes are compared. Of a
    class's pairs those are left out that more rows precede than a subject has places; of
    the others' projects the least ids are ranked, once for all subjects of the class.
    """
    most = sweep_limit if sweep else limit
    enough = most + 1  # a subject does not find itself
    columns = ["market_id", "address", "name", "developer", "units", "product_type", "lat", "lng"]
    numbered = all(n is not None for n in numbers)
    if numbered:
        kept = lambda n: n.groupBy("project_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("numbers"))
        subjects, projects = (rows.join(kept(n), "project_id", "left") for rows, n in zip((subjects, projects), numbers, strict=True))
        columns = [*columns, "numbers"]
    s_of, p_of = classes(subjects, columns), classes(projects, columns)
    p = compared(p_of, "p_")
    s = with_alike_developers(compared(s_of, "s_"), p)
    score = F.round(likelihood("s_", "p_"), 6).alias("likelihood")
    ids = [F.col(c) for c in ("s_c", "p_c", "p_n")]
    by_class = Window.partitionBy("s_c").orderBy("layer", F.desc("likelihood"))
    hard = agreements(s, p, *ids, F.lit(1).alias("layer"), score, numbers=numbered).drop("name", "detail")
    if not numbered:
        # a pair comes once for each of three kinds, so those that so many precede need not be exchanged
        hard = hard.withColumn("_r", F.rank().over(by_class)).filter(F.col("_r") <= 3 * enough).drop("_r")
    hard = hard.distinct().checkpoint()
    full = hard.groupBy("s_c").agg(F.sum("p_n").alias("_n")).filter(F.col("_n") >= enough).select("s_c")
    s_rows = members(subjects.select(F.col("project_id").alias("s_project_id"), *columns), s_of, columns).withColumnRenamed("_c", "s_c").drop("_part")
    p_rows = members(projects.select(F.col("project_id").alias("p_project_id"), *columns), p_of, columns).withColumnRenamed("_c", "p_c").drop("_part")
    s_rest = s.join(full, "s_c", "left_anti")
    rest = s_rows.join(s_of.select(F.col("_c").alias("s_c"), *columns).join(full, "s_c", "left_anti"), "s_c")
    # the similar ones of the second layer come first among those of the third, so all are found in one pass
    similar = top_similar(rest, projects.withColumnRenamed("project_id", "p_project_id"), "s_project_id", "p_project_id", ["address", "name"], ["market_id"], max(75, sweep_limit) if sweep else 75, ranked="_r")
    layer = F.when(F.col("_r") <= 75, 2).when(F.lit(sweep) & (F.col("_r") <= sweep_limit), 3)
    similar = similar.select("s_project_id", "p_project_id", layer.alias("layer")).filter("layer IS NOT NULL").join(s_rows, "s_project_id").join(p_rows, "p_project_id")
    met = similar.select("s_c", "p_c").distinct().join(s_rest, "s_c").join(p, "p_c").select("s_c", "p_c", score)
    similar = similar.join(met, ["s_c", "p_c"]).select("s_project_id", "p_project_id", "layer", "likelihood")
    pairs = hard
    if sweep:
        spots = lambda rows, side: rows.withColumns({"lat": F.col(f"{side}_lat"), "lng": F.col(f"{side}_lng")})
        pairs = pairs.unionByName(within_radius(spots(s_rest, "s"), spots(p, "p"), 1000.0).select(*ids, F.lit(3).alias("layer"), score))
        pairs = pairs.groupBy("s_c", "p_c", "p_n", "likelihood").agg(F.min("layer").alias("layer"))
    pairs = pairs.withColumn("_r", F.rank().over(by_class)).filter(F.col("_r") <= enough)
    peers = F.sum("p_n").over(Window.partitionBy("s_c", "layer", "likelihood"))
    pairs = pairs.withColumn("_before", F.sum("p_n").over(by_class) - peers).filter(F.col("_before") < enough)
    few = p_rows.withColumn("_i", F.row_number().over(Window.partitionBy("p_c").orderBy("p_project_id"))).filter(F.col("_i") <= enough).drop("_i")
    order = ["layer", F.desc("likelihood"), "p_project_id"]
    best = pairs.join(few, "p_c").withColumn("_r", F.row_number().over(Window.partitionBy("s_c").orderBy(*order))).filter(F.col("_r") <= enough)
    found = s_rows.join(best, "s_c").select("s_project_id", "p_project_id", "layer", "likelihood").unionByName(similar).filter("s_project_id <> p_project_id")
    found = found.groupBy("s_project_id", "p_project_id").agg(F.min("layer").alias("layer"), F.max("likelihood").alias("likelihood"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("s_project_id").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select(F.col("s_project_id").alias("subject_id"), F.col("p_project_id").alias("project_id"), "layer", "likelihood", "rank")


def fingerprint_score(developer: Column, place: Column, units: Column, kind: Column, stories: Column, near: Column) -> Column:
    """Agreement without an address: developer .40, neighbourhood .20, units .20, type .05, stories .05, 75 m .20."""
    weights = ((developer, 0.40), (place, 0.20), (units, 0.20), (kind, 0.05), (stories, 0.05), (near, 0.20))
    return F.round(sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in weights), F.lit(0.0)), 6)


def fingerprint_pairs(subjects: DataFrame, projects: DataFrame, least: float = 0.80) -> DataFrame:
    """(subject_id, project_id, score) of rows of one market and developer whose fingerprint scores `least` (0.80) or more.

    Both sides have project_id, market_id, developer, jurisdiction_id, units, product_type,
    status_rank, lat and lng. Such a score needs two of place, units and 75 m, so pairs are
    sought by place and units, or by a cell of the grid; other rows of a developer never meet.
    Units within a quarter lie in steps of a third that are equal or next to each other.
    """
    if least < 0.75:
        raise ValueError("below 0.75 a pair may have less than two of place, units and nearness")
    c, block = F.col, ["market_id", "developer"]
    step = F.when(c("units") > 0, F.floor(F.log(c("units").cast("double")) / math.log(1.34))).when(c("units") < 0, F.lit(-1_000_000)).cast("long")
    named = {x: f"s_{x}" for x in projects.columns if x not in block}
    s = subjects.select(*projects.columns).withColumnsRenamed(named)
    fits = scores.within_share(c("s_units"), c("units"))
    here = F.coalesce(c("s_jurisdiction_id") == c("jurisdiction_id"), F.lit(False))
    near = scores.within_meters(c("s_lat"), c("s_lng"), c("lat"), c("lng"))
    side = s.withColumnsRenamed({"s_units": "units"}).withColumn("_step", step).withColumnRenamed("units", "s_units")
    side = side.withColumn("_step", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: c("_step") + i))).withColumn("jurisdiction_id", c("s_jurisdiction_id"))
    by_units = side.join(projects.withColumn("_step", step), [*block, "jurisdiction_id", "_step"]).filter(fits).drop("_step")
    # the grid is as high as the radius in latitude, which is enough to part the rows of one developer
    high = 75.0 / METERS_PER_DEGREE * (1 + 1e-6)
    band = F.floor((c("lat") + 90) / high)
    rows = s.withColumn("_y", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor((c("s_lat") + 90) / high) + i)))
    by_cell = rows.join(projects.withColumn("_y", band), [*block, "_y"]).filter(near & (fits | here) & ~(fits & here)).drop("_y")
    score = fingerprint_score(F.lit(True), here, fits, c("s_product_type") == c("product_type"), scores.within_one(c("s_status_rank"), c("status_rank")), near)
    pairs = by_units.unionByName(by_cell).filter(c("s_project_id") != c("project_id"))
    return pairs.select(c("s_project_id").alias("subject_id"), "project_id", score.alias("score")).filter(c("score") >= least)


def search_score(address: Column, text_score: Column, name: Column, developer: Column, query_name: Column, query_developer: Column) -> Column:
    """Sum of what each agreement is worth, 1 at most; scores are ratios of 0 to 100."""
    step = lambda c, *steps: F.coalesce(*[F.when(c >= low, value) for low, value in steps], F.lit(0.0))
    place = F.when(F.coalesce(address, F.lit(False)), 0.72).otherwise(step(text_score, (92, 0.45)))
    total = place + step(name, (95, 0.22), (85, 0.14)) + step(developer, (95, 0.12), (88, 0.07)) + step(query_name, (90, 0.08)) + step(query_developer, (92, 0.05))
    return F.round(F.least(F.lit(1.0), total), 6)


def similar_names(subjects: DataFrame, projects: DataFrame, least: float = 85.0, parts: int = 32) -> DataFrame:
    """(subject_id, project_id, ratio) of names of one market whose token-set ratio is at least `least`.

    `subjects` (subject_id, market_id, wanted) is a stated set of queries, met by all rows
    (project_id, market_id, name) of its market. Distinct names are compared, so that names
    borne by many rows cost one comparison; the rows of a name are dealt out to `parts` parts,
    each of which meets its subjects, so that a common name is no single task. Names without
    a common token need lengths whose ratio allows the wanted similarity; others never reach
    the Python function.
    """
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    plain = lambda c: F.array_join(F.array_sort(F.array_distinct(tokens(c))), " ")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("_p")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p")
    # the ratio of two names is that of their sorted distinct tokens, so each pair of these is compared once
    s = subjects.select("subject_id", "market_id", plain(F.col("wanted")).alias("_a")).filter("_a <> ''")
    p = projects.select("project_id", "market_id", plain(F.col("name")).alias("_b")).filter("_b <> ''")
    a = s.select("market_id", "_a").distinct().select("market_id", "_a", F.split("_a", " ").alias("_t"), F.length("_a").alias("_n"), every)
    b = p.select("market_id", "_b").distinct().select("market_id", "_b", F.split("_b", " ").alias("_u"), F.length("_b").alias("_m"), part("_b"))
    share = least / 100
    possible = F.arrays_overlap("_t", "_u") | (F.least("_n", "_m") * (2 - share) >= F.greatest("_n", "_m") * share)
    ratio = F.round(text.token_set_ratio(F.col("_a"), F.col("_b")), 4)
    alike = a.join(b, ["market_id", "_p"]).filter(possible).select("market_id", "_a", "_b", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    # a subject first meets the names that are like its own, then their rows, part by part
    wanted = s.join(alike, ["market_id", "_a"]).select("subject_id", "market_id", "_b", "ratio", every)
    rows = p.select("project_id", "market_id", "_b", part("project_id"))
    return wanted.join(rows, ["market_id", "_b", "_p"]).filter(F.col("subject_id") != F.col("project_id")).select("subject_id", "project_id", "ratio")


def nearest_by_cosine(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 1024, vector_block: int = 4096) -> DataFrame:
    """Each query's k vectors of least cosine distance (to six places), ties to smaller ids; a query does not find its own id.

    Queries and vectors are dealt out to blocks of bounded size, and every block of queries
    meets every block of vectors: a set of queries of any size against all rows, nothing of
    which is broadcast. Each meeting gives a query's k best, so the last step ranks k rows
    for each block. Vectors that are null, empty, without length, or hold nulls take no part.
    """

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        good = rows.filter(F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0))
        n = max(1, -(-good.count() // size))
        dealt = good.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return dealt.groupBy(name, F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "v")).alias("r")).select(name, "dim", F.col("r.id").alias(f"{name}_ids"), F.flatten("r.v").alias(f"{name}_v"))

    def meet(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                q, c = (np.asarray(row[f"{x}_v"]).reshape(len(row[f"{x}_ids"]), -1) for x in ("q", "c"))
                q_ids, c_ids = np.asarray(row["q_ids"]), np.asarray(row["c_ids"])
                order = np.argsort(c_ids, kind="stable")
                c, c_ids = c[order], c_ids[order]
                distance = np.round(1 - (q @ c.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]), 6)
                distance[q_ids[:, None] == c_ids[None, :]] = np.inf
                # the k-th distance of each query, what is not beyond it, and of these the k first by (distance, id)
                worst = np.partition(distance, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
                at, column = np.nonzero((distance <= worst[:, None]) & np.isfinite(distance))
                near = distance[at, column]
                order = np.lexsort((column, near, at))
                place = np.arange(len(at)) - np.searchsorted(at, at)  # rows are in order, so this is the place within the query
                best = order[place < k]
                yield pd.DataFrame({"query_id": q_ids[at[best]], "id": c_ids[column[best]], "distance": near[best]})

    pairs = blocks(queries, query_block, "q").join(blocks(vectors, vector_block, "c"), "dim").mapInPandas(meet, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")
