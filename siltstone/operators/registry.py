"""The developer registry: canonical names by exact and similar names, and what the registry itself should not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import developer_name, legal_suffix_count, meaningful_tokens, token_set_ratio


def preference(name: Column, top_tier: Column) -> Column:
    """Orders names, the preferred first: fewer legal forms, fewer words, shorter, top tier, then by name."""
    words = F.size(F.filter(F.split(F.coalesce(developer_name(name), F.upper(name)), " "), lambda w: w != ""))
    return F.struct(legal_suffix_count(name).alias("s"), words.alias("w"), F.length(name).alias("n"), F.when(top_tier, 0).otherwise(1).alias("t"), F.lower(name).alias("c"))


def meaningful_overlap(a: Column, b: Column, least: float = 80.0) -> Column:
    """Whether two names share a meaningful token, or have tokens of four characters or more that are nearly equal.

    Nearly equal means an edit distance that allows a ratio of `least`, so that both sides
    of the exact test stay built-in.
    """
    x, y = meaningful_tokens(a), meaningful_tokens(b)
    return F.coalesce(F.arrays_overlap(x, y) | F.exists(x, lambda s: F.exists(y, lambda t: _near_tokens(s, t, least))), F.lit(False))


def _near_tokens(s: Column, t: Column, least: float = 80.0) -> Column:
    """Whether two tokens of four characters or more are nearly equal."""
    return (F.length(s) >= 4) & (F.length(t) >= 4) & (F.levenshtein(s, t) <= (1 - least / 100) * (F.length(s) + F.length(t)) / 2)


def _plain_tokens(name: str) -> Column:
    """A name's distinct meaningful tokens in order, to compare names by."""
    return F.array_sort(F.array_distinct(meaningful_tokens(F.col(name))))


def safe_alias(canonical: Column, alias: Column) -> Column:
    a, b = developer_name(canonical), developer_name(alias)
    return F.coalesce((a == b) | meaningful_overlap(canonical, alias), F.lit(False))


def registry_names(registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """(developer_id, canonical_name, top_tier, name, is_alias): every name of every developer."""
    own = registry.select("developer_id", "canonical_name", "top_tier", F.col("canonical_name").alias("name"), F.lit(False).alias("is_alias"))
    other = aliases.join(registry, "developer_id").select("developer_id", "canonical_name", "top_tier", F.col("alias").alias("name"), F.lit(True).alias("is_alias"))
    return own.unionByName(other)


def exact_matches(raw: DataFrame, names: DataFrame) -> DataFrame:
    """(raw_name, developer_id, canonical_name, match_type): the preferred developer of equal normal name."""
    left = raw.select("raw_name", developer_name(F.col("raw_name")).alias("_d")).filter("_d IS NOT NULL")
    right = names.select("*", developer_name(F.col("name")).alias("_d")).filter("_d IS NOT NULL")
    met = left.join(right, "_d").withColumn("_p", preference(F.col("canonical_name"), F.col("top_tier")))
    best = met.groupBy("raw_name").agg(F.min_by(F.struct("developer_id", "canonical_name", "is_alias"), F.struct("_p", "is_alias", "developer_id")).alias("b"))
    kind = F.when(F.col("b.is_alias") | (F.lower("b.canonical_name") != F.lower("raw_name")), "exact_alias").otherwise("exact_canonical")
    return best.select("raw_name", "b.developer_id", "b.canonical_name", kind.alias("match_type"))


def fuzzy_matches(raw: DataFrame, names: DataFrame, review: float = 75.0, auto: float = 90.0) -> DataFrame:
    """(raw_name, developer_id, canonical_name, match_type, score): the best similar name of each developer, then the best developer.

    Names meet by a meaningful token or by a run of three letters of one (tokens that are
    nearly equal share one), within which the overlap is tested; only pairs that pass reach
    the ratio. Of the developers that share a name, a canonical name and their tier, the one of
    least id stands for all; and distinct meaningful tokens and normal names are compared, so
    that a name costs the same however many rows bear it.
    """
    few = names.groupBy("name", "canonical_name", "top_tier").agg(F.min("developer_id").alias("developer_id"))
    bearers = few.select("*", _plain_tokens("name").alias("_y"), developer_name(F.col("name")).alias("_b"))
    asked = raw.select("raw_name", _plain_tokens("raw_name").alias("_x"), developer_name(F.col("raw_name")).alias("_a"))
    x, y = (rows.select(c, F.explode(c).alias(t)).distinct() for rows, c, t in ((asked, "_x", "_s"), (bearers, "_y", "_t")))
    runs = lambda t: F.when(F.length(t) >= 4, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array(t))
    keyed = lambda rows, t: rows.select(t).distinct().select(t, F.explode(F.array_distinct(runs(F.col(t)))).alias("_k"))
    alike = keyed(x, "_s").join(keyed(y, "_t"), "_k").filter((F.col("_s") == F.col("_t")) | _near_tokens(F.col("_s"), F.col("_t"))).select("_s", "_t").distinct()
    pairs = x.join(alike, "_s").join(y, "_t").select("_x", "_y").distinct()
    normal = asked.select("_x", "_a").distinct().join(pairs, "_x").join(bearers.select("_y", "_b").distinct(), "_y")
    scored = normal.select("_a", "_b").distinct().withColumn("score", F.round(token_set_ratio(F.col("_a"), F.col("_b")), 4)).filter(F.col("score") >= review)
    # the best score of a name's tokens and normal form comes first, so only bearers of it are ranked
    top = normal.select("_x", "_y", "_a", "_b").distinct().join(scored, ["_a", "_b"])
    best_score = F.max("score").over(Window.partitionBy("_x", "_a"))
    top = top.withColumn("_m", best_score).filter("score = _m").select("_x", "_a", "_y", "_b", "score")
    held = bearers.withColumn("_p", F.struct(preference(F.col("canonical_name"), F.col("top_tier")).alias("p"), "developer_id")).groupBy("_y", "_b").agg(F.min_by(F.struct("developer_id", "canonical_name"), "_p").alias("d"), F.min("_p").alias("_p"))
    won = top.join(held, ["_y", "_b"]).groupBy("_x", "_a", "score").agg(F.min_by("d", "_p").alias("d"))
    return asked.join(won, ["_x", "_a"]).select("raw_name", "d.developer_id", "d.canonical_name", F.when(F.col("score") >= auto, "fuzzy_auto").otherwise("fuzzy_review").alias("match_type"), "score")


def canonicalised(raw: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per distinct name: an exact match, else a similar one (sure, or for review), else a new entry under its own name."""
    names = registry_names(registry, aliases)
    todo = raw.filter("trim(raw_name) <> ''").select("raw_name").distinct()
    exact = exact_matches(todo, names).withColumn("score", F.lit(None).cast("double"))
    rest = todo.join(exact.select("raw_name"), "raw_name", "left_anti")
    fuzzy = fuzzy_matches(rest, names)
    new = rest.join(fuzzy.select("raw_name"), "raw_name", "left_anti").select("raw_name", F.lit(None).cast(registry.schema["developer_id"].dataType).alias("developer_id"), F.col("raw_name").alias("canonical_name"), F.lit("new_registry_entry").alias("match_type"), F.lit(None).cast("double").alias("score"))
    return exact.unionByName(fuzzy).unionByName(new)


def audited(registry: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """(developer_id, n_aliases, unsafe_aliases, unsafe_name) of developers of `least` aliases or more with an unsafe one, or an unsafe name."""
    both = aliases.join(registry, "developer_id")
    counts = both.groupBy("developer_id", "canonical_name").agg(F.count(F.lit(1)).alias("n_aliases"), F.count_if(~safe_alias(F.col("canonical_name"), F.col("alias"))).alias("unsafe_aliases"))
    unsafe = F.coalesce(F.size(meaningful_tokens(F.col("canonical_name"))) == 0, F.lit(True))
    return counts.filter(F.col("n_aliases") >= least).withColumn("unsafe_name", unsafe).filter("unsafe_aliases > 0 OR unsafe_name").drop("canonical_name")


def backfill(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, action) of distinct trimmed names: inserted, existing, or unsafe (no meaningful token)."""
    names = raw.select(F.trim("raw_name").alias("name")).filter("name <> ''").distinct()
    known = registry.select(developer_name(F.col("canonical_name")).alias("_d"), F.lit(True).alias("_k")).distinct()
    joined = names.withColumn("_d", developer_name(F.col("name"))).join(known, "_d", "left")
    safe = F.coalesce(F.size(meaningful_tokens(F.col("name"))) > 0, F.lit(False))
    return joined.select("name", F.when(F.col("_k"), "existing").when(safe, "inserted").otherwise("unsafe").alias("action"))
