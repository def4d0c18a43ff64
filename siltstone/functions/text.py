"""Text, name, identifier and address normalisers as column expressions.

All take and return columns, stay in generated code and give null for null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.functions import fixed


def mapped(key: Column, table: dict, default: Column | None = None) -> Column:
    """`table[key]`, or `default` (null if not given) where the key is not in it."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, however often `make` names it: an expression named twice is computed twice."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def clean_text(c: Column) -> Column:
    """Trimmed, with '' and '--' as null."""
    t = F.trim(c)
    return F.when(~t.isin("", "--"), t)


def clean_identifier(c: Column) -> Column:
    """Clean text; a number without fraction as integer text."""
    t = clean_text(c)
    number = F.when(t.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", ""))
    return F.coalesce(number, t)


def parse_float(c: Column) -> Column:
    """A double without thousands separators and percent sign; null where it is none."""
    return F.regexp_replace(clean_text(c), "[,%]", "").try_cast("double")


def parse_int(c: Column) -> Column:
    """The nearest integer, halves to even."""
    return F.bround(parse_float(c), 0).cast("long")


def state_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(F.length(t) == 2, t).otherwise(mapped(t, fixed.STATES, t))


def zip_code(c: Column) -> Column:
    """The first five digits in a row."""
    return F.nullif(F.regexp_extract(c, r"(\d{5})", 1), F.lit(""))


def city_name(c: Column, market: str) -> Column:
    t = F.upper(F.trim(c))
    aliases = fixed.CITY_ALIASES.get(market)
    return mapped(t, aliases, t) if aliases else t


def house_range(c: Column) -> Column:
    """struct(low, high) of `a-b` or a number; null otherwise."""
    t = F.trim(c)
    a, b = (F.regexp_extract(t, r"^(\d+)\s*-\s*(\d+)$", i).try_cast("long") for i in (1, 2))
    one = F.when(t.rlike(r"^\d+$"), t.cast("long"))
    low, high = F.coalesce(F.least(a, b), one), F.coalesce(F.greatest(a, b), one)
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def has_zip(c: Column) -> Column:
    return c.rlike(r" \d{5}$")


def street_token(t: Column) -> Column:
    """An ordinal word as number; anything else as it is."""
    return mapped(t, fixed.ORDINALS, t)


def loose_street_line(c: Column) -> Column:
    """Upper case, punctuation blank, and every token expanded by the direction, suffix and ordinal tables."""
    tokens = F.filter(F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9#-]+", " "), " "), lambda t: t != "")
    table = {**fixed.ORDINALS, **fixed.SUFFIXES, **fixed.DIRECTIONS}
    return F.array_join(F.transform(tokens, lambda t: mapped(t, table, t)), " ")


def address_parts(c: Column, city: Column | None = None, state: Column | None = None, market: str = "") -> Column:
    """struct(street, unit, city, state, zip, canonical) of a comma-separated address.

    The first segment is the street: its direction may be the first or second token, its
    suffix the last. A segment that begins as a unit is one; so is a unit at the end of the
    street segment. Of the others, the last with a state or ZIP gives these, and the one
    before it the city, unless they are given.
    """
    segments = F.filter(F.transform(F.split(F.upper(c), ","), lambda s: F.trim(s)), lambda s: s != "")
    unit_pattern = rf"^({fixed.UNIT_WORDS})\b.*"
    is_unit = lambda s: s.rlike(unit_pattern) | s.startswith("#")

    def parted(segments: Column) -> Column:
        first, rest = F.get(segments, F.lit(0)), F.slice(segments, 2, 1000)
        inline_unit = F.regexp_extract(first, rf"\s((?:{fixed.UNIT_WORDS})\b?\s*[A-Z0-9-]+)$", 1)
        street_raw = F.regexp_replace(first, rf"\s(?:{fixed.UNIT_WORDS})\b?\s*[A-Z0-9-]+$", "")
        tokens = F.filter(F.split(F.regexp_replace(street_raw, r"[^A-Z0-9#-]+", " "), " "), lambda t: t != "")
        return F.struct(inline_unit.alias("inline"), tokens.alias("tokens"), F.get(F.filter(rest, is_unit), F.lit(0)).alias("unit"), F.filter(rest, lambda s: ~is_unit(s)).alias("places"))

    def placed(x: Column) -> Column:
        last = F.get(x["places"], F.size(x["places"]) - 1)
        state_zip = last.rlike(r"^[A-Z]{2}(\s+\d{5}(-\d{4})?)?$|^\d{5}(-\d{4})?$")
        unit = F.coalesce(x["unit"], F.when(x["inline"] != "", x["inline"]))
        return F.struct(x["tokens"].alias("tokens"), F.size(x["tokens"]).alias("n"), unit.alias("unit"), last.alias("last"), F.get(x["places"], F.size(x["places"]) - 2).alias("before"), state_zip.alias("coded"))

    def read(x: Column) -> Column:
        def expand(t: Column, i: Column) -> Column:
            plain = street_token(t)
            with_suffix = F.when((i == x["n"] - 1) & (i > 0), mapped(t, fixed.SUFFIXES, plain)).otherwise(plain)
            return F.when(i.isin(0, 1) & (i < x["n"] - 1), mapped(t, fixed.DIRECTIONS, with_suffix)).otherwise(with_suffix)

        found_state = F.when(x["coded"], F.nullif(F.regexp_extract(x["last"], r"^([A-Z]{2})\b", 1), F.lit("")))
        found_city = F.when(x["coded"], x["before"]).otherwise(x["last"])
        city_out = bound(F.coalesce(city if city is not None else F.lit(None).cast("string"), found_city), lambda v: city_name(v, market))
        state_out = F.coalesce(state_code(state) if state is not None else F.lit(None).cast("string"), found_state)
        line = F.array_join(F.transform(x["tokens"], expand), " ")
        return F.struct(line.alias("street"), x["unit"].alias("unit"), city_out.alias("city"), state_out.alias("state"), F.when(x["coded"], zip_code(x["last"])).alias("zip"))

    def named(x: Column) -> Column:
        street = F.when(x["street"] != "", x["street"])
        canonical = F.when(x["street"] != "", F.concat_ws(" ", x["street"], x["city"], x["state"], x["zip"]))
        return F.struct(street.alias("street"), *[x[f].alias(f) for f in ("unit", "city", "state", "zip")], canonical.alias("canonical"))

    return bound(bound(bound(bound(segments, parted), placed), read), named)


#: What the token walk has read: phase 0 wants a house number, 1 a name up to its suffix, 2 what follows, 3 comes after a state, 4 after a ZIP, 5 wants a unit's number, 9 is no address.
_WALK = "struct<phase:int,house:string,direction:string,name:array<string>,suffix:string,last:string,post:string,unit:string,city:array<string>,state:string,zip:string>"


def walked_address(c: Column) -> Column:
    """What a walk over an address's words finds, without regard to commas; see `_WALK`.

    A direction counts right before or after the name, as the first or second word behind the
    number; a suffix ends the name, and one that another follows belongs to it.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9#-]+", " "), " "), lambda t: t != "")
    words = F.array(*[F.lit(w) for w in fixed.UNIT_WORDS.split("|")])
    tags = F.transform(tokens, lambda t: F.struct(
        t.alias("t"), street_token(t).alias("plain"), mapped(t, fixed.SUFFIXES).alias("suffix"), mapped(t, fixed.DIRECTIONS).alias("direction"), t.rlike(r"^\d+[A-Z]?(-\d+)?$").alias("house"),
        t.rlike(r"^\d{5}(-\d{4})?$").alias("zip"), t.isin(*fixed.STATES.values()).alias("state"), (F.array_contains(words, t) | t.rlike("^#.")).alias("unit"), t.rlike("^#.").alias("whole"),
    ))

    def step(s: Column, x: Column) -> Column:
        phase, empty, t = s["phase"], F.array().cast("array<string>"), x["t"]
        suffix, direction = x["suffix"], x["direction"]
        is_zip, is_state, is_unit = x["zip"], x["state"], x["unit"]
        naming, behind, stated = phase == 1, phase == 2, phase == 3
        named = F.size(s["name"]) > 0
        turned = naming & direction.isNotNull() & ~named & s["direction"].isNull()
        open_ = behind & (F.size(s["city"]) == 0) & s["unit"].isNull()
        again = open_ & suffix.isNotNull() & s["post"].isNull()
        after = open_ & direction.isNotNull() & s["post"].isNull() & suffix.isNull()
        seen = F.struct(((phase == 0) & x["house"]).alias("begins"), turned.alias("turned"), (naming & ~turned & suffix.isNotNull() & (named | s["direction"].isNotNull())).alias("ends"), again.alias("again"), after.alias("after"))

        def placed(f: Column) -> Column:
            coded = (behind | stated) & is_zip
            stating, united = (behind | stated) & is_state & ~is_zip & ~f["after"], behind & is_unit & ~f["again"]
            other = (behind | stated) & ~coded & ~stating & ~united & ~f["again"] & ~f["after"]
            return F.struct(*[f[n].alias(n) for n in ("begins", "turned", "ends", "again", "after")], coded.alias("coded"), stating.alias("stating"), united.alias("united"), other.alias("placed"))

        def walked(f: Column) -> Column:
            grown = lambda x, when, more: F.when(when, F.concat(x, F.array(more))).otherwise(x)
            alone = f["ends"] & ~named  # a direction that no name follows is the name
            name = F.when(alone, F.array(s["direction"])).when(f["again"], F.concat(s["name"], F.array(s["last"]))).otherwise(grown(s["name"], naming & ~f["turned"] & ~f["ends"], x["plain"]))
            # what looked like a state belongs to the city if neither a ZIP nor the end follows
            city = bound(grown(s["city"], stated & ~f["coded"], s["state"]), lambda c: grown(c, f["placed"], t))
            phase_out = (
                F.when(phase == 0, F.when(f["begins"], 1).otherwise(9)).when(f["ends"], 2).when(phase == 5, 2).when(f["coded"], 4).when(f["stating"], 3).when(f["united"] & x["whole"], 2).when(f["united"], 5).when(stated, 2).otherwise(phase)
            )
            unit = F.when(f["united"], t).when(phase == 5, F.concat_ws(" ", s["unit"], t)).otherwise(s["unit"])
            return F.struct(
                phase_out, F.when(f["begins"], t).otherwise(s["house"]), F.when(f["turned"], direction).when(alone, F.lit(None)).otherwise(s["direction"]), F.when(phase == 0, empty).otherwise(name), F.when(f["ends"] | f["again"], suffix).otherwise(s["suffix"]),
                F.when(f["ends"] | f["again"], t).otherwise(s["last"]), F.when(f["after"], direction).otherwise(s["post"]), unit, F.when(phase == 0, empty).otherwise(city), F.when(f["stating"], t).when(stated & ~f["coded"], F.lit(None)).otherwise(s["state"]), F.when(f["coded"], F.substring(t, 1, 5)).otherwise(s["zip"]),
            ).cast(_WALK)

        return bound(bound(seen, placed), walked)

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0), none, none, F.array().cast("array<string>"), none, none, none, none, F.array().cast("array<string>"), none, none).cast(_WALK)
    return F.aggregate(tags, start, step)


def address_ladder(c: Column, city: Column | None = None, state: Column | None = None, market: str = "") -> Column:
    """struct(street, unit, city, state, zip, canonical, rung) by the first grammar that reads the address.

    rung: `segments`, where commas part a street that ends with a suffix from the rest; `walk`, where
    the words alone tell; `loose`, where only the first segment is taken as a street line, with the
    ZIP and state of the last.
    """
    segments = F.filter(F.transform(F.split(F.upper(c), ","), lambda s: F.trim(s)), lambda s: s != "")
    given = lambda col, make: make(col) if col is not None else F.lit(None).cast("string")

    def walk(w: Column) -> Column:
        street = F.concat_ws(" ", w["house"], w["direction"], F.array_join(w["name"], " "), w["suffix"], w["post"])
        town = F.coalesce(given(city, lambda x: city_name(x, market)), city_name(F.nullif(F.array_join(w["city"], " "), F.lit("")), market))
        return F.struct(street.alias("street"), w["unit"].alias("unit"), town.alias("city"), F.coalesce(given(state, state_code), w["state"]).alias("state"), w["zip"].alias("zip"))

    def line(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        town = F.when(F.size(parts) >= 3, city_name(F.get(parts, F.size(parts) - 2), market))
        return F.struct(
            F.nullif(loose_street_line(F.get(parts, F.lit(0))), F.lit("")).alias("street"), F.lit(None).cast("string").alias("unit"), F.coalesce(given(city, lambda x: city_name(x, market)), town).alias("city"),
            F.coalesce(given(state, state_code), F.nullif(F.regexp_extract(last, r"\b(" + "|".join(fixed.STATES.values()) + r")\b", 1), F.lit(""))).alias("state"), zip_code(last).alias("zip"),
        )

    def chosen(x: Column) -> Column:
        first, w = x["first"], x["walked"]
        ends = mapped(F.element_at(F.split(first["street"], " "), -1), {**fixed.SUFFIXES, **fixed.DIRECTIONS}).isNotNull()
        read = F.coalesce((F.size(x["segments"]) > 1) & first["street"].rlike(r"^\d") & ends, F.lit(False))
        plain = F.struct(*[first[f].alias(f) for f in ("street", "unit", "city", "state", "zip")])
        walks = w["phase"].isin(2, 3, 4)
        best = F.when(read, plain).when(walks, walk(w)).otherwise(line(x["segments"]))
        return F.struct(best.alias("best"), F.when(read, "segments").when(walks, "walk").otherwise("loose").alias("rung"))

    def named(x: Column) -> Column:
        best = x["best"]
        canonical = F.when(best["street"].isNotNull(), F.concat_ws(" ", best["street"], best["city"], best["state"], best["zip"]))
        return F.struct(*[best[f].alias(f) for f in ("street", "unit", "city", "state", "zip")], canonical.alias("canonical"), x["rung"].alias("rung"))

    steps = F.struct(address_parts(c, city, state, market).alias("first"), walked_address(c).alias("walked"), segments.alias("segments"))
    return F.when(F.trim(c) != "", bound(bound(steps, chosen), named))


_SUFFIX_RUN = "(?: (?:" + "|".join(fixed.LEGAL_SUFFIXES) + "))+$"


def developer_name(c: Column) -> Column:
    """Upper case, & as AND, only letters and digits, no leading THE and no trailing legal forms (unless nothing were left)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "&", " AND "), "[^A-Z0-9]+", " "))
    plain = F.regexp_replace(plain, "^THE (?=.)", "")
    bare = F.regexp_replace(F.concat(F.lit(" "), plain), _SUFFIX_RUN, "")
    bare = F.trim(bare)
    return F.nullif(F.when(bare == "", plain).otherwise(bare), F.lit(""))


def legal_suffix_count(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "&", " AND "), "[^A-Z0-9]+", " "))
    run = F.regexp_extract(F.concat(F.lit(" "), plain), _SUFFIX_RUN, 0)
    return F.when(run == "", 0).otherwise(F.size(F.split(F.trim(run), " ")))


def meaningful_tokens(c: Column) -> Column:
    """Distinct tokens of a developer's name that are not generic."""
    return F.array_except(F.filter(F.split(developer_name(c), " "), lambda t: t != ""), F.array(*[F.lit(t) for t in fixed.GENERIC_TOKENS]))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of lower-case words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets."""
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where either is null or both are empty."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(x) + F.size(y) - shared).cast("double")), F.lit(0.0))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for ch in b:
        hit = free & at.get(ch, 0)
        free = (free + hit) | (free - hit)
    return len(a) - (free & full).bit_count()


def set_ratio(a: str, b: str) -> float:
    """The greatest similarity among shared tokens and each side's sorted tokens, 0 to 100."""
    x, y = set(re.findall("[a-z0-9]+", a.lower())), set(re.findall("[a-z0-9]+", b.lower()))
    if not x or not y:
        return 0.0
    both, own, other = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (own and other):
        return 100.0
    sides = [" ".join(both + own), " ".join(both + other)]
    pairs = [(sides[0], sides[1])] + [(" ".join(both), side) for side in sides if both]
    return max(200.0 * common_subsequence(p, q) / (len(p) + len(q)) for p, q in pairs)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-set ratio of two text columns; 0 where either is null or has no token.

    No built-in function gives a common subsequence, so pairs go to Python in Arrow batches
    and each distinct pair of a batch is compared once.
    """
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(0.0)
            continue
        if pair not in known:
            known[pair] = set_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def permit_number(c: Column) -> Column:
    """Three numeric parts padded to five digits; anything else as it is."""
    parts = F.split(F.trim(c), "-")
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    return F.when(good, F.array_join(F.transform(parts, lambda p: F.when(F.length(p) >= 5, p).otherwise(F.lpad(p, 5, "0"))), "-")).otherwise(F.trim(c))


def parcel_number(book: Column, page: Column, parcel: Column) -> Column:
    """Book, page and parcel as 4 + 3 + 3 digits; null unless all are digits of at most these lengths."""
    parts = [(F.trim(c), n) for c, n in ((book, 4), (page, 3), (parcel, 3))]
    good = reduce(lambda p, q: p & q, [c.rlike(r"^\d+$") & (F.length(c) <= n) for c, n in parts])
    return F.when(good, F.concat(*[F.lpad(c, n, "0") for c, n in parts]))


def parcel_digits(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) == 10, d)


def permit_ids_in_urls(urls: Column) -> Column:
    """id1-id2-id3 of each URL that has all three, in order, once each."""
    one = lambda u: F.concat_ws("-", *[F.nullif(F.regexp_extract(u, rf"(?i)[?&]id{i}=([0-9]+)", 1), F.lit("")) for i in (1, 2, 3)])
    return F.array_distinct(F.filter(F.transform(urls, one), lambda x: x.rlike(r"^\d+-\d+-\d+$")))


def ordered_distinct(a: Column) -> Column:
    """Distinct non-empty values, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def field_label(c: Column, overrides: dict[str, str] | None = None) -> Column:
    label = F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return mapped(c, overrides, label) if overrides else label


def status_key(c: Column) -> Column:
    """Letters and digits in lower case, with one underscore for each run of anything else."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def coerced_status(c: Column) -> Column:
    """A known status by its value or folded name; null otherwise."""
    known = {s: s for s in (*fixed.STATUS_ORDER, *fixed.MANUAL_STATUSES)}
    folded = {"".join(x if x.isalnum() else "_" for x in s.lower()).strip("_"): s for s in known}
    return F.coalesce(mapped(F.trim(c), known), mapped(status_key(c), folded))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at a path's end, no tracking keys, and the query sorted.

    An empty path is a slash. Query keys and values are decoded and encoded again (a blank
    as +), and pairs are sorted as decoded. Null for text that is no http or https URL.
    """
    t = F.trim(c)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(t, r"^[^?#]*\?([^#]*)", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    tracks = lambda k: F.lower(k).startswith("utm_") | F.lower(k).isin(*fixed.TRACKING_KEYS)
    pairs = F.array_sort(F.filter(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), lambda p: ~tracks(p["k"])))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, tail))


def host_matches(host: Column, route: str) -> Column:
    """Equal, or a sub-domain for routes that begin with `*.` or `.`."""
    h, r = F.lower(host), route.lower()
    return h.endswith(r.removeprefix("*")) if r.startswith(("*.", ".")) else h == r
