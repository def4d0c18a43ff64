"""Licence scans: Dice coefficient of word bigrams between parts of a text and licence templates.

A text is normalised (A-Z lower-cased, all but a-z and 0-9 a blank) and cut into segments at
sentence ends and line ends. What is compared with a template is every run of consecutive
segments, joined by blanks: so a wrapped notice, a notice of several sentences within other
text, and one that blank lines split are runs as well as a single sentence or line. A run
and a template are compared as sets of word bigrams; they match if 2 * shared /
(size + size) reaches the threshold t. Bounds that follow from this, or belong to the
definition, prune what is compared:

- sharing needs t / (2 - t) of the template's bigrams, so a text matches no template of
  which it holds fewer, and none if it lacks all anchors (words of so many of a template's
  bigrams that a match cannot do without all of them);
- a run has at most (2 - t) / t times the template's number of bigrams, repetitions counted;
- a run starts and ends in segments that share a bigram with the template (other ends only
  lower the coefficient).

Only DataFrame functions are used. All comparing is done within a document's row and in
memory bounded by its text, so no text or bigram is shuffled, only matches are.

Defined results: null and empty texts match nothing; a run of fewer than two words has no
bigram; repeated rows of one id and text count once; the character U+0001 in a text ends a
segment. Runs that overlap, or share a segment, are one place. Ids may be null. Other
columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, in the wording their authors recommend.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        ' in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, int, int, str]]:
    """(licence, template number, its number of distinct bigrams, bigram), a row for each distinct bigram."""
    rows, number = [], 0
    for name, texts in templates.items():
        for text in texts:
            number += 1
            words = "".join(c if c in _LOWER + "0123456789" else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            rows += [(name, number, len(pairs), p) for p in pairs]
    return rows


#: Words that say little; anchors are chosen among others first. Any choice is safe.
_COMMON = "a an and any are as at be by can for following from if in is it may of on one or other shall that the this to under use was with without you".split()


def anchors(rows: list[tuple[str, int, int, str]], threshold: float) -> list[str]:
    """Words of which a text holds at least one if a run of it matches any template."""
    found = set()
    for number in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == number]
        need = ceil(own[0][2] * threshold / (2 - threshold) - 1e-9)
        telling = [max(r[3].split(" "), key=lambda w: (w not in _COMMON, len(w), w)) for r in own]
        telling.sort(key=lambda w: (w in _COMMON, -len(w), w))
        found.update(telling[: len(own) - need + 1])
    return sorted(found)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id, text and matching licence: the id, license_id, n_places where runs match, and best_dice."""
    rows = template_bigrams(TEMPLATES if templates is None else templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    by_template: dict[tuple[str, int], list[str]] = {}
    for name, number, _, bigram in rows:
        by_template.setdefault((name, number), []).append(bigram)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("license_id"), F.lit(len(b)).alias("t_size"), F.lit(ceil(low * len(b) - 1e-9)).alias("need"), F.lit(floor(high * len(b) + 1e-9)).alias("most"), F.array(*map(F.lit, b)).alias("own"))
        for (name, _), b in by_template.items()
    ])

    text = F.translate(F.regexp_replace(F.col(text_col), "([.!?])[ \t\r\n]+", "$1\x01"), "\n" + _UPPER, "\x01" + _LOWER)
    norm = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.regexp_replace(text, "[^a-z0-9\x01]+", " ").alias("_n"))
    told = norm.filter(F.arrays_overlap(F.split(F.translate("_n", "\x01", " "), " "), F.array(*map(F.lit, anchors(rows, threshold)))))

    def column(of: DataFrame, name: str, value: Column) -> DataFrame:
        """The value comes out of a generator, so that later expressions read it and do not make it again."""
        return of.select("*", F.explode(F.array(value)).alias(name))

    words = F.flatten(F.transform(F.split("_n", "\x01"), lambda s, g: F.transform(F.filter(F.split(s, " "), lambda w: w != ""), lambda w, k: F.struct(w.alias("w"), g.alias("g"), k.alias("k")))))
    worded = column(told, "_w", words).drop("_n").filter(F.size("_w") > 1)
    pair = lambda j: F.struct(F.concat(F.get("_w", j)["w"], F.lit(" "), F.get("_w", j + 1)["w"]).alias("b"), F.get("_w", j)["g"].alias("g"), F.get("_w", j + 1)["g"].alias("h"), (j - F.get("_w", j)["k"]).alias("j"))
    paired = column(worded, "_b", F.transform(F.sequence(F.lit(0), F.size("_w") - 2), pair)).drop("_w")
    met = paired.select("_id", "_t", "_b", F.explode(wanted).alias("_l")).select("_id", "_t", "_b", "_l.*")
    met = met.filter((F.size("_b") >= F.col("need")) & (F.size(F.array_intersect(F.col("_b.b"), F.col("own"))) >= F.col("need")))
    # from the first word of each segment that shares a bigram, as many bigrams as a run may have, and one more
    starts = F.array_distinct(F.transform(F.filter("_b", lambda x: F.array_contains("own", x["b"])), lambda x: F.struct(x["g"].alias("a"), x["j"].alias("j"))))
    begun = met.select("*", F.explode(starts).alias("_s")).select("_id", "_t", "license_id", "t_size", "need", "most", "own", F.col("_s.a").alias("_a"), F.expr("slice(_b, _s.j + 1, most + 1)").alias("_r"))
    begun = column(begun, "_run", F.col("_r")).drop("_r").filter(F.size(F.array_intersect(F.col("_run.b"), F.col("own"))) >= F.col("need"))
    ends = F.array_distinct(F.transform(F.filter("_run", lambda x: F.array_contains("own", x["b"])), lambda x: x["h"]))
    runs = begun.select("*", F.explode(F.transform(ends, lambda e: F.struct(e.alias("e"), F.transform(F.filter("_run", lambda x: x["h"] <= e), lambda x: x["b"]).alias("b")))).alias("_e"))
    runs = runs.filter(F.size("_e.b").between(F.col("need"), F.col("most")))
    dice = 2.0 * F.size(F.array_intersect(F.col("_e.b"), F.col("own"))) / (F.size(F.array_distinct("_e.b")) + F.col("t_size"))
    matched = runs.select("_id", "_t", "license_id", "_a", F.col("_e.e").alias("_e"), dice.alias("_d")).filter(F.col("_d") >= threshold)
    spans = F.array_sort(F.collect_set(F.struct("_a", "_e")))
    places = F.aggregate(spans, F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n")), lambda p, x: F.struct(F.greatest(p["last"], x["_e"]).alias("last"), (p["n"] + F.when(x["_a"] > p["last"], 1).otherwise(0)).alias("n")), lambda p: p["n"])
    return matched.groupBy("_id", "_t", "license_id").agg(places.alias("n_places"), F.max("_d").alias("best_dice")).select(F.col("_id").alias(id_col), "license_id", "n_places", "best_dice")


def license_oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over `documents`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {b}, {c}, {quoted(d)})" for a, b, c, d in template_bigrams(TEMPLATES))
    least, most = f"{threshold / (2 - threshold)} * t_size - 1e-9", f"{(2 - threshold) / threshold} * t_size + 1e-9"
    return f"""
WITH tpl(license_id, template, t_size, bigram) AS (VALUES {values}),
norm AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'),
         chr(10) || '{_UPPER}', chr(1) || '{_LOWER}'), '[^a-z0-9\x01]+', ' ', 'g') AS n
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
seg AS (SELECT r, unnest(string_split(n, chr(1))) AS s, unnest(range(len(string_split(n, chr(1))))) AS g FROM norm),
cut AS (SELECT r, g, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM seg),
word AS (SELECT r, g, unnest(w) AS w, unnest(range(len(w))) AS k FROM cut),
placed AS (SELECT r, g, w, row_number() OVER (PARTITION BY r ORDER BY g, k) AS j FROM word),
pair AS (SELECT r, g, lead(g) OVER p AS h, w || ' ' || lead(w) OVER p AS b, j FROM placed WINDOW p AS (PARTITION BY r ORDER BY j)),
edge AS (SELECT r, g, min(j) AS first_j, max(j) AS last_j FROM placed GROUP BY r, g),
hit AS (SELECT r, template, t_size, license_id, g, h, b FROM pair JOIN tpl ON b = bigram),
cand AS (SELECT r, template FROM hit GROUP BY r, template, t_size HAVING count(DISTINCT b) >= {least}),
begins AS (SELECT DISTINCT r, template, t_size, license_id, g AS a FROM hit SEMI JOIN cand USING (r, template)),
ends AS (SELECT DISTINCT r, template, h AS e FROM hit SEMI JOIN cand USING (r, template)),
run AS (SELECT s.r, s.template, s.t_size, s.license_id, a, e, x.first_j AS f, y.last_j - 1 AS l FROM begins s JOIN ends t USING (r, template)
        JOIN edge x ON x.r = s.r AND x.g = a JOIN edge y ON y.r = s.r AND y.g = e WHERE e >= a AND y.last_j - x.first_j <= {most}),
size AS (SELECT run.r, run.template, license_id, t_size, a, e, count(DISTINCT p.b) AS s FROM run JOIN pair p ON p.r = run.r AND p.j BETWEEN f AND l GROUP BY ALL),
common AS (SELECT run.r, run.template, a, e, count(DISTINCT p.b) AS o FROM run JOIN pair p ON p.r = run.r AND p.j BETWEEN f AND l JOIN tpl ON tpl.template = run.template AND tpl.bigram = p.b GROUP BY ALL),
matched AS (SELECT r, license_id, a, e, max(2.0::DOUBLE * o / (s + t_size)) AS d FROM size JOIN common USING (r, template, a, e) WHERE 2.0::DOUBLE * o / (s + t_size) >= {threshold} GROUP BY r, license_id, a, e),
island AS (SELECT r, license_id, d, coalesce(a > max(e) OVER (PARTITION BY r, license_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM matched)
SELECT doc_id, license_id, count(*) FILTER (WHERE new) AS n_places, max(d) AS best_dice FROM island JOIN norm USING (r) GROUP BY r, doc_id, license_id
"""
