"""Fill-in-middle: a text's prefix, middle and suffix, cut at two random units and put in another order.

Units are the matches of a pattern, left to right over code points; together they make up
the whole text. A text is cut by a streaming matcher in two passes, and neither keeps units:
the first advances the matches to the end and counts them, the second is a new, lazy
iterator of matches that is advanced to the smaller and then to the larger rank and stops
there. So besides the text and its output, memory is constant for any number of units.

Cuts and form follow from the id: the first four 8-digit groups of the hex sha256 of
`seed:id` are h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
units, the middle after the larger. A text stays `plain` where it holds a mark, is empty, or
by its share (h3); others are `spm` by their share (h4), else `psm`:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

Since a text with a mark stays plain, each mark is found again by its first place in the
output, and `restore` gives the exact text back.

Defined results: a null text counts as empty, has no units and stays plain; an id of null
is the empty string in `seed:id`; repeated rows give repeated results; other columns stay as
they are, and `fill_in_middle` refuses a table that has columns of its own names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.wordbytes import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)


@dataclass(frozen=True)
class FimParams:
    """unit: the pattern whose matches make up a text; of 100 texts, `plain` stay as they are, and of 100 others `spm` put the suffix first."""

    unit: str = "[A-Za-z]+|[^A-Za-z]"
    seed: int = 1
    plain: int = 10
    spm: int = 20


def counted(matches: Iterator) -> int:
    """How many matches are left; each is dropped as the next one is made."""
    numbers = count()
    deque(zip(matches, numbers), maxlen=0)
    return next(numbers)


def cuts(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """The code points before which `first` and `second` units end (first <= second)."""
    matches = unit.finditer(text)
    at = [0, 0]
    for k, steps in enumerate((first, second - first)):
        last = next(islice(matches, steps - 1, steps), None) if steps else None
        at[k] = last.end() if last else (at[k - 1] if k else 0)
    return at[0], at[1]


def draws(seed: int, key: str) -> list[int]:
    """h1 to h4 of an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: str, key: str, params: FimParams, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    h1, h2, h3, h4 = draws(params.seed, key)
    n = counted(unit.finditer(text))
    if not text or h3 % 100 >= 100 - params.plain or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = cuts(text, unit, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < params.spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: Column, form: Column) -> Column:
    """The texts that outputs were made of; a plain output is its text."""
    prefix, suffix, middle = (F.instr(output, mark) for mark in MARKS)
    size = F.lit(len(PREFIX))
    between = lambda low, high: F.substr(output, low + size, high - low - size)
    after = F.substr(output, middle + size)
    psm = F.concat(between(prefix, suffix), after, between(suffix, middle))
    spm = F.concat(between(prefix, middle), after, between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(F.coalesce(output, F.lit("")))


ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, and n (units), form, prefix_chars, middle_chars and output."""
    if clash := set(docs.columns) & set(ADDED):
        raise ValueError(f"the table has columns of the result: {sorted(clash)}")
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(name, kind) for name, kind in ADDED.items()])
    text_at, key_at = docs.columns.index(text_col), len(docs.columns)
    names, kinds = schema.names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def apply(batches):
        unit = re.compile(params.unit)
        for batch in batches:
            for part in text_slices(batch, text_col):
                made = [transform(t.as_py() or "", k.as_py(), params, unit) for t, k in zip(part.column(text_at), part.column(key_at), strict=True)]
                new = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:key_at], *new], names)

    return docs.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).mapInArrow(apply, schema)


FIM_ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
