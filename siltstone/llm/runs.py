"""Periodic runs of words, by names of power-of-two stretches.

A run is a stretch of consecutive words with smallest period q (words q apart are the same)
and a length of `least` and of 2q at least, that no neighbouring word extends keeping q.

Naming: at level 0 each word of a text has a number that equal words of that text share. At
level k + 1 a position's name is the number of the pair of names at level k of it and of the
position 2^k further on; so equal names are equal stretches of 2^k words, exactly. A stretch
that occurs once in its text gets no name, nor does any longer one from there, so the levels
thin out fast and end where nothing repeats. The longest common extension of two positions,
forward or backward, follows from one descent through the levels.

Candidates: a run of period q and length 2q or more covers two neighbouring points of the
grid 0, q, 2q, ... of its text. For each q up to half a text's words, each such pair of equal
words is extended both ways, which gives the run's borders; that is n * H(n) pairs for n
words. A stretch found for several periods has the least of them.

All texts of a slice of a batch are named and extended together as NumPy arrays, and candidates
in portions of `portion`, so that memory is some 8 bytes a word and level, and that many
pairs. Texts are not split: one text is one task's work.

Defined results: a null or empty text, or one of less than `least` words, has no runs and
keeps its words; repeated rows give repeated results; columns other than the id and the
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.wordbytes import BLANKS, Words, text_slices

#: The words that `Words` sees with BLANKS, as a pattern of Spark's own functions.
NO_WORD = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class RunParams:
    """least: words of a run at least; portion: candidate pairs looked at together."""

    least: int = 12
    portion: int = 1 << 19


def word_names(words: Words) -> np.ndarray:
    """A number for each word, the same for equal words."""
    if not len(words):
        return np.zeros(0, np.int64)
    edges = np.stack([words.starts, words.ends], 1).ravel()  # words and what lies between them, in turns
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(words.raw)])
    return both.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def numbered(keys: np.ndarray) -> np.ndarray:
    """For each key its number among those that occur more than once; -1 for the others."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times > 1
    return np.where(again, np.cumsum(again) - 1, -1)[number]


class Levels:
    """Names of the stretches of 2^k words from each position; -1 where there is none."""

    def __init__(self, names: np.ndarray, row: np.ndarray, first: np.ndarray):
        self.n = n = len(names)
        self.first = first
        at = np.arange(n)
        found = numbered(row.astype(np.int64) * (names.max(initial=0) + 1) + names)
        self.names: list[np.ndarray] = []
        end = first[row + 1] if n else at
        while (found >= 0).any():
            level = np.full(n + 1, -1, np.int32)
            level[at] = found
            size = 1 << len(self.names)
            self.names.append(level)
            at = at[found >= 0]
            at = at[at + 2 * size <= end[at]]
            later = level[at + size]
            at, later = at[later >= 0], later[later >= 0]
            found = numbered(level[at].astype(np.int64) * (n + 1) + later)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same, for i < j of one text."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = self.names[k][i + length], self.names[k][np.minimum(j + length, self.n)]
            length[(a == b) & (a >= 0)] += 1 << k
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            low = i - length - (1 << k)
            a, b = self.names[k][np.maximum(low, -1)], self.names[k][j - length - (1 << k)]  # -1 is the entry without a name
            length[(low >= 0) & (a == b) & (a >= 0)] += 1 << k
        return length


def grid_pairs(first: np.ndarray, portion: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (position, period) of neighbouring grid points in texts that begin at `first`, about `portion` at a time."""
    sizes = np.diff(first)
    longest = int(sizes.max(initial=0))
    order = np.argsort(-sizes, kind="stable")
    sizes, begins = sizes[order], first[:-1][order]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    low = 1
    while low <= longest // 2:
        # periods of about one portion: a period q has no more than words / q pairs
        total = int(sizes[: np.searchsorted(-sizes, -2 * low, "right")].sum())
        high = min(longest // 2, low + max(0, portion * low // max(total, 1) - 1))
        q = np.arange(low, high + 1)
        texts = np.searchsorted(-sizes, -2 * q, "right")  # how many texts have two periods of q
        which = np.arange(texts.sum()) - np.repeat(np.cumsum(texts) - texts, texts)
        period = np.repeat(q, texts)
        pairs = (sizes[which] - 1) // period  # points whose next one is inside the text
        step = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        period = np.repeat(period, pairs)
        held.append((np.repeat(begins[which], pairs) + step * period, period))
        n += len(period)
        if n >= portion // 2:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
        low = high + 1
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def runs_of(words: Words, params: RunParams = RunParams()) -> np.ndarray:
    """Rows of (start, end, period) of all runs, by start, then period; positions are those of the slice's words."""
    levels = Levels(word_names(words), words.row, words.first)
    found = [np.zeros((0, 3), np.int64)]
    if levels.names:
        zero = levels.names[0]
        for at, q in grid_pairs(words.first, params.portion):
            same = (zero[at] == zero[at + q]) & (zero[at] >= 0)
            at, q = at[same], q[same]
            after, before = levels.forward(at, at + q), levels.backward(at, at + q)
            long = (after + before >= q) & (after + before + q >= params.least)
            at, q, after, before = at[long], q[long], after[long], before[long]
            found.append(least_period(np.stack([at - before, at + q + after, q], 1)))
    out = least_period(np.concatenate(found))
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def least_period(stretches: np.ndarray) -> np.ndarray:
    """Of rows of the same start and end, the one of least period."""
    order = np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))
    out = stretches[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    return out[keep]


def collapsed(words: Words, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each row's kept words joined by one space."""
    size = np.where(keep, words.ends - words.starts + 1, 0)  # with a space after each
    ends = np.concatenate([[0], np.cumsum(size)])
    kept = np.flatnonzero(keep)
    place = np.arange(ends[-1]) - np.repeat(ends[kept], size[kept]) + np.repeat(words.starts[kept], size[kept])
    raw = words.raw[np.minimum(place, max(len(words.raw) - 1, 0))] if len(words.raw) else np.zeros(0, np.uint8)
    raw[ends[kept + 1] - 1] = 32
    begin, end = ends[words.first[:-1]], ends[words.first[1:]]
    edges = np.stack([begin, np.maximum(end - 1, begin)], 1).ravel()
    both = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)) if len(edges) else pa.array([], pa.large_string())
    return both.take(pa.array(np.arange(0, len(edges), 2))).cast(pa.string())


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, params: RunParams = RunParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, runs (by start, then period; starts are word numbers from 0) and collapsed, the kept words joined by one space."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])

    def apply(batches):
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column(1), BLANKS)
                runs = runs_of(words, params)
                row = words.row[runs[:, 0]] if len(runs) else runs[:, 0]
                begin = words.first[row]
                listed = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - begin, runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(offsets), listed), joined(words, collapsed(words, runs))], schema.names)

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(apply, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The texts of one in ten ids with a run put in, words joined by one space; other texts as they are.

    With h = crc32(id), unsigned, and g = floor(h / 10), a text of n > 0 words whose h % 10 is 0 gets, from
    word a = g % n on, its words a, a + 1, ... a + p - 1 over and over, where p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))), " ")).otherwise("")

    # the words are bound once, as the only element of a list
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_runs, the longest run (ties: least start, then period), and digests of all runs and of the kept words."""
    runs = F.col("runs")
    better = lambda x, y: (x["length"] > y["length"]) | ((x["length"] == y["length"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    longest = F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, x: F.when(a.isNull() | better(x, a), x).otherwise(a))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select(id_col, F.size(runs).cast("long").alias("n_runs"), longest.alias("_l"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    per = F.floor(F.col("_l.length") * 1000 / F.col("_l.period")).cast("long")
    return out.select(id_col, "n_runs", "_l.start", "_l.length", "_l.period", per.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
