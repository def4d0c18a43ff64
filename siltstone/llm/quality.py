"""Quality: a sparse ensemble of rules over statistics of a text.

Statistics of each whole text (shares of kinds of characters, lengths, repetition of words,
pairs, fives and lines) are computed in NumPy, a slice of a batch at a time. On labelled
rows, a forest of shallow trees is grown over them; each path from a root to a node is a
rule, a conjunction of comparisons. A logistic regression with a lasso penalty gives each
rule a weight, most of them 0. The rules that are left are compiled into one Spark column
expression over the statistics, which is the score.

Trees and weights are fitted by Spark's own learners on a bounded sample of labelled rows:
the `per_class` ids of each class whose hashes are least, and of their different texts as
many. Scoring covers every row.

Defined results: a null or empty text has statistics of 0 and is scored like any other; a
label that is null, or neither 0 nor 1, or whose id is null, is not learned from; an id with
several labels counts as poor if any says so; with one class to learn from, every score is
that class's (0 without any label). Repeated rows score alike, other columns are not read,
and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labelled import held_out, labelled_sample
from siltstone.llm.wordbytes import BLANKS, Words, gram_hashes, mixed, one_row_grams, separators, text_slices
from siltstone.session import ensure_checkpoint_dir

STATISTICS = (
    "log_chars", "log_words", "word_chars", "letters", "uppers", "digits", "stops", "marks", "word_marks",
    "same_words", "same_pairs", "same_fives", "top_word", "log_lines", "line_words", "same_lines",
)

_LETTER, _UPPER, _DIGIT, _STOP, _BLANK, _LATER, _MARK = range(7)
_ENDS_LINE = separators((0x0A, 0x0A), (0x0D, 0x0D))


def _kinds() -> np.ndarray:
    """The kind of each byte; first bytes of non-ASCII characters count as letters, later ones as nothing."""
    kind = np.full(256, _MARK, np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = _UPPER, _LETTER, _DIGIT
    kind[0x80:0xC0], kind[0xC0:] = _LATER, _LETTER
    kind[BLANKS] = _BLANK
    kind[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = _STOP
    return kind


_KIND = _kinds()


@dataclass(frozen=True)
class QualityParams:
    """per_class bounds the labelled rows learned from; trees and depth bound the rules; lasso is the weight of the penalty."""

    per_class: int = 10_000
    trees: int = 24
    depth: int = 3
    lasso: float = 0.001
    accept: float = 0.3
    fold: int = 5
    seed: int = 7


Rule = tuple[tuple[str, bool, float], ...]  #: comparisons (statistic, whether it is greater, threshold) that all hold


@dataclass
class QualityModel:
    """Rules with their weights, and the bias."""

    rules: list[tuple[Rule, float]]
    bias: float
    params: QualityParams

    def score(self) -> Column:
        """The score as one expression over the columns of statistics."""
        weighted = [F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, weighted, F.lit(self.bias))))


def condition(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (F.col(name) > t if more else F.col(name) <= t for name, more, t in rule))


def statistics(text: pa.Array) -> list[np.ndarray]:
    """Each statistic of all texts, in the order of STATISTICS."""
    words = Words(text, BLANKS)
    offsets, n = words.offsets, len(words.offsets) - 1
    kind = _KIND[words.raw]

    def per_row(mask: np.ndarray, edges: np.ndarray = offsets) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])[edges]
        return np.diff(total).astype(float)

    share = lambda a, b: a / np.maximum(b, 1)
    letter, upper, digit, stop, mark, blank = (per_row(kind == k) for k in (_LETTER, _UPPER, _DIGIT, _STOP, _MARK, _BLANK))
    chars = letter + upper + digit + stop + mark + blank
    count = np.diff(words.first).astype(float)
    ends_mark = per_row(kind[words.ends - 1] == _MARK, words.first)

    def again(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of entries that repeat another of their row, and of the commonest entry."""
        _, at, times = np.unique(mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        all_, top = np.bincount(row, minlength=n).astype(float), np.zeros(n)
        np.maximum.at(top, row[at], times)
        return share(all_ - np.bincount(row[at], minlength=n), all_), share(top, all_)

    h = words.hashes()
    same_words, top_word = again(h, words.row)
    same_grams = []
    for k in (2, 5):
        whole = one_row_grams(words, k)
        same_grams.append(again(gram_hashes(h, k)[whole], words.row[: len(whole)][whole])[0])
    lines = Words(text, _ENDS_LINE)
    n_lines = np.diff(lines.first).astype(float)
    same_lines, _ = again(lines.hashes(), lines.row)
    return [
        np.log1p(chars), np.log1p(count), share(chars - blank, count), share(letter + upper, chars), share(upper, letter + upper), share(digit, chars), share(stop, chars), share(mark, chars), share(ends_mark, count),
        same_words, *same_grams, top_word, np.log1p(n_lines), share(count, n_lines), same_lines,
    ]


def with_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows without their text, and with a column for each statistic."""
    others = [c for c in rows.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), *(f"{s} double" for s in STATISTICS)])

    def apply(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(s) for s in statistics(part.column(0)))], [*others, *STATISTICS])

    return rows.select(text_col, *others).mapInArrow(apply, schema)


def paths(node, before: Rule = ()) -> list[Rule]:
    """The rules of all nodes of a fitted tree below its root."""
    if node.numDescendants() == 0:
        return []
    name, t = STATISTICS[node.split().featureIndex()], node.split().threshold()
    found = []
    for child, more in ((node.leftChild(), False), (node.rightChild(), True)):
        rule = (*before, (name, more, t))
        found += [rule, *paths(child, rule)]
    return found


def simplest(rule: Rule) -> Rule:
    """The same rule with one comparison for each statistic and direction, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, more, t in rule:
        held = tight.get((name, more), t)
        tight[name, more] = max(held, t) if more else min(held, t)
    return tuple(sorted((name, more, t) for (name, more), t in tight.items()))


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the sampled labelled rows that are not held out."""
    ensure_checkpoint_dir(docs.sparkSession)
    sample = labelled_sample(docs, labels, params.per_class, params.fold, id_col, text_col, label_col, none_of=1)
    spread = sample.select("_t", "_y", "_h").repartition(16, "_h").sortWithinPartitions("_h")
    rows = with_statistics(spread, "_t").checkpoint().coalesce(8)
    seen = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return QualityModel([], 30.0 if 1 in seen else -800.0, params)
    label = F.col("_y").cast("double").alias("label")
    grown = rows.select(label, array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=params.seed).fit(grown)
    rules = sorted({simplest(p) for tree in forest.trees for p in paths(tree._java_obj.rootNode())})
    if not rules:
        return QualityModel([], float(np.log(seen[1] / seen[0])), params)
    held = rows.select(label, array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
    fitted = LogisticRegression(regParam=params.lasso, elasticNetParam=1.0, maxIter=60).fit(held)
    weights = fitted.coefficients.toArray()
    return QualityModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0], float(fitted.intercept), params)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, whether it is held out, score and predicted label, and its statistics."""
    held = F.coalesce(held_out(id_col, model.params.fold), F.lit(False))
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), held.alias("_held"))
    scored = with_statistics(rows, "_text").withColumn("_score", model.score())
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= model.params.accept).cast("int").alias("predicted"), *STATISTICS)
