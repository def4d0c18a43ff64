"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that it holds (presence, not count, so
that length does not add up). Each feature is scaled by its log-count ratio
r = log((p/|p|) / (q/|q|)) of smoothed document counts in toxic and clean labelled texts,
and a logistic regression is fitted on the scaled features.

The classifier is fitted on a bounded sample of labelled rows: the `per_class` ids of each
class that come first in the order of a hash, and of their different texts as many. All
buckets whose rates in the two classes differ at the significance `level` (two proportions,
two-sided) have a weight, however many they are. Decay and steps are those of `decays` and
`steps` with the least loss on a quarter of the sampled rows, by hash, for which neither
buckets nor weights were fitted; the classifier is then fitted with them on all sampled
rows. The driver gets counts by bucket, and the sampled rows' numbers of those buckets.

Defined results: a null or empty text has no features and scores the classifier's base
rate; a label that is null, or neither 0 nor 1, or whose id is null, is not learned from;
an id with several labels counts as toxic if any says so; with one class or none to learn
from, every score is that class's rate (0 without any label). Repeated rows score alike,
other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.chargrams import buckets, codes, row_slices, text_list
from siltstone.llm.labelled import held_out, labelled_sample
from siltstone.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class ToxicityParams:
    """per_class bounds the labelled rows learned from; level is the significance of a bucket that has a weight; decays and steps are tried on a split."""

    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    per_class: int = 2000
    level: float = 1e-4
    decays: tuple[float, ...] = (1e-4, 1e-3, 1e-2)
    steps: tuple[int, ...] = (100, 200, 300, 600)
    fold: int = 5


@dataclass
class ToxicityModel:
    """weights: by bucket, the product of ratio and fitted weight; kept: which buckets have one."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not self.kept.any():
            return 1 / (1 + np.exp(-out))
        for low, high in row_slices(texts):
            rows, found = present(texts[low:high], self.sizes, self.bits, self.kept)
            out[low:high] += np.bincount(rows, self.weights[found], high - low)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def present(texts: list[str | None], sizes: tuple[int, ...], bits: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) once for each n-gram bucket that a text holds (of those kept)."""
    pad = max(sizes) - 1
    chars, rows = codes(texts, pad)
    both = []
    for n in sizes:
        found = buckets(chars, n, bits)
        inside = rows[: len(found)]
        if kept is not None:
            hit = np.flatnonzero(kept[found])
            found, inside = found[hit], inside[hit]
        both.append((inside.astype(np.int64) << bits) | found)
    pairs = np.unique(np.concatenate(both))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the sampled labelled rows that are not held out; executors count their features and then give those kept."""
    ensure_checkpoint_dir(docs.sparkSession)
    sample = labelled_sample(docs, labels, params.per_class, params.fold, id_col, text_col, label_col)
    # the class, and 2 more for the quarter of the rows that parameters are tried on
    part = F.col("_y") + F.when(F.pmod("_h", F.lit(4)) == 0, 2).otherwise(0)
    learned = sample.select(part.alias("_y"), "_t", "_h").repartition(16, "_h").checkpoint()
    size, sizes, bits = 1 << params.bits, params.sizes, params.bits

    def count(batches):
        found, rows = np.zeros((4, size), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            y, texts = batch.column(0).to_numpy(), text_list(batch.column(1))
            rows += np.bincount(y, minlength=4)
            for low, high in row_slices(texts, 1 << 18):
                at, bucket = present(texts[low:high], sizes, bits)
                for part in range(4):
                    found[part] += np.bincount(bucket[y[low:high][at] == part], minlength=size)
        held = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), *(pa.array(np.append(f[held], n)) for f, n in zip(found, rows, strict=True))], ["bucket", *names])

    names = [f"n{i}" for i in range(4)]
    counted = learned.mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    bucket, by_part = counted.column("bucket").to_numpy(), np.stack([counted.column(c).to_numpy() for c in names])
    rows = by_part[:, bucket < 0].sum(1)
    counts = np.zeros((4, size))
    counts[:, bucket[bucket >= 0]] = by_part[:, bucket >= 0]
    n_q, n_p = int(rows[0] + rows[2]), int(rows[1] + rows[3])
    kept, ratio = _chosen(counts[0] + counts[2], counts[1] + counts[3], n_q, n_p, params.level)
    if not kept.any():
        base = (30.0 if n_p else -30.0) if 0 in (n_p, n_q) else float(np.log(n_p / n_q))
        return ToxicityModel(kept, np.zeros(size, np.float32), base, sizes, bits)
    tried, tried_ratio = _chosen(counts[0], counts[1], int(rows[0]), int(rows[1]), params.level)
    chosen = np.flatnonzero(kept | tried)

    def features(batches):
        kept = np.zeros(size, bool)
        kept[chosen] = True
        column = np.cumsum(kept, dtype=np.int32) - 1
        for batch in batches:
            texts = text_list(batch.column(1))
            lists = []
            for low, high in row_slices(texts, 1 << 18):
                at, found = present(texts[low:high], sizes, bits, kept)
                lists += np.split(column[found], np.searchsorted(at, np.arange(1, high - low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["y", "h", "f"])

    local = learned.mapInArrow(features, "y int, h long, f array<int>").toArrow().combine_chunks().sort_by("h").combine_chunks()  # of the sampled rows only
    lists, part = local.column("f").chunk(0), local.column("y").to_numpy().astype(np.int64)
    held = Features(chosen[lists.flatten().to_numpy()], np.diff(lists.offsets.to_numpy()), part % 2)
    fit, test = held.of(part < 2, tried), held.of(part >= 2, tried)
    decay, steps = params.decays[0], params.steps[-1]
    if tried.any() and len(np.unique(test.y)) == 2:
        trials = [(test.loss(tried_ratio * w, b), -decay, steps) for decay in params.decays for steps, w, b in _fitted(fit, tried_ratio, decay, params.steps)]
        _, decay, steps = min(trials)
        decay = -decay
    *_, (_, w, b) = _fitted(held.of(part >= 0, kept), ratio, decay, (steps,))
    return ToxicityModel(kept, np.where(kept, ratio * w, 0).astype(np.float32), b, sizes, bits)


@dataclass
class Features:
    """The buckets of all rows, one row after the other; how many each row has; the rows' classes."""

    bucket: np.ndarray
    sizes: np.ndarray
    y: np.ndarray

    def __post_init__(self):
        self.at = np.repeat(np.arange(len(self.y)), self.sizes)
        self.per = 0.5 / np.maximum(np.bincount(self.y, minlength=2), 1)[self.y]  # both classes weigh the same, whatever was sampled

    def of(self, rows: np.ndarray, kept: np.ndarray) -> Features:
        """Some rows with some buckets."""
        here = rows[self.at] & kept[self.bucket]
        return Features(self.bucket[here], np.bincount(self.at[here], minlength=len(rows))[rows], self.y[rows])

    def loss(self, weights: np.ndarray, bias: float) -> float:
        s = bias + np.bincount(self.at, weights[self.bucket], len(self.y))
        return float((np.logaddexp(0, np.where(self.y == 1, -s, s)) * self.per).sum())


def _chosen(q: np.ndarray, p: np.ndarray, n_q: int, n_p: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose rates differ at the level (none without both classes), and the log-count ratio of each bucket."""
    if not n_q or not n_p:
        return np.zeros(len(p), bool), np.zeros(len(p))
    rate = (p + q + 1) / (n_p + n_q + 2)
    z = np.abs(p / n_p - q / n_q) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_q))
    return (z >= NormalDist().inv_cdf(1 - level / 2)) & (p + q > 1), np.log(((p + 1) / (p + 1).sum()) / ((q + 1) / (q + 1).sum()))


def _fitted(rows: Features, ratio: np.ndarray, decay: float, steps: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, float]]:
    """Logistic regression on features scaled by their ratios: the number of steps, weights by bucket, and bias after each of `steps`."""
    buckets_, col = np.unique(rows.bucket, return_inverse=True)
    value, k = ratio[rows.bucket], len(buckets_)
    w, b = np.zeros(k), 0.0
    m = [np.zeros(k + 1), np.zeros(k + 1)]
    for t in range(1, max(steps) + 1):
        s = b + np.bincount(rows.at, value * w[col], len(rows.y))
        g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - rows.y) * rows.per
        grad = np.append(np.bincount(col, value * g[rows.at], k) + decay * w, g.sum())
        m = [0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad * grad]
        step = 0.05 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:k], b - step[k]
        if t in steps:
            whole = np.zeros(len(ratio))
            whole[buckets_] = w
            yield t, whole, float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """Per row: the id, whether it is held out, score and predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        model = shared.value
        for batch in batches:
            scores = model.scores(text_list(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, F.coalesce(held_out(id_col, fold), F.lit(False)).alias("held_out"), text_col).mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(batches):
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array(model.scores(text_list(batch.column(at))) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
