"""Language identification: nearest of several clustered centroids per language, by cosine.

A text's vector holds, by hashed character n-gram (letters only, other characters are a
blank), (1 + log count) * idf, normalised to length 1. Document frequencies are counted over
all training texts. Each language's sampled training vectors are clustered by spherical
k-means; a text gets the language of the centroid of greatest cosine. A centroid also has a
radius: the mean distance of its training texts plus `spread` deviations; a text outside the
radius of its nearest centroid is rejected, which `accepted` states as `und`.

Clusters are fitted on a bounded sample of each language: its `per_language` training texts
whose hashes are least. Every language is learned, however many there are. A language's
sample is clustered in one task, and the driver sees centroids only, `block_languages` of
them at a time: documents are compared with one such block after the other, and keep the
best centroid so far. Components are rounded to 2^-20, so that cosines are sums of whole
numbers below 2^53 and exact: they do not depend on what is multiplied together.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected;
so is every text if there is nothing to learn from. Rows with null language or id are not
learned from. Ties go to the language first in order of name. Repeated rows get the same
result, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.chargrams import buckets, codes, letter_table, row_slices, text_list
from siltstone.llm.labelled import held_out
from siltstone.session import ensure_checkpoint_dir

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """per_language bounds the sample; clusters is the centroids of a language; block_languages bounds what is broadcast at once."""

    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 12
    per_language: int = 600
    clusters: int = 3
    rounds: int = 12
    spread: float = 4.0
    fold: int = 5
    block_languages: int = 400


@dataclass
class LanguageModel:
    """centroids: (l, j, radius, centroid) rows of all languages; languages: their names, ascending."""

    languages: list[str]
    idf: np.ndarray
    centroids: DataFrame | None
    params: LanguageParams

    def blocks(self):
        """The centroids of `block_languages` languages at a time, in the order of names."""
        step = self.params.block_languages
        for low in range(0, len(self.languages), step):
            names = self.languages[low : low + step]
            held = self.centroids.filter(F.col("l").between(names[0], names[-1])).toPandas().sort_values(["l", "j"])
            yield Block(list(held["l"]), np.stack([np.frombuffer(x, np.float32) for x in held["centroid"]]), held["radius"].to_numpy(), self.idf, self.params)


@dataclass
class Block:
    """Centroids of some languages, one row each: the names, vectors and radii."""

    names: list[str]
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray
    params: LanguageParams

    def better(self, texts: list[str | None], name: list[str], cosine: np.ndarray, rejected: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The nearest centroid's language, cosine and rejection where it is nearer than what is given (-1: nothing yet)."""
        cosine, rejected = cosine.copy(), rejected.copy()
        for low, high in row_slices(texts, 1 << 20, 256):
            tf, letters = frequencies(texts[low:high], self.params)
            near = whole(unit(tf * self.idf)) @ whole(self.centroids).T / (_WHOLE * _WHOLE)
            best = near.argmax(1)
            near = near[np.arange(high - low), best]
            for i in np.flatnonzero(letters & (near > cosine[low:high])).tolist():
                name[low + i] = self.names[best[i]]
                cosine[low + i] = near[i]
                rejected[low + i] = 1 - near[i] > self.radius[best[i]]
        return name, cosine, rejected


def frequencies(texts: list[str | None], params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 1 + log of n-gram counts by bucket, and whether each text has a letter."""
    size = 1 << params.bits
    chars, rows = codes(texts, 1)
    is_letter = letter_table()[chars]
    letters = np.bincount(rows[is_letter], minlength=len(texts)) > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each run of letters
    keep[:1] = True
    chars, rows = np.where(is_letter, chars, 32)[keep].astype(np.uint32), rows[keep]
    counts = np.zeros(len(texts) * size)
    for n in params.sizes:
        found = buckets(chars, n, params.bits)
        if len(found):
            inside = rows[: len(found)] == rows[n - 1 :]
            counts += np.bincount(rows[: len(found)][inside].astype(np.int64) * size + found[inside], minlength=len(counts))
    np.log1p(counts, out=counts)
    return counts.reshape(len(texts), size).astype(np.float32), letters


_WHOLE = 2.0**20


def whole(x: np.ndarray) -> np.ndarray:
    """Components in whole multiples of 2^-20; products of such rows of length 1 are exact."""
    return np.rint(x.astype(np.float64) * _WHOLE)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length == 0, 1, length)


def clustered(x: np.ndarray, params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by spherical k-means, and the radius of each."""
    c = x[np.linspace(0, len(x) - 1, min(params.clusters, len(x))).astype(int)]
    for _ in range(params.rounds):
        nearest = (x @ c.T).argmax(1)
        c = np.stack([unit(x[nearest == j].sum(0, keepdims=True))[0] if (nearest == j).any() else c[j] for j in range(len(c))])
    near = x @ c.T
    nearest = near.argmax(1)
    away = [1 - near[nearest == j, j] for j in range(len(c))]
    return c, np.array([a.mean() + params.spread * max(a.std(), 0.02) if len(a) else 0.0 for a in away])


def fit_language(docs: DataFrame, params: LanguageParams = LanguageParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count document frequencies over all training rows, sample each language, and cluster each sample in a task."""
    ensure_checkpoint_dir(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_t")).filter(F.col("_id").isNotNull() & F.col("_l").isNotNull() & F.col("_t").isNotNull() & ~held_out("_id", params.fold))
    size = 1 << params.bits

    def held_by(batches):
        found, rows = np.zeros(size + 1, np.int64), 0  # the last one counts texts
        for batch in batches:
            texts = text_list(batch.column(0))
            for low, high in row_slices(texts, 1 << 20, 256):
                tf, letters = frequencies(texts[low:high], params)
                found[:size] += (tf > 0).sum(0)
                found[size] += letters.sum()
                rows += high - low
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(found)], ["bucket", "n"])

    counted = usable.select("_t").mapInArrow(held_by, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + 1)
    total[counted["bucket"]] = counted["n"]
    idf = (np.log((1 + total[size]) / (1 + total[:size])) + 1).astype(np.float32)

    def vectors(batches):
        for batch in batches:
            texts = text_list(batch.column(2))
            for low, high in row_slices(texts, 1 << 20, 256):
                tf, letters = frequencies(texts[low:high], params)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([row.tobytes() for row in tf], pa.binary())], ["l", "h", "v"])
                yield out.filter(pa.array(letters))

    # twice the sample passes by a hash below its language's share; the least hashes of those are the sample
    hashed = usable.withColumn("_h", F.xxhash64("_id", "_t"))
    shares = usable.groupBy("_l").agg(F.least(F.lit(1.0), F.lit(2.0 * params.per_language) / F.count(F.lit(1))).alias("_share")).checkpoint()
    if shares.count() <= 1_000_000:  # names of languages, some 100 MB at most; more of them are joined by shuffle
        shares = F.broadcast(shares)
    place = (F.col("_h").cast("double") + 2.0**63) / 2.0**64
    passed = hashed.join(shares, "_l").filter(place < F.col("_share"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    sample = passed.select("_l", "_h", "_t").mapInArrow(vectors, "l string, h long, v binary").withColumn("r", rank).filter(F.col("r") <= params.per_language)

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        x = unit(np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in group.column("v")]) * idf)
        c, radius = clustered(x, params)
        return pa.table([pa.array([group.column("l")[0].as_py()] * len(c)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(radius, pa.float64()), pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary())], names=["l", "j", "radius", "centroid"])

    centroids = sample.groupBy("l").applyInArrow(cluster, "l string, j int, radius double, centroid binary").checkpoint()
    names = sorted((r["l"] for r in centroids.select("l").distinct().toLocalIterator()), key=lambda l: l.encode())
    return LanguageModel(names, idf, centroids, params)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, lang_pred (the nearest language), score, rejected, and accepted (`und` where rejected)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(held_out(id_col, model.params.fold), F.lit(False))
    found = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"), F.lit(UNDETERMINED).alias("name"), F.lit(-1.0).alias("cosine"), F.lit(True).alias("rejected"))
    for block in model.blocks():
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def nearest(batches, shared=shared):
            block = shared.value
            for batch in batches:
                name, cosine, rejected = block.better(text_list(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(name, pa.string()), pa.array(cosine), pa.array(rejected)], batch.schema.names)

        found = found.mapInArrow(nearest, f"id {kind}, held boolean, text string, name string, cosine double, rejected boolean")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine")))
    accepted = F.when(F.col("rejected"), F.lit(UNDETERMINED)).otherwise(F.col("name"))
    return found.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("name").alias("lang_pred"), score.alias("score"), "rejected", accepted.alias("accepted"))
