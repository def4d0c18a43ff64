"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is
one window. Document words inside any occurrence of a window are hit.

Winnowing keeps, of each `window - k + 1` consecutive k-gram hashes, the least. Two equal
spans of `window` words have the same k-grams and so keep the same least one: a document
that holds an item's window shares a fingerprint with it. Document fingerprints are looked
up among the items' fingerprints, and each hit is extended to the windows around it, whose
words are compared as they are; so hashes only find candidates and decide nothing. Items
shorter than a window are found by hashes of their own length, and compared likewise.

A benchmark of up to `block_words` words is one block, whose table is broadcast. A larger one
stays distributed: executors make its windows, a Bloom filter of at most `filter_bits` bits
over the windows' fingerprints is broadcast, and documents' windows that pass it meet the
benchmark's by shuffle, joined on their words. So what each executor holds does not grow with
the benchmark, and windows that the filter lets through in vain only cost their row.

Defined results: null texts have no words; an item without words has no window; null ids
are ids like others (of items, they are left out); repeated rows of a document give
repeated results, items of the same text are different items, repeated item ids count once.
Other columns are not read, and empty tables give an empty result or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.wordbytes import NOT_ALNUM, Words, gram_hashes, mixed, one_row_grams, text_slices, window_minima
from siltstone.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class WinnowParams:
    """window: words of a shared span that is always found; k: words of a fingerprint; block_words and filter_bits bound what is broadcast."""

    window: int = 10
    k: int = 5
    block_words: int = 400_000
    filter_bits: int = 1 << 28


class Block:
    """A block of the benchmark: its windows' words, their items, and the fingerprints that lead to them."""

    def __init__(self, ids: list[str], texts: list[str], params: WinnowParams):
        self.params = params
        self.items: dict[bytes, list[str]] = defaultdict(list)
        words = Words(pa.array(texts, pa.string()), NOT_ALNUM, lower=True)
        shorter: set[int] = set()
        for i, item in enumerate(ids):
            first, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
            if not n:
                continue
            size = min(n, params.window)
            if size < params.window:
                shorter.add(size)
            for j in range(first, first + n - size + 1):
                held = self.items[words.bytes_of(j, j + size)]
                if not held or held[-1] != item:
                    held.append(item)
        h = words.hashes()
        kept, _ = fingerprints(words, h, params)
        self.prints = np.unique(kept)
        self.short: dict[int, np.ndarray] = {}
        for size in shorter:
            grams = gram_hashes(h, size)
            whole = words.first[:-1][np.diff(words.first) == size]
            self.short[size] = np.unique(grams[whole])
        self.items = dict(self.items)


def fingerprints(words: Words, hashes: np.ndarray, params: WinnowParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the k-grams that winnowing keeps."""
    grams = gram_hashes(hashes, params.k)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    w = params.window - params.k + 1
    low = window_minima(grams, w)
    keep = np.zeros(len(grams), bool)
    whole = one_row_grams(words, params.window)
    for j in range(w):
        keep[j : j + len(low)] |= (grams[j : j + len(low)] == low) & whole
    at = np.flatnonzero(keep)
    return grams[at], at


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def find_hits(words: Words, block: Block) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and by row the items that have occurring windows."""
    p = block.params
    hit, items = np.zeros(len(words), bool), defaultdict(set)
    h = words.hashes()

    def extend(start: int, size: int) -> None:
        found = block.items.get(words.bytes_of(start, start + size))
        if found:
            hit[start : start + size] = True
            items[int(words.row[start])].update(found)

    kept, at = fingerprints(words, h, p)
    shared = at[member(kept, block.prints)]
    starts: set[int] = set()
    for position in shared.tolist():
        row = int(words.row[position])
        low, high = int(words.first[row]), int(words.first[row + 1])
        starts.update(range(max(low, position - (p.window - p.k)), min(position, high - p.window) + 1))
    for start in sorted(starts):
        extend(start, p.window)
    for size, table in block.short.items():
        grams = gram_hashes(h, size)
        for start in np.flatnonzero(member(grams, table) & one_row_grams(words, size)).tolist():
            extend(start, size)
    return hit, items


def _usable(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()


def _one_block(usable: DataFrame, params: WinnowParams) -> Block | None:
    """The whole benchmark as one block, or None where it has more words than that."""
    words = F.length(F.regexp_replace("text", "[^ \n\t]+", "")) + F.length("text") / 8 + 1
    if (usable.agg(F.sum(words)).collect()[0][0] or 0) > params.block_words:
        return None
    rows = sorted((r["item"], r["text"]) for r in usable.collect())
    return Block([r[0] for r in rows], [r[1] for r in rows], params)


def windows_of(words: Words, sizes: list[int], params: WinnowParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the full size and each of the shorter `sizes`: the size, the windows' first words and their fingerprints."""
    h = words.hashes()
    whole = one_row_grams(words, params.window)
    low = window_minima(gram_hashes(h, params.k), params.window - params.k + 1)
    yield params.window, np.flatnonzero(whole), low[whole]
    for size in sizes:
        at = np.flatnonzero(one_row_grams(words, size))
        yield size, at, mixed(gram_hashes(h, size)[at] + np.uint64(size))


class Bloom:
    """A bit set over fingerprints; `holds` never misses one that was put in."""

    PROBES = 4

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def places(cls, prints: np.ndarray, bits: int) -> np.ndarray:
        shift = np.uint64(64 - (bits.bit_length() - 1))
        return np.stack([mixed(prints + np.uint64(j)) >> shift for j in range(cls.PROBES)])

    def holds(self, prints: np.ndarray) -> np.ndarray:
        at = self.places(prints, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


@dataclass
class Benchmark:
    """windows: (w, items), each window's words with the items that have it; bloom over their fingerprints; sizes of short items."""

    windows: DataFrame
    bloom: Broadcast
    sizes: list[int]
    params: WinnowParams

    @classmethod
    def of(cls, usable: DataFrame, params: WinnowParams) -> Benchmark:
        def make(batches):
            for batch in batches:
                for part in text_slices(batch):
                    words = Words(part.column(1), NOT_ALNUM, lower=True)
                    n = np.diff(words.first)
                    for size, at, prints in windows_of(words, list(range(1, params.window)), params):
                        own = (n[words.row[at]] >= params.window) if size == params.window else n[words.row[at]] == size
                        for low in range(0, len(at), _ROWS):
                            cut = slice(low, low + _ROWS)
                            first, kept = at[cut][own[cut]], prints[cut][own[cut]]
                            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(words.row[first])), pa.array([words.bytes_of(i, i + size).decode() for i in first.tolist()], pa.string()), pa.array(kept.view(np.int64)), pa.array(np.full(len(first), size))], ["item", "w", "print", "size"])

        made = usable.mapInArrow(make, "item string, w string, print long, size long")
        # an item of a size lists itself once, however often its window occurs in it
        windows = made.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("print").alias("print"), F.max("size").alias("size")).checkpoint()
        found = windows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
        total = sum(r["n"] for r in found)
        bits = min(params.filter_bits, max(1 << 16, 1 << (16 * total - 1).bit_length()))

        def put(batches):
            words = np.zeros(bits >> 6, np.uint64)
            for batch in batches:
                at = Bloom.places(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            held = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(words[held].view(np.int64))], ["at", "bits"])

        united = windows.select("print").mapInArrow(put, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[united.column("at").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
        sizes = sorted(r["size"] for r in found if r["size"] < params.window)
        return cls(windows.select("w", "items"), usable.sparkSession.sparkContext.broadcast(Bloom(bits, words)), sizes, params)

    def candidates(self, words: Words, bloom: Bloom) -> Iterator[tuple[int, np.ndarray]]:
        """By size, the first words of windows that pass the filter."""
        for size, at, prints in windows_of(words, self.sizes, self.params):
            yield size, at[bloom.holds(prints)]

    def marker(self):
        """A function of words and filter that leaves the windows' table with the driver."""
        return Benchmark(None, None, self.sizes, self.params).candidates

    def windows_in(self, docs: DataFrame, key: str) -> DataFrame:
        """For (key, text) rows: a row without w for each, with n_words and `asked`, and a row for each of its windows that pass the filter."""
        shared, candidates = self.bloom, self.marker()

        def scan(batches):
            for batch in batches:
                for part in text_slices(batch):
                    words = Words(part.column(1), NOT_ALNUM, lower=True)
                    asked = np.zeros(part.num_rows, bool)
                    for size, at in candidates(words, shared.value):
                        asked[words.row[at]] = True
                        for low in range(0, len(at), _ROWS):
                            first = at[low : low + _ROWS]
                            row = words.row[first]
                            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(first - words.first[row]), pa.array(np.full(len(first), size)), pa.array([words.bytes_of(i, i + size).decode() for i in first.tolist()], pa.string()), pa.nulls(len(first), pa.bool_())], names)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first)), pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.string()), pa.array(asked)], names)

        names = ["key", "at", "size", "w", "asked"]
        return docs.select(F.col(key).alias("key"), "text").mapInArrow(scan, f"key {docs.schema[key].dataType.simpleString()}, at long, size long, w string, asked boolean")

    def hits(self, found: DataFrame) -> DataFrame:
        """(key, at, size, items) of those windows that the benchmark has."""
        return found.filter("w IS NOT NULL").dropDuplicates(["key", "at", "size"]).join(self.windows, "w").select("key", "at", "size", "items")


#: Windows in one Arrow batch.
_ROWS = 10_000


def _digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_contamination(docs: DataFrame, items: DataFrame, params: WinnowParams = WinnowParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: the id, counts of words, hit words and items, a digest of the items, and whether any word is hit."""
    kind = docs.schema[id_col].dataType.simpleString()
    usable = _usable(items, item_col, item_text_col)
    block = _one_block(usable, params)
    if block is None:
        return _contamination_by_shuffle(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"), F.col(text_col).alias("text")), Benchmark.of(usable, params), id_col)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        block = shared.value
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column(1), NOT_ALNUM, lower=True)
                hit, found = find_hits(words, block)
                n = np.diff(words.first)
                hits = np.bincount(words.row[hit], minlength=len(n)).astype(np.int64)
                lists = [found.get(i, ()) for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(hits), pa.array([len(x) for x in lists], pa.int64()), pa.array([_digest(x) for x in lists]), pa.array(hits > 0)], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")


def _contamination_by_shuffle(keyed: DataFrame, bench: Benchmark, id_col: str) -> DataFrame:
    """The result for (key, text) rows, key being the id and the text's hash; repeated rows share a key and its hits."""
    ensure_checkpoint_dir(keyed.sparkSession)
    found = bench.windows_in(keyed, "key").checkpoint()
    rows = found.filter("w IS NULL").select("key", F.col("at").alias("n_words"), "asked")
    by_place = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    # words that no earlier window of the document covers
    new = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(by_place), F.lit(0))))
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    hits = bench.hits(found).withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"), lists.alias("items"))
    asked = rows.filter("asked").alias("r").join(hits.alias("s"), F.col("r.key").eqNullSafe(F.col("s.key")), "left").select("r.key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    clean = rows.filter("NOT asked").select("key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    return asked.unionAll(clean).select(F.col("key.id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, params: WinnowParams = WinnowParams(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which no word is hit."""
    at = docs.columns.index(text_col)
    usable = _usable(items, item_col, item_text_col)
    block = _one_block(usable, params)
    if block is None:
        return _drop_by_shuffle(docs, Benchmark.of(usable, params), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                words = Words(part.column(at), NOT_ALNUM, lower=True)
                hit, _ = find_hits(words, shared.value)
                yield part.filter(pa.array(np.bincount(words.row[hit], minlength=part.num_rows) == 0))

    return docs.mapInArrow(scan, docs.schema)


def _drop_by_shuffle(docs: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    """Rows of texts without a window that passes the filter stay where they are; only the others are shuffled, by their texts' digests."""
    ensure_checkpoint_dir(docs.sparkSession)
    at, shared, candidates = docs.columns.index(text_col), bench.bloom, bench.marker()

    def mark(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                words = Words(part.column(at), NOT_ALNUM, lower=True)
                asked = np.zeros(part.num_rows, bool)
                for _, first in candidates(words, shared.value):
                    asked[words.row[first]] = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(asked)], [*part.schema.names, "_asked"])

    marked = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("_asked", T.BooleanType())]))
    asked = marked.filter("_asked").drop("_asked").withColumn("_key", F.sha2(text_col, 256)).checkpoint()
    texts = asked.select(F.col("_key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    hit = bench.hits(bench.windows_in(texts, "key")).select(F.col("key").alias("_key")).distinct()
    return marked.filter("NOT _asked").drop("_asked").unionAll(asked.join(hit, "_key", "left_anti").select(*docs.columns))


CONTAMINATION_ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, list_slice(w, i, i + size - 1) AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size),
m AS (SELECT r, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
