"""N-gram Jaccard join by chosen paths.

Texts are sets of word n-grams (lower-cased A-Z, words between blanks; a text of fewer
words is one gram). Texts with equal sets are one class, and only classes are compared.

1. Each class gets a sketch: for each of `coordinates` hash functions, the least hash of
   its grams. Coordinates stand for tokens: two sets agree in one with the probability of
   their similarity.
2. A run deals classes out to buckets by one coordinate. Buckets of more than `small`
   classes are split again on coordinates that their path chooses: one, or two in one case
   of four, so that at a similarity of 0.8 a pair stays together in one child on average.
   Small buckets are compared by brute force on sketches; those still large at the last
   level are compared in pairs of chunks, so that no pair is lost.
3. Runs, with other first coordinates, repeat until a pair at the threshold is found with
   the target recall, by the probability that it stays together down to the last level.
4. Classes linked by sketches form groups. Each group's gram sets meet, in pairs of chunks
   if they are many, and similarities are computed exactly. Chunks give each class's number
   of links and a spanning forest, never a row for each pair.

A row per input row comes out: its class is the least id among the texts that links
connect, and its links are the rows of similarity at the threshold or above.

Defined results: a null text, or one without words, is in no class but its own and has no
link; null ids are possible and come last as a class's id; repeated rows are copies and
link each other. Other columns are not read and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from siltstone.llm.components import connected_components
from siltstone.llm.wordbytes import BLANKS, Words, gram_hashes, mixed, one_row_grams, text_slices
from siltstone.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class JaccardParams:
    """margin: how far below the threshold a sketch may put a pair of the threshold's similarity."""

    n: int = 5
    threshold: float = 0.8
    coordinates: int = 64
    small: int = 128
    depth: int = 4
    recall: float = 0.999
    margin: float = 0.18
    seed: int = 20240229

    @property
    def runs(self) -> int:
        """Repetitions that reach the recall for a pair at the threshold that is split at every level.

        All runs draw on the same coordinates, so the expectation goes over how many of them
        agree; pairs that the sketches put too low are missed by every run.
        """
        return next((r for r in range(1, self.coordinates + 1) if self.missed(r) <= 1 - self.recall), self.coordinates)

    def missed(self, runs: int) -> float:
        """The probability that `runs` runs lose a pair at the threshold that is split at every level."""
        c, t, out = self.coordinates, self.threshold, 0.0
        for agree in range(c + 1):
            a = agree / c
            together = a * (0.75 * a + 0.25 * (1 - (1 - a) ** 2)) ** (self.depth - 1)
            lost = 1.0 if agree < (t - self.margin) * c else (1 - together) ** runs
            out += comb(c, agree) * t**agree * (1 - t) ** (c - agree) * lost
        return out


def gram_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's distinct gram hashes, ascending."""
    words = Words(text, BLANKS, lower=True)
    h = words.hashes()
    grams, whole = gram_hashes(h, n), one_row_grams(words, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    assert all(whole[a : b - n + 1].all() for a, b in zip(words.first[:1].tolist(), words.first[1:2].tolist(), strict=True) if b - a >= n)
    return out


def set_hash(grams: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    return int((mixed(grams + np.uint64(0x632BE59BD9B4E019)).sum() + np.uint64(len(grams))).astype(np.int64))


def sketches(sets: list[np.ndarray], params: JaccardParams) -> np.ndarray:
    """A row of `coordinates` numbers for each non-empty set."""
    factor = np.random.default_rng(params.seed).integers(0, 2**64, params.coordinates, np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), params.coordinates), np.int32)
    for i, f in enumerate(factor):
        low = np.minimum.reduceat(flat * f, first)
        out[:, i] = (mixed(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def grouped(batches, key: str):
    """Consecutive rows of equal key as one batch each, of batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
        if rest and rest[0].column(rest[0].schema.get_field_index(key))[0].as_py() != keys[0]:
            yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
                rest = []
    if rest:
        yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    n = len(linked)
    free, out = np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            u = front.pop()
            near = np.flatnonzero(linked[u] & free)
            free[near] = False
            out += [(u, int(v)) for v in near]
            front += near.tolist()
    return out


def _joining(linked: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links between two sides that join what links within the sides do not: a spanning forest of the rest."""
    inner = linked & (side[:, None] == side[None, :])
    label = np.arange(len(linked))
    for u, v in _forest(inner):  # a node's edge comes after its parent's
        label[v] = label[u]
    at = np.argwhere(linked & (side[:, None] < side[None, :]))
    if not len(at):
        return []
    _, first = np.unique(label[at[:, 0]] * len(linked) + label[at[:, 1]], return_index=True)
    parent = {int(x): int(x) for x in np.unique(label)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for u, v in at[first].tolist():
        a, b = root(int(label[u])), root(int(label[v]))
        if a != b:
            parent[a] = b
            out.append((u, v))
    return out


def _sketch_links(batches, params: JaccardParams):
    """Spanning forests of the buckets' classes whose sketches agree enough."""
    need = (params.threshold - params.margin) * params.coordinates
    a, b = [], []
    for group in grouped(batches, "key"):
        index = group.schema.get_field_index
        node = group.column(index("node")).to_numpy()
        if len(node) < 2:
            continue
        sketch = group.column(index("sketch")).flatten().to_numpy().reshape(len(node), -1)
        if len(node) == 2:
            if (sketch[0] == sketch[1]).sum() >= need and node[0] != node[1]:
                a.append(int(node[0]))
                b.append(int(node[1]))
        else:
            same = np.zeros((len(node), len(node)), np.int16)
            for i in range(sketch.shape[1]):
                same += sketch[:, None, i] == sketch[None, :, i]
            linked, side = same >= need, group.column(index("chunk")).to_numpy()
            # chunks that meet give links between them only: each chunk's own come where it meets itself
            for u, v in _forest(linked) if (side == side[0]).all() else _joining(linked, side):
                if node[u] != node[v]:
                    a.append(int(node[u]))
                    b.append(int(node[v]))
        if len(a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exact_links(batches, params: JaccardParams):
    """Per class of a pair of chunks: rows and classes that it links to, and an edge of a spanning forest."""
    t = params.threshold
    out = [[], [], [], []]
    for group in grouped(batches, "key"):
        index = group.schema.get_field_index
        node, first = np.unique(group.column(index("node")).to_numpy(), return_index=True)
        group = group.take(pa.array(first))
        copies, chunk = (group.column(index(c)).to_numpy() for c in ("copies", "chunk"))
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(index("grams"))]
        size = np.array([len(g) for g in grams])
        shared = common(grams)
        union = size[:, None] + size[None, :] - shared
        linked = shared >= t * union - 1e-9
        np.fill_diagonal(linked, False)
        low, high = group.column(index("low"))[0].as_py(), group.column(index("high"))[0].as_py()
        if low != high:  # links within a chunk are counted where the chunk meets itself
            linked &= chunk[:, None] != chunk[None, :]
        forest = dict((v, u) for u, v in _forest(linked))
        for i in range(len(node)):
            out[0].append(int(node[i]))
            out[1].append(int(node[forest[i]]) if i in forest else None)
            out[2].append(int(copies[linked[i]].sum()))
            out[3].append(int(linked[i].sum()))
        if len(out[0]) >= 10_000:
            yield _links_batch(out)
            out = [[], [], [], []]
    if out[0]:
        yield _links_batch(out)


def _links_batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "rows", "classes"])


def common(grams: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many grams each two sets share."""
    n = len(grams)
    flat, row = np.concatenate(grams), np.repeat(np.arange(n), [len(g) for g in grams])
    _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times[gram] > 1
    rank = np.cumsum(times > 1) - 1
    row, gram = row[several], rank[gram[several]]
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, columns):
        a, b = np.searchsorted(gram, [low, low + columns])
        held = np.zeros((n, min(columns, int(gram[-1]) + 1 - low)), np.float32)
        held[row[a:b], gram[a:b] - low] = 1
        out += held @ held.T
    return out


def _classes(docs: DataFrame, params: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """Per row: (id, node, size, sketch); node and sketch are null where there is no word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = gram_sets(part.column(1), params.n)
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full, params) if full else ())
                lists = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["id", "node", "sketch"])

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(sketch, f"id {kind}, node long, sketch array<int>")


def _chunk_pairs(rows: DataFrame, count: str, size: int) -> DataFrame:
    """Each row once for every pair of chunks of its bucket that its chunk is in."""
    chunks = F.ceil(F.col(count) / size).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other", "chunks")


def _candidates(classes: DataFrame, params: JaccardParams) -> DataFrame:
    """Edges (a, b) between classes that a run's buckets hold together and whose sketches agree enough."""
    t = params.coordinates
    step = t // params.runs
    runs = F.array(*[F.struct(F.xxhash64(F.lit(r), F.element_at("sketch", r * step + 1)).alias("path")) for r in range(params.runs)])
    members = classes.select("node", F.inline(runs))
    sketch = classes.select("node", "sketch")
    found = None
    at = lambda path, salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(t)).cast("int") + 1
    child = lambda path, salt: F.xxhash64(path, at(path, salt), F.element_at("sketch", at(path, salt)))
    second = lambda path: F.pmod(F.xxhash64(path, F.lit("two")), F.lit(4)) == 0
    children = lambda path: F.when(second(path), F.array(child(path, "a"), child(path, "b"))).otherwise(F.array(child(path, "a")))
    for level in range(1, params.depth + 1):
        members = members.checkpoint()
        counts = members.groupBy("path").count().filter("count > 1")
        several = members.join(counts, "path")
        last = level == params.depth
        held = several if last else several.filter(F.col("count") <= params.small)
        held = held.select("node", "path", "count")
        found = held if found is None else found.unionAll(held)
        if not last:
            # a class meets its sketch once for all its paths, of which it has a few for each run
            large = several.filter(F.col("count") > params.small).groupBy("node").agg(F.collect_list("path").alias("paths"))
            below = F.array_distinct(F.flatten(F.transform("paths", children)))
            members = large.join(sketch, "node").select("node", F.explode(below).alias("path"))
    keyed = found.groupBy("node").agg(F.collect_list(F.struct("path", "count")).alias("held")).join(sketch, "node").select("node", "sketch", F.inline("held"))
    keyed = _chunk_pairs(keyed, "count", params.small).select(F.xxhash64("path", "low", "high").alias("key"), "node", "chunk", "sketch")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _sketch_links(batches, params), "a long, b long")


def _linked_classes(docs: DataFrame, params: JaccardParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, rep, class_id, n_links) of every class."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = _classes(docs, params, id_col, text_col).checkpoint()
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("sketch").alias("sketch"))
    classes = classes.checkpoint()
    groups = connected_components(_candidates(classes, params))
    members = groups.join(classes.select("node", "rep", "copies"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("count"))
    members = members.join(sizes, "root")

    # the gram sets of groups' classes, made again from one text of each
    wanted = members.select("node", "root", "count", "copies", F.col("rep"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    fetched = texts.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep"))).select("text", "node", "root", "count", "copies")

    def grams(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = gram_sets(part.column(0), params.n)
                own = pa.array([len(s) > 0 and set_hash(s) == n for s, n in zip(sets, part.column(1).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "count", "copies", "grams"])
                yield out.filter(own)

    sets = fetched.mapInArrow(grams, "node long, root long, count long, copies long, grams binary")
    paired = _chunk_pairs(sets, "count", params.small).select(F.xxhash64("root", "low", "high").alias("key"), "node", "copies", "chunk", "low", "high", "grams")
    dealt = paired.repartition("key").sortWithinPartitions("key")
    links = dealt.mapInArrow(lambda batches: _exact_links(batches, params), "a long, b long, rows long, classes long").checkpoint()
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("linked"))
    parts = connected_components(links.select("a", "b"))
    # each component's least id, and the links of each of its classes
    facts = classes.select("node", "rep", "copies").join(parts, "node", "left").join(counted, "node", "left")
    facts = facts.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    least = facts.groupBy("root").agg(F.min("rep").alias("class_id"))
    facts = facts.join(least, "root").select("node", "rep", "class_id", (F.col("copies") - 1 + F.col("linked")).alias("n_links"))
    return rows.select("id", "node"), facts


def jaccard_classes(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, class_id, copy_of (least id of an equal set) and n_links."""
    rows, facts = _linked_classes(docs, params, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.join(facts, "node", "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("rep")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class, the row with its least id, with all its columns; rows without words all stay."""
    _, facts = _linked_classes(docs, params, id_col, text_col)
    # of several sets with the class's least id, the least set
    kept = facts.filter(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias("_node")).select("_node", F.col("class_id").alias("_rep"))
    at, names = docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own = f"_{names.index(id_col)}"

    def tag(batches):
        for batch in batches:
            for part in text_slices(batch, f"_{at}"):
                sets = gram_sets(part.column(at), params.n)
                nodes = pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, nodes], [*part.schema.names, "_node"])

    tagged = plain.mapInArrow(tag, StructType([*plain.schema.fields]).add("_node", LongType()))
    chosen = tagged.filter("_node IS NOT NULL").join(kept.hint("shuffle_hash"), "_node").filter(F.col(own).eqNullSafe(F.col("_rep")))
    rank = F.row_number().over(Window.partitionBy("_node", own).orderBy(F.xxhash64(*plain.columns)))
    chosen = chosen.withColumn("_r", rank).filter("_r = 1").select(*plain.columns)
    return chosen.unionAll(tagged.filter("_node IS NULL").select(*plain.columns)).toDF(*names)
