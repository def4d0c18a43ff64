"""Language-model scores from a log-frequency Bloom filter.

Tokens are a text's words, A-Z lower-cased, and one end; the first word follows an end too.
Counts of words and of pairs of neighbours over all training texts are quantised to
1 + floor(log2(count)), and a count of level q is entered as the q memberships (n-gram, 1)
to (n-gram, q). A probe asks for (n-gram, 1), (n-gram, 2) and so on until one is missing:
the last one found is the level. Probabilities interpolate the pair's and the word's
estimates, with one added to each word count for smoothing.

The filter has a segment for each hash range, sized for all its entries. It grows with the
corpus, so it is never in one place: each block of documents asks the hash ranges for its
distinct words and pairs, as packed rows. A range probes its segment for their levels and
looks up the words' exact counts, which base scores need, and answers in the order asked.
Words are told apart by 64-bit hashes. Nothing but the token total and the vocabulary's
size goes to the driver.

Defined results: a null text is empty and has its end only; rows with null ids are not
learned from and are not held out; repeated rows count and are scored each; without
training rows all counts are 0. Other columns are not read and an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.blocks import blocked, cut_by_part, joined, packed, parts_of, table_batches
from siltstone.llm.wordbytes import BLANKS, Words, mixed, text_slices
from siltstone.session import ensure_checkpoint_dir

END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LmParams:
    """pair_weight: share of the pair estimate; hashes: bits per membership; the others of words and chars bound what a task holds."""

    pair_weight: float = 0.6
    hashes: int = 4
    fold: int = 7
    held: int = 2
    flush_words: int = 4_000_000
    block_chars: int = 16_000_000
    part_chars: int = 32_000_000


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's words and then its end, and the row of each token."""
    words = Words(text, BLANKS, lower=True)
    n_rows = len(words.first) - 1
    rows = np.arange(n_rows)
    out = np.full(len(words) + n_rows, END, np.uint64)
    out[np.arange(len(words)) + words.row] = words.hashes()
    return out, np.repeat(rows, np.diff(words.first) + 1)


def pairs(token: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; every row follows an end.

    48 bits tell pairs apart well enough for the filter.
    """
    before = np.concatenate([[END], token[:-1]])
    return mixed(before * _PAIR + token) & ~np.uint64(0xFFFF)


def gaps(keys: np.ndarray, low: int = 0) -> bytes:
    """Ascending distinct keys, whose `low` last bits are 0: the first one, and the gaps after it as planes of bytes."""
    keys = keys >> np.uint64(low)
    gap = np.diff(keys)
    width = (int(gap.max(initial=0)).bit_length() + 7) // 8
    return keys[:1].tobytes() + bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(keys) else b""


def keys_of(raw: pa.Scalar, low: int = 0) -> np.ndarray:
    """The keys that `gaps` packed."""
    data = np.frombuffer(raw.as_buffer(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    width = int(data[8])
    planes = data[9:].reshape(width, -1) if width else np.zeros((0, 0), np.uint8)
    wide = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    wide[0] = data[:8]
    wide[1:, :width] = planes.T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(low)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)), and 0 for none."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def level_value(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts."""
    return np.where(level > 0, (1.5 * 2.0 ** (level - 1)) - 0.5, 0.0)


def _positions(keys: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    y = mixed(keys + np.uint64(level * int(_LEVEL) % 2**64))
    h = (y + np.uint64(i) * ((y >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((h * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray, hashes: int) -> bytes:
    """The bits of a segment that holds every level of all keys."""
    q = levels(counts)
    bits = -(-int(int(q.sum()) * hashes / np.log(2) + 64) // 64) * 64
    segment = np.zeros(bits // 8, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        for i in range(hashes):
            at = _positions(keys, level, i, bits)
            np.bitwise_or.at(segment, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return segment.tobytes()


def found_levels(segment: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    """Of each key, the last level found by probes of its segment."""
    out = np.zeros(len(keys), np.uint8)
    stays = np.arange(len(keys) if len(segment) else 0)
    level = 0
    while len(stays):
        level += 1
        for i in range(hashes):
            at = _positions(keys[stays], level, i, len(segment) * 8)
            stays = stays[(segment[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out[stays] = level
    return out


@dataclass
class LmModel:
    """All training tokens and distinct ones; `counts` keeps exact counts and the filter's segments by hash range."""

    total: int
    distinct: int
    counts: DataFrame
    params: LmParams
    parts: int


COUNTS = "part int, words binary, word_n binary, n long, v long, bits binary"


def train(docs: DataFrame, params: LmParams = LmParams(), text_col: str = "text") -> LmModel:
    """Counts of words and pairs over all rows of `docs`, gathered by hash range."""
    ensure_checkpoint_dir(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text_col))).collect()[0][0] or 0
    parts = max(parts_of(docs), -(-chars // params.part_chars))
    hashes, flush = params.hashes, params.flush_words

    def gather(batches):
        held: list[np.ndarray] = []
        held_pairs: list[np.ndarray] = []

        def rows():
            out = {}
            for name, arrays, low in (("w", held, 0), ("p", held_pairs, 16)):
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                for p, a, b in cut_by_part(keys, parts):
                    out.setdefault(p, {})[name] = [gaps(keys[a:b], low), n[a:b].astype(np.uint32).tobytes()]
            held.clear()
            held_pairs.clear()
            cells = [(p, *x.get("w", [b"", b""]), *x.get("p", [b"", b""])) for p, x in out.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", "words", "word_n", "pairs", "pair_n"])

        n = 0
        for batch in batches:
            for part in text_slices(batch):
                token, _ = tokens(part.column(0))
                held.append(token)
                held_pairs.append(pairs(token))
                n += len(token)
                if n >= flush:
                    yield rows()
                    n = 0
        if n:
            yield rows()

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        words, n = _summed(np.concatenate([keys_of(x) for x in table.column("words")]), joined(table.column("word_n"), np.uint32))
        pair, m = _summed(np.concatenate([keys_of(x, 16) for x in table.column("pairs")]), joined(table.column("pair_n"), np.uint32))
        bits = build_segment(np.concatenate([words, pair]), np.concatenate([n, m]), hashes)
        row = [part, words.tobytes(), n.astype(np.int64).tobytes(), int(n.sum()), len(words), bits]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "words", "word_n", "n", "v", "bits"])

    gathered = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(gather, "part int, words binary, word_n binary, pairs binary, pair_n binary")
    counts = gathered.groupBy("part").applyInArrow(merge, COUNTS).checkpoint()
    total, distinct = counts.agg(F.sum("n"), F.sum("v")).collect()[0]
    return LmModel(total or 0, distinct or 0, counts.select("part", "words", "word_n", "bits"), params, parts)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Distinct:
    """The distinct keys of those added; `flush` bounds how many more are held meanwhile."""

    def __init__(self, flush: int):
        self.flush, self.arrays, self.more = flush, [np.zeros(0, np.uint64)], 0

    def add(self, keys: np.ndarray) -> None:
        self.arrays.append(np.unique(keys))
        self.more += len(self.arrays[-1])
        if self.more >= self.flush:
            self.keys()

    def keys(self) -> np.ndarray:
        self.arrays, self.more = [np.unique(np.concatenate(self.arrays))], 0
        return self.arrays[0]


def score(docs: DataFrame, model: LmModel, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts, total, distinct, weight = model.parts, model.total, model.distinct, model.params.pair_weight
    hashes, flush = model.params.hashes, model.params.flush_words
    all_docs = blocked(docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), id_col, text_col, model.params.block_chars, held_out.alias("held"))

    def ask(batches):
        wanted: dict[int, tuple[Distinct, Distinct]] = {}  # a partition has whole blocks, and each asks once for each word and pair
        for batch in batches:
            index = batch.schema.get_field_index
            blocks = batch.column(index("block")).to_numpy()
            for b in np.unique(blocks).tolist():
                words, pair = wanted.setdefault(b, (Distinct(flush), Distinct(flush)))
                for part in text_slices(batch.filter(pa.array(blocks == b))):
                    token, _ = tokens(part.column(index("text")))
                    words.add(token)
                    pair.add(pairs(token))
        for b in list(wanted):
            words, pair = (x.keys() for x in wanted.pop(b))
            out: dict[int, list[bytes]] = {}
            for at, keys, low in ((0, words, 0), (1, pair, 16)):
                for p, first, end in cut_by_part(keys, parts):
                    out.setdefault(p, [b"", b""])[at] = gaps(keys[first:end], low)
            rows = [(p, b, *x) for p, x in out.items()]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "block", "words", "pairs"])

    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        known, n = joined(counts.column("words"), np.uint64), joined(counts.column("word_n"), np.int64)
        segment = joined(counts.column("bits"), np.uint8)
        out: list[tuple[bytes, bytes, bytes]] = []

        def probe(words: list[np.ndarray], pair: list[np.ndarray]) -> None:
            keys = np.concatenate(words)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            count = np.where(known[at] == keys, n[at], 0) if len(known) else np.zeros(len(keys), np.int64)
            level = found_levels(segment, np.concatenate([keys, *pair]), hashes)
            of_word, of_pair = (np.cumsum([len(x) for x in xs])[:-1] for xs in (words, pair))
            cells = (np.split(count, of_word), np.split(level[: len(keys)], of_word), np.split(level[len(keys) :], of_pair))
            out.extend(tuple(packed(*x)) for x in zip(*cells, strict=True))

        words, pair, held = [], [], 0
        for w, p in zip(asked.column("words"), asked.column("pairs"), strict=True):
            words.append(keys_of(w))
            pair.append(keys_of(p, 16))
            held += len(words[-1]) + len(pair[-1])
            if held >= 1_000_000:
                probe(words, pair)
                words, pair, held = [], [], 0
        if words:
            probe(words, pair)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([asked.column("part"), asked.column("block"), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "block", "n", "word_level", "pair_level"])

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        held, words, pair = [], Distinct(flush), Distinct(flush)
        for batch in table_batches(docs):
            for part in text_slices(batch):
                index = part.schema.get_field_index
                token, row = tokens(part.column(index("text")))
                words.add(token)
                pair.add(pairs(token))
                held.append((part.column(index("id")), part.column(index("held")), token, row))
        word_keys, pair_keys = words.keys(), pair.keys()
        answers = answers.sort_by("part")  # hash ranges ascend with the keys, so their answers join to those of all keys
        n = joined(answers.column("n"), np.int64)
        of_word, of_pair = (level_value(joined(answers.column(c), np.uint8).astype(np.int64)) for c in ("word_level", "pair_level"))
        out = []
        for ids, held_row, token, row in held:
            rows = len(ids)
            at = np.searchsorted(word_keys, token)
            c, count = n[at], np.bincount(row, minlength=rows)
            base = np.bincount(row, np.log10(c + 1.0), rows) - count * np.log10(total + distinct + 1)
            end = of_word[np.searchsorted(word_keys, END)]
            p = probabilities(of_word[at], of_pair[np.searchsorted(pair_keys, pairs(token))], end, total, distinct, weight)
            lm = np.bincount(row, np.log10(p), rows)
            values = (held_row, count, np.bincount(row, c > 0, rows).astype(np.int64), np.full(rows, total), base, lm)
            out.append(pa.table([ids, *(v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], docs.schema.field("id").type), *(pa.array([], t) for t in kinds)], names=names)

    asked = all_docs.mapInArrow(ask, "part int, block int, words binary, pairs binary")
    answers = asked.groupBy("part").cogroup(model.counts.groupBy("part")).applyInArrow(answer, "part int, block int, n binary, word_level binary, pair_level binary")
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return all_docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def probabilities(word: np.ndarray, pair: np.ndarray, end: float, total: int, distinct: int, weight: float) -> np.ndarray:
    """Of each token after the one before it, from the values of words, of pairs and of an end."""
    before = np.concatenate([[end], word[:-1]])
    after = np.where(before > 0, np.minimum(pair / np.maximum(before, 1), 1), 0)
    return weight * after + (1 - weight) * (word + 1) / (total + distinct + 1)
