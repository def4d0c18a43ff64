"""Removal of repeated word sequences, with an FM-index per shard.

A window is `window` consecutive words of one document. A word goes if a window over it
starts earlier too: in a document of smaller id, or earlier in its own.

Windows meet in shards by their minimiser, the least hash of their k-grams (the first, if
it is there twice), which equal windows share. Neighbouring windows with one minimiser are
a unit.

1. Blocks of documents send the counts of their minimisers to hash ranges, and learn which
   occur again anywhere. Windows of the others are unique.
2. They send units whose minimiser occurs again, each distinct one of a block once. A
   minimiser that occurs more than `hot` times (of a passage that very many documents
   share, in as many contexts) does not draw all these units to one shard: its windows go
   alone, by their own hash.
3. A shard joins equal units, keeps where each starts first, and indexes their words: an
   FM-index on a wavelet matrix whose bits are compressed. The units are streamed through it
   from their ends, and matching statistics are carried: the matched length grows by backward
   search to a window's, and then each step drops the last word and puts one in front. The
   interval of a window holds all its starts, and so the first.
4. Blocks get their units' first starts back and mark the words.

Words are told apart by 64-bit hashes, of which the index's alphabet has 32 bits; no word
is compared alone, only windows as wholes. What a block or a shard holds is bounded: there
are as many shards as the text needs at `shard_chars` each, and a common passage reaches its
shard once per block.

Ids are whole numbers, whose order says what is earlier; other types are refused with a
TypeError when the query is made.

Defined results: a null text has no words; a null id counts as less than any other; rows
that repeat an id are one document's, so windows at the same position in them are not
earlier than each other; with fewer words than a window nothing goes. Other columns are
not read and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.llm.blocks import blocked, cut_by_part, joined, parts_of, range_part, table_batches
from siltstone.llm.fmindex import FmIndex
from siltstone.llm.wordbytes import BLANKS, Words, gram_hashes, mixed, one_row_grams, text_slices, window_minima

_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class SubstringParams:
    """window: words of a sequence that counts; k: words of a minimiser; hot: occurrences that split one; the others bound what a task holds."""

    window: int = 20
    k: int = 8
    hot: int = 1000
    block_chars: int = 6_000_000
    shard_chars: int = 3_000_000


class Units:
    """Units of a slice of documents: start (word), many (windows), print (minimiser)."""

    def __init__(self, words: Words, params: SubstringParams):
        self.words, self.hash = words, words.hashes()
        n, w = len(words) - params.window + 1, params.window - params.k + 1
        self.start = self.many = np.zeros(0, np.int64)
        self.print = self.whole_hash = np.zeros(0, np.uint64)
        if n <= 0:
            return
        grams = gram_hashes(self.hash, params.k)
        low = window_minima(grams, w)
        at = np.zeros(n, np.int64)
        for j in range(w - 1, -1, -1):
            at[grams[j : j + n] == low] = j
        at += np.arange(n)
        inside = one_row_grams(words, params.window)
        begins = inside.copy()
        begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        self.start = np.flatnonzero(begins)
        self.many = np.flatnonzero(ends) + 1 - self.start
        self.print = low[self.start]
        self.whole_hash = gram_hashes(self.hash, params.window)

    def chosen(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units with status 1, and of the windows of those with 2: start, many, key that deals out, id of the content."""
        once, hot = np.flatnonzero(status == 1), np.flatnonzero(status == 2)
        many = self.many[hot]
        single = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[hot], many)
        start = np.concatenate([self.start[once], single])
        count = np.concatenate([self.many[once], np.ones(len(single), np.int64)])
        first, last = (self.whole_hash[x] if len(x) else np.zeros(0, np.uint64) for x in (start, start + count - 1))
        content = mixed(first * _A + last * _B + count.astype(np.uint64))
        key = np.concatenate([self.print[once], mixed(first[len(once) :])])
        return start, count, key, content


def _status(prints: np.ndarray, known: np.ndarray, kind: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(prints), np.uint8)
    at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
    return np.where(known[at] == prints, kind[at], 0)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Positions of the first of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, many[i] of them."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


_FOUND = (("block", pa.int32()), ("content", pa.binary()), ("many", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()))


def _rows(rows: list[tuple], fields) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _slices(docs: pa.Table):
    for batch in table_batches(docs):
        yield from text_slices(batch)


def mark_repeats(docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256, and with keep_text the kept words."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of a whole-number type, since its order decides which occurrence stays")
    chars = docs.agg(F.sum(F.length(text_col))).collect()[0][0] or 0
    parts, window, hot = max(2 * parts_of(docs), -(-chars // params.shard_chars)), params.window, params.hot  # a shard is a group of rows, not a partition
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc")
    kind = docs.schema[id_col].dataType.simpleString()
    all_docs = blocked(docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), id_col, text_col, params.block_chars, order)

    def count(batches):
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            rows = []
            for b in np.unique(blocks).tolist():
                prints = [Units(Words(s.column(s.schema.get_field_index("text")), BLANKS), params).print for s in text_slices(batch.filter(pa.array(blocks == b)))]
                keys, n = np.unique(np.concatenate(prints), return_counts=True)
                rows += [(p, b, keys[low:high].tobytes(), n[low:high].astype(np.uint32).tobytes()) for p, low, high in cut_by_part(keys, parts)]
            if rows:
                yield from _rows(rows, (("part", pa.int32()), ("block", pa.int32()), ("prints", pa.binary()), ("n", pa.binary()))).to_batches()

    def again(table: pa.Table) -> pa.Table:
        keys, n = joined(table.column("prints"), np.uint64), joined(table.column("n"), np.uint32)
        by = np.argsort(keys)
        first = _firsts(keys[by])
        known, total = keys[by][first], np.add.reduceat(n[by].astype(np.int64), first) if len(first) else first
        out = []
        for b, raw in zip(table.column("block").to_pylist(), table.column("prints"), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            times = total[np.searchsorted(known, own)]
            more = times > 1
            out.append((b, own[more].tobytes(), np.where(times[more] > hot, 2, 1).astype(np.uint8).tobytes()))
        return _rows(out, (("block", pa.int32()), ("prints", pa.binary()), ("kind", pa.binary())))

    def known_prints(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        known, status = joined(answers.column("prints"), np.uint64), joined(answers.column("kind"), np.uint8)
        by = np.argsort(known)
        return known[by], status[by]

    unit_fields = (("part", pa.int32()), ("block", pa.int32()), ("content", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("many", pa.binary()), ("twice", pa.binary()), ("words", pa.binary()))

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known, status = known_prints(answers)
        held = [[] for _ in range(7)]
        for s in _slices(docs):
            get = s.schema.get_field_index
            words = Words(s.column(get("text")), BLANKS)
            units = Units(words, params)
            start, many, key, content = units.chosen(_status(units.print, known, status))
            doc = s.column(get("doc")).to_numpy()[words.row[start]] if len(start) else np.zeros(0, np.int64)
            place = start - words.first[words.row[start]] if len(start) else start
            by = np.lexsort((place, doc, content))
            first = _firsts(content[by])
            times = np.diff(np.append(first, len(by)))
            pick = by[first]
            wide = many[pick] + window - 1
            text = units.hash[_spread(start[pick], wide)] if len(pick) else np.zeros(0, np.uint64)
            for h, x in zip(held, (key[pick], content[pick], doc[pick], place[pick], many[pick], times > 1, text.astype(np.uint32)), strict=True):
                h.append(x)
        if not held[0]:
            return _rows([], unit_fields)
        key, content, doc, place, many, twice, text = (np.concatenate(h) for h in held)
        begin = np.cumsum(many + window - 1) - (many + window - 1)
        by = np.lexsort((place, doc, content))
        first = _firsts(content[by])
        more = np.logical_or.reduceat(twice[by], first) | (np.diff(np.append(first, len(by))) > 1) if len(first) else np.zeros(0, bool)
        pick = by[first]
        deal = np.argsort(range_part(key[pick], parts), kind="stable")
        pick, more = pick[deal], more[deal]
        part = range_part(key[pick], parts)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        block, rows = answers_block(docs), []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own, m = pick[cuts[p] : cuts[p + 1]], more[cuts[p] : cuts[p + 1]]
            rows.append((p, block, content[own].tobytes(), doc[own].astype(np.int64).tobytes(), place[own].astype(np.int32).tobytes(), many[own].astype(np.uint8).tobytes(), m.astype(np.uint8).tobytes(), text[_spread(begin[own], many[own] + window - 1)].tobytes()))
        return _rows(rows, unit_fields)

    def answers_block(docs: pa.Table) -> int:
        return docs.column("block")[0].as_py()

    def find(table: pa.Table) -> pa.Table:
        content, doc, start = (joined(table.column(c), k) for c, k in (("content", np.uint64), ("doc", np.int64), ("start", np.int32)))
        many, twice, text = joined(table.column("many"), np.uint8).astype(np.int64), joined(table.column("twice"), np.uint8), joined(table.column("words"), np.uint32)
        start = start.astype(np.int64)
        begin = np.cumsum(many + window - 1) - (many + window - 1)
        by = np.lexsort((start, doc, content))
        first = _firsts(content[by])
        pick = by[first]  # of equal units, the one that starts first
        again = (np.diff(np.append(first, len(by))) > 1) | np.logical_or.reduceat(twice[by] > 0, first)
        wide = many[pick] + window - 1
        symbols, coded = np.unique(text[_spread(begin[pick], wide)], return_inverse=True)
        line = np.zeros(int(wide.sum()) + len(pick), np.int64)  # each unit, then a separator
        at = np.cumsum(wide + 1) - (wide + 1)
        line[_spread(at, wide)] = coded + 1
        index = FmIndex(line, len(symbols) + 1, window)
        # where each position of the line stands in its document
        unit = np.repeat(np.arange(len(pick)), many[pick])
        windows = _spread(at, many[pick])
        own_doc, own_place = doc[pick][unit], start[pick][unit] + windows - at[unit]
        low, high = index.stream(line, at, many[pick])
        rank = np.full(len(line), len(windows), np.int64)
        sorted_windows = np.lexsort((own_place, own_doc))
        rank[windows[sorted_windows]] = np.arange(len(windows))
        shared = high - low > 1
        if shared.any():
            spans, where = np.unique(np.stack([low[shared], high[shared]], 1), axis=0, return_inverse=True)
            earliest = np.minimum.reduceat(np.append(rank[index.suffixes], len(windows)), spans.ravel())[::2][where.ravel()]
            source = np.arange(len(windows))
            source[shared] = sorted_windows[earliest]
            first_doc, first_place = own_doc[source], own_place[source]
        else:
            first_doc, first_place = own_doc, own_place
        useful = again | (np.bincount(unit, shared, len(pick)) > 0)
        # back to every block that sent one of these units
        span_at = np.cumsum(many[pick]) - many[pick]
        group = np.empty(len(by), np.int64)
        group[by] = np.repeat(np.arange(len(pick)), np.diff(np.append(first, len(by))))
        sizes = [len(x.as_buffer()) // 8 for x in table.column("content")]
        out, at_row = [], 0
        for b, n in zip(table.column("block").to_pylist(), sizes, strict=True):
            own = group[at_row : at_row + n]
            own = own[useful[own]]
            at_row += n
            if len(own):
                at_w = _spread(span_at[own], many[pick][own])
                along = at_w - np.repeat(span_at[own], many[pick][own])
                out.append((b, content[pick][own].tobytes(), many[pick][own].astype(np.uint8).tobytes(), first_doc[at_w].tobytes(), (first_place[at_w] - along).astype(np.int32).tobytes()))
        return _rows(out, _FOUND)

    names = [id_col, "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]

    def removed(docs: pa.Table, answers: pa.Table, found: pa.Table) -> pa.Table:
        known, status = known_prints(answers)
        content, many = joined(found.column("content"), np.uint64), joined(found.column("many"), np.uint8).astype(np.int64)
        doc, place = joined(found.column("doc"), np.int64), joined(found.column("place"), np.int32).astype(np.int64)
        begin = np.cumsum(many) - many
        by = np.argsort(content)
        content, many, begin = content[by], many[by], begin[by]
        out = []
        for s in _slices(docs):
            get = s.schema.get_field_index
            words = Words(s.column(get("text")), BLANKS)
            gone = np.zeros(len(words) + 1, np.int64)
            units = Units(words, params)
            start, count_, _, own = units.chosen(_status(units.print, known, status))
            if len(start) and len(content):
                at = np.minimum(np.searchsorted(content, own), len(content) - 1)
                hit = content[at] == own
                start, count_, at = start[hit], count_[hit], at[hit]
                row = words.row[start]
                w = _spread(start, count_)
                along = w - np.repeat(start, count_)
                f = _spread(begin[at], count_)
                own_doc = np.repeat(s.column(get("doc")).to_numpy()[row], count_)
                own_place = w - np.repeat(words.first[row], count_)
                earlier = (doc[f] < own_doc) | ((doc[f] == own_doc) & (place[f] + along < own_place))
                w = w[earlier]
                gone += np.bincount(w, minlength=len(gone))
                gone -= np.bincount(w + window, minlength=len(gone))[: len(gone)]
            stay = np.cumsum(gone[:-1]) == 0
            out.append(_digests(s.column(get("id")), words, stay, names, keep_text))
        return pa.concat_tables(out)

    prints = all_docs.mapInArrow(count, "part int, block int, prints binary, n binary")
    answers = prints.groupBy("part").applyInArrow(again, "block int, prints binary, kind binary")
    units = all_docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, "part int, block int, content binary, doc binary, start binary, many binary, twice binary, words binary")
    found = units.groupBy("part").applyInArrow(find, "block int, content binary, many binary, doc binary, place binary")
    # a block's answers of both kinds come as one side of a cogroup
    null = F.lit(None).cast("binary")
    both = answers.select("block", "prints", "kind", null.alias("content"), null.alias("many"), null.alias("doc"), null.alias("place")).unionAll(found.select("block", null.alias("prints"), null.alias("kind"), "content", "many", "doc", "place"))

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        first = told.column("prints").is_valid()
        if not docs.num_rows:
            return _digests(docs.column("id"), None, None, names, keep_text)
        return removed(docs, told.filter(first), told.filter(told.column("content").is_valid()))

    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return all_docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)


def _digests(ids, words: Words | None, stay: np.ndarray | None, names: list[str], keep_text: bool) -> pa.Table:
    """Per row, counts and the digest of the words that stay, joined by one space."""
    columns = [[], [], [], []]
    if words is not None:
        n = np.diff(words.first)
        rows = len(n)
        kept = np.flatnonzero(stay)
        size = words.ends[kept] - words.starts[kept] + 1
        line = np.full(int(size.sum()), 32, np.uint8)
        at = np.cumsum(size) - size
        line[_spread(at, size - 1)] = words.raw[_spread(words.starts[kept], size - 1)]
        per = np.bincount(words.row[kept], size, rows).astype(np.int64)
        low = np.cumsum(per) - per
        data = line.tobytes()
        texts = [data[a : a + m - 1] if m else b"" for a, m in zip(low.tolist(), per.tolist(), strict=True)]
        columns = [n, n - np.bincount(words.row[kept], minlength=rows), [hashlib.sha256(t).hexdigest() for t in texts], texts]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    arrays = [pa.array(c, k) if k != pa.string() or c is not columns[3] else pa.array(c, pa.binary()).cast(pa.string()) for c, k in zip(columns[: 3 + keep_text], kinds, strict=False)]
    return pa.table([ids, *arrays], names=names)


SUBSTRING_ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, list_slice(w, i, i + 19) AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20),
again AS (SELECT r, i, doc_id, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY s) AS f FROM win),
gone AS (SELECT r, list_distinct(flatten(list(range(i, i + 20)))) AS p FROM again WHERE f < struct_pack(d := doc_id, i := i) GROUP BY r),
kept AS (SELECT r, doc_id, w, CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(p, j)), lambda j: w[j]) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
