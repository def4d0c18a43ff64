"""Best-fit packing of token sequences by linear grouping.

Texts become token ids and one closing id; those longer than a sequence are cut into whole
sequences and a rest. What has to be packed is then a histogram: how many pieces have each
length from 1 to the capacity. The plan is made on that histogram, whose size the capacity
fixes, and never sees a piece:

1. Pieces of full length fill sequences of their own.
2. Large lengths, in descending order, are dealt out to groups of equal cardinality; within
   a group, lengths are rounded up to the group's greatest.
3. The few rounded sizes have few configurations (ways to fill one sequence); column
   generation on the linear program over them finds how many sequences to fill by each.
   Whole numbers of them are kept.
4. The actual pieces of a group take its slots, in descending order of length, which leaves
   each sequence room of a known size.
5. The remaining large pieces and all small ones, in descending order of length, go where
   they fit best, and to new sequences where nothing fits.

The plan says, for each range of ranks among the pieces of a length, to which range of
sequences and at which offset they go. Ranks come from counts per (length, salt), salts by
id hash, and a row number within each, so that a common length is no one task's.

Defined results: a null or empty text is the closing id alone; repeated rows are packed
each; ids may be null. Other columns are not read and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.tokens import encoder
from siltstone.session import ensure_checkpoint_dir

PIECES = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackingParams:
    """capacity: tokens of a sequence; groups: sizes after rounding; large: least share of a sequence that is grouped."""

    capacity: int = 2048
    closing: int = 0
    groups: int = 128
    large: float = 0.4
    salts: int = 20_000


@dataclass
class Plan:
    """Sorted by length, then rank: pieces from `rank` on go to sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a column each) and how often the linear program uses each."""
    k = len(sizes)
    fits = capacity // sizes
    basis, x = np.diag(fits).astype(float), demand / fits
    deepest = int(fits.max())
    for _ in range(rounds):
        value = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full((deepest, capacity + 1), -1)
        for j in range(deepest):  # best fillings of up to j + 1 pieces for each capacity
            options = np.full((k, capacity + 1), -np.inf)
            for g, s in enumerate(sizes.tolist()):
                options[g, s:] = best[: capacity + 1 - s] + value[g]
            pick = options.argmax(0)
            better = options[pick, np.arange(capacity + 1)]
            choice[j] = np.where(better > best + 1e-12, pick, -1)
            best = np.maximum(best, better)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for j in range(deepest - 1, -1, -1):
            g = choice[j][room]
            if g >= 0:
                column[g] += 1
                room -= sizes[g]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-10, x / np.where(change > 1e-10, change, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        x = np.maximum(x - ratio[leaves] * change, 0)
        x[leaves] = ratio[leaves]
        basis[:, leaves] = column
    return basis.astype(np.int64), x


def plan_packing(counts: np.ndarray, params: PackingParams = PackingParams()) -> Plan:
    """counts[n]: pieces of n tokens, n up to the capacity."""
    cap = params.capacity
    records: list[tuple[int, int, int, int]] = []
    given = np.zeros(cap + 1, np.int64)  # ranks given out, by length
    rooms: dict[int, list[list[int]]] = {}  # by room left: ranges of sequences [first, how many]
    made = int(counts[cap])
    if made:
        records.append((cap, 0, 0, 0))
    given[cap] = made

    large = [n for n in range(cap - 1, int(cap * params.large), -1) if counts[n]]
    total = int(sum(counts[n] for n in large))
    if total:
        # groups of equal cardinality: each a size and, in descending order, its runs [length, how many]
        share, groups = -(-total // params.groups), []
        for n in large:
            left = int(counts[n])
            while left:
                if not groups or groups[-1][2] == share:
                    groups.append([n, [], 0])
                take = min(left, share - groups[-1][2])
                groups[-1][1].append([n, take])
                groups[-1][2] += take
                left -= take
        merged: list[list] = []
        for size, runs, n in groups:
            if merged and merged[-1][0] == size:
                merged[-1][1] += runs
                merged[-1][2] += n
            else:
                merged.append([size, runs, n])
        basis, x = configurations(np.array([g[0] for g in merged]), np.array([g[2] for g in merged], float), cap)
        queues = [g[1] for g in merged]
        times = np.floor(x + 1e-6).astype(np.int64)
        for p in np.argsort(-times, kind="stable").tolist():
            slots = [g for g in range(len(merged)) for _ in range(int(basis[g, p]))]
            need = {g: slots.count(g) for g in slots}
            many = min([int(times[p]), *(sum(r[1] for r in queues[g]) // c for g, c in need.items())])
            open_ = [[made, many, 0]] if many else []  # ranges of sequences with what they hold
            made += many
            for g in slots:
                after = []
                for first, n, held in open_:
                    while n:
                        run = queues[g][0]
                        take = min(n, run[1])
                        records.append((run[0], int(given[run[0]]), first, held))
                        given[run[0]] += take
                        after.append([first, take, held + run[0]])
                        first, n = first + take, n - take
                        run[1] -= take
                        if not run[1]:
                            queues[g].pop(0)
                open_ = after
            for first, n, held in open_:
                rooms.setdefault(cap - held, []).append([first, n])

    for n in range(cap - 1, 0, -1):
        left = int(counts[n] - given[n])
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                # nothing has room: new sequences, each with as many of this length as it holds
                per = cap // n
                many, rest = divmod(left, per)
                for held, much in ((per, many), (rest, 1 if rest else 0)):
                    for j in range(held if much else 0):
                        records.append((n, int(given[n]), made, j * n))
                        given[n] += much
                    if much and cap - held * n:
                        rooms.setdefault(cap - held * n, []).append([made, much])
                    made += much
                break
            ranges = rooms[room]
            first, many = ranges[-1]
            take = min(many, left)
            records.append((n, int(given[n]), first, cap - room))
            given[n] += take
            left -= take
            if take == many:
                ranges.pop()
                if not ranges:
                    del rooms[room]
            else:
                ranges[-1] = [first + take, many - take]
            if room - n:
                rooms.setdefault(room - n, []).append([first, take])
    found = np.array(sorted(records), np.int64).reshape(-1, 4)
    return Plan(*found.T, made)


def token_pieces(docs: DataFrame, vocabulary: str, params: PackingParams = PackingParams(), id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, and with keep_ids its ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    cap, closing = params.capacity, np.array([params.closing], np.uint32)

    def pieces(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, closing]).astype("<u4")
                for j, low in enumerate(range(0, len(ids), cap)):
                    part = ids[low : low + cap]
                    at.append(i)
                    piece.append(j)
                    start.append(low)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(pieces, f"`{id_col}` {kind}, {PIECES}" + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, vocabulary: str, params: PackingParams = PackingParams(), id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; they are tokenised once and kept in the checkpoint folder."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    pieces = token_pieces(docs, vocabulary, params, id_col, text_col, keep_ids).checkpoint()
    counts = np.zeros(params.capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row for each length, so the capacity bounds them
        counts[r["length"]] = r["count"]
    plan = plan_packing(counts, params)
    # about `salts` keys beside one for each length, however many pieces there are
    per = max(200, int(counts.sum()) // params.salts)
    salts = spark.sparkContext.broadcast(np.maximum(1, -(-counts // per)))
    split = F.create_map(*[F.lit(x) for n in np.flatnonzero(counts > per).tolist() for x in (n, int(salts.value[n]))]) if (counts > per).any() else None
    many = F.lit(1) if split is None else F.coalesce(split[F.col("length").cast("int")], F.lit(1))
    salted = pieces.withColumn("_s", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), many).cast("int"))
    held = sorted((r["length"], r["_s"], r["count"]) for r in salted.groupBy("length", "_s").count().collect())
    before = np.zeros((len(held), 3), np.int64)
    seen: dict[int, int] = {}
    for i, (n, s, c) in enumerate(held):
        before[i] = n, s, seen.get(n, 0)
        seen[n] = seen.get(n, 0) + c
    shared = spark.sparkContext.broadcast((plan, before))
    rank = F.row_number().over(Window.partitionBy("length", "_s").orderBy(id_col, "piece"))
    ranked = salted.withColumn("_r", rank)
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()

    def placed(batches):
        plan, before = shared.value
        keys = before[:, 0] * (1 << 32) + before[:, 1]
        for batch in batches:
            length, salt, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_s", "_r"))
            sequence, offset = plan.place(length, before[np.searchsorted(keys, length * (1 << 32) + salt), 2] + r - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_s", "_r").mapInArrow(placed, f"`{id_col}` {kind}, {PIECES}" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")
