"""Exact top-k by inner product with bounds from segment statistics, coarse to fine.

Vectors are turned by an orthogonal rotation that is computed from all of them: the eigenvectors of their second moments, largest
first, so that the leading coordinates hold most of what tells vectors apart. Turning changes no inner product. At a resolution of
s segments the s - 1 leading coordinates are segments of their own and the rest is one; the product of two segments is at most the
product of their means plus that of their deviations (a lower bound of the distance, turned round), so a bound on a score is
one inner product of statistics.

* Order: rows lie in blocks by cells of their leading coordinates, and a block is known by its box: the least and greatest of each of
  these, and the longest rest. Cells come from a sample of about CELL_SAMPLE rows; they decide which block holds a row, nothing else.
* Thresholds: a block of queries meets the few data blocks first whose middles are nearest to most of them; a query's k-th best score in
  one of these is a bound from below for any result.
* Each query's bound for each box, a row's work for some thousand rows, leaves the pairs of blocks that can reach a threshold: only
  those are sent. A task has one data block, with its statistics, past which a slice of its query blocks is streamed: the pairs that
  the coarsest bound leaves go to the next resolution, the survivors get exact scores. Rows at the threshold stay, so ties
  are right. Blocks are in the smallest integer type that holds the components; a window keeps the best k of what the tasks find.
* If a resolution drops little, the rest of the block is scored at once, which costs less than picking out rows. Vectors without
  structure (such as independent normal ones) have overlapping boxes, and then what is sent grows as rows times queries over BLOCK.

A heavily repeated vector costs as much as any other. Scores are exact integers; those beyond 64 bits are set to the nearest 64-bit
number, by which they are then ranked. Components of 2^63 / 64 and more are cut likewise.

Null vectors, and those with a null or non-finite component, take no part; nor do rows with a null id. Vectors of another
length than the query's take no part in its search. Rows that share an id are candidates each, but never for their own id; repeated
query ids are merged into one ranking of their candidates. Vectors of no component score 0. Empty tables give no rows. Long vectors
are taken whole; beyond ROTATED components they aren't turned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, salted_join, small_batches, tidy, weigh
from tessera.plans.lineage import discard, written

K, EVERY, SCALE = 20, 20, 64
#: Rows of a block of data and of queries; query blocks of a slice; segments of each resolution; components that are turned at most.
BLOCK, QUERY_BLOCK, SLICE, LEVELS, ROTATED = 4096, 512, 16, (8, 16, 32), 1024
#: Share of pairs up to which survivors are picked out one by one; leading coordinates of a box; rows that cells come from, about; boxes in a row;
#: data blocks that thresholds come from; slices of a task on large tables.
FEW, LEAD, CELL_SAMPLE, BOXES, NEAREST, GROUPS = 0.05, 31, 20_000, 256, 4, 64
LOWEST = -(2**63)


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, q array<bigint>): floor(64 x) of the vectors that take part."""
    x = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("q"))


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """The leading coordinates, then mean and deviation of the rest, scaled by the root of its length."""
    lead = min(segments - 1, m.shape[1] - 1)
    rest = m[:, lead:]
    mean = rest.mean(axis=1)
    deviation = np.sqrt(np.maximum((rest * rest).sum(axis=1) - rest.shape[1] * mean * mean, 0))
    return np.column_stack([m[:, :lead], mean * np.sqrt(rest.shape[1]), deviation])


_BLOCK = ["dim", "kind", "ids", "data"]


def _most(x: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _packed(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    kind = next(k for k, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 64)) if _most(data) < 1 << bits)
    return pa.RecordBatch.from_arrays([pa.array([data.shape[1]], pa.int32()), pa.array([kind]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([data.astype(kind).tobytes()], pa.binary())], _BLOCK)


def _unpacked(dim: int, kind: str, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, kind).reshape(len(ids), dim).astype(np.int64)


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, kind, ids, data): vectors of one length packed as little-endian integers where they lie, ``rows`` to a block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, list[int]]]] = {}
        pack = lambda some: _packed(np.array([i for i, _ in some], dtype=np.int64), np.array([q for _, q in some], dtype=np.int64).reshape(len(some), -1))
        for b in batches:
            for i, q in zip(b.column("vec_id").to_pylist(), b.column("q").to_pylist(), strict=True):
                some = waiting.setdefault(len(q), [])
                some.append((i, q))
                if len(some) == rows:
                    yield pack(waiting.pop(len(q)))
        for some in waiting.values():
            yield pack(some)

    return vectors.mapInArrow(tidy(run), "dim int, kind string, ids binary, data binary")


def rotations(data: DataFrame) -> dict[int, np.ndarray]:
    """For the commonest lengths of vectors an orthogonal matrix, ROTATED^2 numbers in all; the driver sees sums of that size alone."""
    lengths, room = [], ROTATED**2
    for dim, _ in data.where(F.col("dim") > 0).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(ROTATED).collect():
        if dim * dim <= room:
            lengths.append(dim)
            room -= dim * dim

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _BLOCK), strict=True):
                x = _unpacked(*row)[1].astype(float)
                total[row[0]] = total.get(row[0], 0) + x.T @ x
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], ["dim", "at", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, at, row in zip(*(b.column(c).to_pylist() for c in ("dim", "at", "row")), strict=True):
                total[dim, at] = total.get((dim, at), 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array([r.tobytes() for r in total.values()], pa.binary())], ["dim", "at", "row"])

    sums = data.where(F.col("dim").isin(lengths) if lengths else F.lit(False)).mapInArrow(tidy(moments), "dim int, at int, row binary").repartition("dim", "at").mapInArrow(tidy(add), "dim int, at int, row binary").collect()
    found: dict[int, np.ndarray] = {}
    for r in sums:
        found.setdefault(r["dim"], np.empty((r["dim"], r["dim"])))[r["at"]] = np.frombuffer(r["row"])
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in found.items() if np.isfinite(m).all()}


def turned(x: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    return x.astype(float) if turn is None else x.astype(float) @ turn


def leading(dim: int) -> int:
    """How many leading coordinates a cell and a box look at."""
    return max(0, min(LEAD, dim - 1))


class Cells:
    """Cells of one length of vectors: cuts at medians of a sample, each across its widest leading coordinate, so that near cells have near numbers."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.inner: tuple[int, float, Cells, Cells] | None = None
        self.count = 1
        if depth == 0 or len(sample) < 2 or not sample.shape[1]:
            return
        axis = int(np.argmax(sample.var(axis=0)))
        cut = float(np.median(sample[:, axis]))
        low = sample[:, axis] <= cut
        if low.all():
            return
        self.inner = axis, cut, Cells(sample[low], depth - 1), Cells(sample[~low], depth - 1)
        self.count = self.inner[2].count + self.inner[3].count

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of leading coordinates."""
        out = np.zeros(len(x), dtype=np.int32)
        if self.inner and len(x):
            axis, cut, below, above = self.inner
            low = x[:, axis] <= cut
            out[low] = below.numbers(x[low])
            out[~low] = below.count + above.numbers(x[~low])
        return out


def cells(plain: DataFrame, turns: dict[int, np.ndarray], rows: int) -> dict[int, Cells]:
    """Cells of about half a block for each length that is turned, from about CELL_SAMPLE rows by a hash of their ids; they decide the order of rows alone."""
    total = (plain.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8
    one_in = np.uint64(max(1, total // CELL_SAMPLE))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _BLOCK), strict=True):
                ids, x = _unpacked(*row)
                place = np.arange(len(ids), dtype=np.uint64)
                mixed = (ids.astype(np.uint64) ^ (place << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
                kept = turned(x[(mixed >> np.uint64(20)) % one_in == 0], turns.get(row[0]))[:, : leading(row[0])]
                if kept.size:
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([kept.tobytes()], pa.binary())], ["dim", "x"])

    found: dict[int, list[np.ndarray]] = {}
    wanted = plain.where(F.col("dim").isin([*turns]) if turns else F.lit(False))
    for r in wanted.mapInArrow(tidy(some), "dim int, x binary").limit(2 * CELL_SAMPLE).collect():
        found.setdefault(r["dim"], []).append(np.frombuffer(r["x"]).reshape(-1, leading(r["dim"])))
    depth = max(0, int(np.ceil(np.log2(max(1, 2 * total / rows)))))
    return {dim: Cells(np.concatenate(x), depth) for dim, x in found.items()}


def _box(x: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    """What a block is known by: rows, largest component, longest rest; then least, greatest and mean of each leading coordinate."""
    t = turned(x, turn)
    lead = t[:, : (n := leading(x.shape[1]))]
    rest = np.sqrt((t[:, n:] ** 2).sum(axis=1)).max(initial=0)
    return np.concatenate([[len(x), _most(x), rest], lead.min(axis=0), lead.max(axis=0), lead.mean(axis=0)])


def in_cells(plain: DataFrame, turns: dict[int, np.ndarray], found: dict[int, Cells], rows: int) -> DataFrame:
    """(block, dim, kind, ids, data, box): the rows in order of their cells, ``rows`` to a block at most.

    A cell of very many rows, equal ones too, is cut by a hash of id and place, so it is several tasks' work.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, kind, ids, data in zip(*(b.column(c).to_pylist() for c in _BLOCK), strict=True):
                i, x = _unpacked(dim, kind, ids, data)
                cell = found[dim].numbers(turned(x, turns.get(dim))[:, : leading(dim)]) if dim in found else np.zeros(len(i), np.int32)
                wide = len(data) // len(i)
                cols = [pa.array([dim] * len(i), pa.int32()), pa.array(cell), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(i), pa.array([kind] * len(i)), pa.array([data[a * wide : (a + 1) * wide] for a in range(len(i))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "cell", "place", "vec_id", "kind", "row"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            x = np.array([np.frombuffer(row, kind) for _, kind, row in held], dtype=np.int64).reshape(len(held), now)
            b = _packed(np.array([i for i, _, _ in held], dtype=np.int64), x)
            return b.append_column("box", pa.array([_box(x, turns.get(now)).tobytes()], pa.binary()))

        for b in batches:
            for dim, *one in zip(*(b.column(c).to_pylist() for c in ("dim", "vec_id", "kind", "row")), strict=True):
                if held and (dim != now or len(held) == rows):
                    yield out()
                    held = []
                now = dim
                held.append(one)
        if held:
            yield out()

    total = (plain.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8
    single = plain.mapInArrow(tidy(deal), "dim int, cell int, place int, vec_id bigint, kind string, row binary").withColumn("deal", F.xxhash64("vec_id", "place"))
    dealt = single.repartitionByRange(max(1, -(-total // rows)), "dim", "cell", "deal").sortWithinPartitions("dim", "cell").drop("cell", "place", "deal")
    packed = dealt.mapInArrow(tidy(pack), "dim int, kind string, ids binary, data binary, box binary")
    return packed.select(F.monotonically_increasing_id().alias("block"), *_BLOCK, "box")


def box_bounds(q: np.ndarray, turn: np.ndarray | None, boxes: np.ndarray) -> np.ndarray:
    """For each query and each box what no score of the box's rows exceeds."""
    t, n = turned(q, turn), leading(q.shape[1])
    lead, rest = t[:, :n], np.sqrt((t[:, n:] ** 2).sum(axis=1))
    least, greatest = boxes[:, 3 : 3 + n], boxes[:, 3 + n : 3 + 2 * n]
    slack = 1e-9 * q.shape[1] * _most(q) * boxes[:, 1] + 1e-6
    return np.maximum(lead, 0) @ greatest.T + np.minimum(lead, 0) @ least.T + np.outer(rest, boxes[:, 2]) + slack


def block_pairs(asked: DataFrame, data: DataFrame, turns: dict[int, np.ndarray], k: int, nearest: bool) -> DataFrame:
    """(block, to): query blocks and the data blocks they have to meet, from boxes alone, before any data block is sent.

    With ``nearest`` the NEAREST data blocks of more than ``k`` rows whose middles most of the queries score best with; else each
    in which a query's bound reaches its threshold (column least).
    """
    n = max(1, -(-data.count() // BOXES))
    boxes = data.groupBy("dim", F.pmod(F.xxhash64("block"), F.lit(n)).alias("pack")).agg(F.collect_list(F.struct("block", "box")).alias("of"))
    boxes = written(boxes.select("dim", F.col("of.block").alias("to"), F.col("of.box").alias("to_box")), "boxes")
    both = salted_join(asked.select("block", *_BLOCK, *([] if nearest else ["least"])), boxes, ["dim"], salts=64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, to, to_box, least, *row in zip(*(b.column(c).to_pylist() for c in ("block", "to", "to_box", "block" if nearest else "least", *_BLOCK)), strict=True):
                q, x, turn = _unpacked(*row)[1], np.stack([np.frombuffer(y) for y in to_box]), turns.get(row[0])
                if nearest:
                    n = leading(row[0])
                    worth = np.where(x[:, 0] > k, turned(q, turn)[:, :n] @ x[:, 3 + 2 * n :].T, -np.finfo(float).max)
                    best = worth.argmax(axis=1)
                    j, votes = np.unique(best, return_counts=True)
                    values = np.array([worth[best == c, c].max() for c in j])
                else:
                    j = np.flatnonzero((box_bounds(q, turn, x) >= floor_of(np.frombuffer(least, "<i8"))[:, None]).any(axis=0))
                    votes, values = np.zeros(len(j), np.int64), np.zeros(len(j))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(j), pa.int64()), pa.array(np.array(to)[j]), pa.array(votes), pa.array(values)], ["block", "to", "votes", "worth"])

    found = both.mapInArrow(tidy(run), "block bigint, to bigint, votes bigint, worth double")
    if not nearest:
        return found.select("block", "to")
    order = Window.partitionBy("block").orderBy(F.desc("votes"), F.desc("worth"), "to")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= NEAREST).select("block", "to")


def floor_of(least: np.ndarray) -> np.ndarray:
    """Thresholds as floats; the lowest number is no threshold, for scores below it are set to it."""
    return np.where(least == LOWEST, -np.inf, least.astype(float))


class DataBlock:
    """Rows in order of their ids, turned, with the statistics of each resolution; ``bounded`` and ``exact`` count pairs."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.turn = ids[order], x[order], turn
        self.levels = [s for s in LEVELS if s < x.shape[1]]
        t = turned(self.x, turn)
        self.statistics = [statistics(t, s) for s in self.levels]
        self.plain, self.most = self.x.astype(float), _most(self.x)
        self.bounded = self.exact = 0

    def scores(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, fits: bool) -> np.ndarray:
        """Exact scores of pairs of rows, cut to 64 bits."""
        self.exact += len(i)
        if fits:
            return np.concatenate([np.rint(np.einsum("ij,ij->i", q[i[a : a + 65_536]].astype(float), self.plain[j[a : a + 65_536]])).astype(np.int64) for a in range(0, len(i), 65_536)] or [np.empty(0, np.int64)])
        low, high = -(2**63), 2**63 - 1
        return np.array([min(max(sum(a * b for a, b in zip(q[m].tolist(), self.x[n].tolist(), strict=True)), low), high) for m, n in zip(i, j, strict=True)], dtype=np.int64)

    def search(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec, score) of the best k rows of this block for each query, those below ``least`` left out."""
        scale = float(_most(q)) * float(self.most) * max(q.shape[1], 1)
        fits = scale < 2**53
        slack = 1e-9 * scale + 1e-6
        may = q_ids[:, None] != self.ids[None, :]
        self.bounded += may.size
        i = j = None
        t = turned(q, self.turn)
        reach = floor_of(least)
        for s, of_x in zip(self.levels, self.statistics, strict=True):
            of_q = statistics(t, s)
            if i is None:
                may &= of_q @ of_x.T + slack >= reach[:, None]
                if may.mean() <= FEW:
                    i, j = np.nonzero(may)
            else:
                ok = np.einsum("ij,ij->i", of_q[i], of_x[j]) + slack >= reach[i]
                i, j = i[ok], j[ok]
        if i is None and fits:
            whole = np.rint(q.astype(float) @ self.plain.T).astype(np.int64)
            self.exact += int(may.sum())
            i, j = np.nonzero(may & (whole >= least[:, None]))
            score = whole[i, j]
        else:
            i, j = np.nonzero(may) if i is None else (i, j)
            score = self.scores(q, i, j, fits)
            ok = score >= least[i]
            i, j, score = i[ok], j[ok], score[ok]
        order = np.lexsort((j, ~score, i))  # ~score turns the order round without overflow
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        return q_ids[i[best]], self.ids[j[best]], score[best]


def meetings(data: DataFrame, asked: DataFrame, pairs: DataFrame, turns: dict[int, np.ndarray], answer: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``answer`` of each of ``pairs``: a task has one data block, with its statistics, past which up to SLICE query blocks at a time are streamed."""
    number = F.row_number().over(Window.partitionBy("to").orderBy("block")) - 1
    dealt = written(pairs.select("block", "to", F.floor(number / SLICE).cast("int").alias("slice")), "block-pairs")
    size = weigh(dealt)
    copies = dealt.select(F.col("to").alias("block"), "slice").distinct()
    rows = data.join(broadcast_if_small(copies, size), "block").select("block", "slice", F.lit(None).cast("bigint").alias("asked"), *_BLOCK, F.lit(None).cast("binary").alias("least"))
    sent = asked.join(broadcast_if_small(dealt, size), "block").select(F.col("to").alias("block"), "slice", F.col("block").alias("asked"), *_BLOCK, "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: DataBlock | None = None
        for b in batches:
            for block, *row in zip(*(b.column(c).to_pylist() for c in ("asked", *_BLOCK, "least")), strict=True):
                if block is None:
                    now = DataBlock(*_unpacked(*row[:4]), turns.get(row[0]))
                else:
                    yield answer(now, block, *row)

    groups, cores = copies.count(), data.sparkSession.sparkContext.defaultParallelism
    spread = max(1, min(groups, max(4 * cores, groups // GROUPS)))  # work follows pairs, not the bytes that AQE would coalesce by
    tasks = rows.unionByName(sent).repartition(spread, "block", "slice").sortWithinPartitions("block", "slice", F.col("asked").asc_nulls_first())
    return tasks.mapInArrow(tidy(run), schema)


def thresholds(data: DataFrame, asked: DataFrame, turns: dict[int, np.ndarray], k: int) -> DataFrame:
    """The query blocks with, for each query, the best of its k-th scores within the nearest data blocks (LOWEST if all have fewer)."""

    def answer(now: DataBlock, block: int, dim: int, kind: str, ids: bytes, data: bytes, _: None) -> pa.RecordBatch:
        q_ids, q = _unpacked(dim, kind, ids, data)
        who, _, score = now.search(q_ids, q, np.full(len(q_ids), LOWEST), k)
        order = np.argsort(who, kind="stable")
        who, score = who[order], score[order]
        names, at, n = np.unique(who, return_index=True, return_counts=True)
        lowest = {w: score[a : a + c].min() for w, a, c in zip(names.tolist(), at, n, strict=True) if c == k}
        least = np.array([lowest.get(w, LOWEST) for w in q_ids.tolist()], dtype="<i8")
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([least.tobytes()], pa.binary())], ["block", "least"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [np.max([np.frombuffer(x, "<i8") for x in some], axis=0).tobytes() for some in b.column("of").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(most, pa.binary())], ["block", "least"])

    plain = asked.withColumn("least", F.lit(None).cast("binary"))
    found = meetings(data, plain, block_pairs(asked, data, turns, k, True), turns, answer, "block bigint, least binary")
    found = found.groupBy("block").agg(F.collect_list("least").alias("of")).mapInArrow(tidy(merge), "block bigint, least binary")  # NEAREST of a block at most
    return asked.join(found, "block").select("block", *_BLOCK, "least")


def arranged(vectors: DataFrame, queries: DataFrame, k: int, block: int, query_block: int) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """Data blocks, query blocks with thresholds, and the rotations."""
    small_batches(vectors.sparkSession)
    plain = written(blocks(vectors, block), "plain-vectors")
    turns = rotations(plain)
    found = cells(plain, turns, block)
    data = written(in_cells(plain, turns, found, block), "vector-blocks")
    plain_queries = written(blocks(queries, query_block), "plain-queries")
    asked = written(in_cells(plain_queries, turns, found, query_block), "query-blocks")
    discard(plain, plain_queries)
    return data, written(thresholds(data, asked, turns, k), "asked"), turns


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k other rows for each query; both sides have vec_id and q."""
    data, asked, turns = arranged(vectors, queries, k, block, query_block)

    def answer(now: DataBlock, block: int, dim: int, kind: str, ids: bytes, data: bytes, least: bytes) -> pa.RecordBatch:
        found = now.search(*_unpacked(dim, kind, ids, data), np.frombuffer(least, "<i8"), k)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in found], ["query_id", "vec_id", "score"])

    best = meetings(data, asked, block_pairs(asked, data, turns, k, False), turns, answer, "query_id bigint, vec_id bigint, score bigint")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
