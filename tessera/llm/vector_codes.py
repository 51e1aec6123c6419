"""Vector code compression: vectors as short codes, one entry of an integer codebook for each of PARTS consecutive parts.

Components become whole numbers, floor(SCALE x). The codebook of a part starts as that part of the smallest ids; a round assigns each
part to its nearest entry and replaces every entry that has parts by the floor of their mean. All codebooks together have ENTRIES
numbers for each component of a vector, so they are broadcast with the task, whatever the number of rows. A task finds the
distances of a whole Arrow batch by expanding the norm, |x|^2 - 2 x c + |c|^2, with exact products of 64-bit matrices; the first of
equal distances wins. It adds up the parts of each entry itself, and a grouped shuffle merges these sums, so a round moves
a few numbers for each task and no vector. The next codebooks are these sums divided on the driver.

Integers are exact throughout: batches whose distances or sums could pass 64 bits are worked in Python's integers, which are slower.
Components beyond 64 bits are set to the nearest 64-bit number, and errors beyond 64 bits to the largest.

Null vectors and those with a null or non-finite component are left out. Of ids that repeat each row is a vector of its own, the smaller
vector first where the smallest ids are taken; null ids come after all others. With fewer vectors than entries there are as many
entries as vectors. Vectors of another length have codebooks of their own, and the digest of these. Where a length isn't a multiple
of PARTS, part i of d components begins at floor(i d / PARTS); empty parts are all equal, their entry is 0. Further columns do no
harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, small_batches, tidy
from tessera.plans.lineage import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Numbers of all codebooks that are worked at once; more lengths of vectors than fit are worked one lot after the other.
NUMBERS = 1 << 22
_LARGEST = (1 << 63) - 1

#: For each length of vectors, for each part, its entries in rows.
Codebooks = dict[int, list[np.ndarray]]


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, q array<bigint>) of the vectors that take part."""
    x = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["label"].alias("label"), embeddings["embedding"].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.where(F.col("x").isNotNull() & fine).select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("q"))


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in 64 bits if no distance of their rows can pass them, else in Python's integers."""
    most = max((max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in matrices), default=0)
    dim = matrices[0].shape[1]
    fits = 4 * most * most * max(dim, 1) <= _LARGEST
    return [m if fits else m.astype(object) for m in matrices]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest row of ``entries``, the first of equals, and the squared distance."""
    x, c = _exact(x, entries)
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    far = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    first = far.argmin(axis=1)
    return first, (x * x).sum(axis=1) + far[np.arange(len(x)), first]


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of vectors in the batch."""
    dims = b.column("dim").to_numpy()
    lists = b.column("q")
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, lists.take(pa.array(rows)).flatten().to_numpy().astype(np.int64).reshape(len(rows), dim)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the smallest ids: ``entries`` vectors of each length, no more reach the driver."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "q")
    some = vectors.select("dim", "vec_id", "q", F.row_number().over(order).alias("at")).where(F.col("at") <= entries)
    rows = sorted(some.select("dim", "at", "q").collect(), key=lambda r: r[:2])
    held = {dim: [r["q"] for r in own] for dim, own in groupby(rows, key=lambda r: r["dim"])}
    whole = {dim: np.array(own, dtype=np.int64).reshape(len(own), dim) for dim, own in held.items()}
    return {dim: [m[:, a:b] for a, b in cuts(dim, parts)] for dim, m in whole.items()}


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        for b in batches:
            for dim, _, x in _matrices(b):
                for part, (entries, (i, j)) in enumerate(zip(sent.value[dim], cuts(dim, len(sent.value[dim])), strict=True)):
                    own = x[:, i:j]
                    at, _ = nearest(own, entries)
                    if len(own) and max(-int(own.min(initial=0)), int(own.max(initial=0))) * len(own) > _LARGEST:
                        own = own.astype(object)
                    for entry in np.unique(at).tolist():
                        mine = own[at == entry]
                        held = sums.setdefault((dim, part, entry), [0, [0] * (j - i)])
                        held[0] += len(mine)
                        held[1] = [s + int(t) for s, t in zip(held[1], mine.sum(axis=0).tolist(), strict=True)]
        rows = [(*key, at, s, n) for key, (n, of) in sums.items() for at, s in enumerate(of)]
        columns = [pa.array([r[k] for r in rows], pa.int32()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([str(r[4]) for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.int64())], ["dim", "part", "entry", "at", "total", "n"])

    partial = vectors.select("dim", "q").mapInArrow(tidy(run), "dim int, part int, entry int, at int, total string, n bigint")
    merged = partial.groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = {dim: [entries.copy() for entries in of] for dim, of in books.items()}
    for r in merged:
        out[r["dim"]][r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    sent.unpersist()
    return out


def codebooks_sha256(of_dim: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for entries in of_dim for v in entries.ravel().tolist()).encode()).hexdigest()


def assigned(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): the codes by these codebooks."""
    sent = vectors.sparkSession.sparkContext.broadcast((books, {dim: codebooks_sha256(of) for dim, of in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_dims, digests = sent.value
        for b in batches:
            code, error, digest = np.full(b.num_rows, "", object), np.zeros(b.num_rows, object), np.full(b.num_rows, "", object)
            for dim, rows, x in _matrices(b):
                for entries, (i, j) in zip(of_dims[dim], cuts(dim, len(of_dims[dim])), strict=True):
                    at, far = nearest(x[:, i:j], entries)
                    code[rows] += np.array([f"{a:02x}" for a in at.tolist()], object)
                    error[rows] += far.astype(object)
                digest[rows] = digests[dim]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array([min(int(e), _LARGEST) for e in error], pa.int64()), pa.array(digest, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(tidy(run), f"vec_id bigint, label {label}, code string, error bigint, codebooks_sha256 string")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    small_batches(embeddings.sparkSession)
    vectors = written(whole_numbers(embeddings, scale), "vectors")
    lots: list[list[int]] = [[]]
    for (dim,) in vectors.select("dim").distinct().orderBy("dim").collect():
        if lots[-1] and entries * (sum(lots[-1]) + dim) > NUMBERS:
            lots.append([])
        lots[-1].append(dim)
    coded: DataFrame | None = None
    for lot in lots:
        own = vectors if len(lots) == 1 else vectors.where(F.col("dim").isin(lot))
        books = first_codebooks(own, parts, entries)
        for _ in range(rounds):
            books = improved(own, books)
        some = assigned(own, books)
        coded = some if coded is None else coded.unionByName(some)
    coded = written(coded, "codes")
    most = F.lit(_LARGEST).cast("decimal(38,0)")
    by_label = written(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error")), "label-errors")
    named = by_label.select(F.struct("label").alias("key"), "label_error")  # a struct is never null, so nulls meet
    return salted_join(coded.withColumn("key", F.struct("label")), named, ["key"]).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
