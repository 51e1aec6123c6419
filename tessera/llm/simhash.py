"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees within shards, grouped by components.

Equal fingerprints are one node from the start (a partial aggregate), so any number of copies costs no more than one text.

Shards hold the fingerprints that can be near each other (``block_shards``, radius 2): a fingerprint is four blocks of 16 bits.
Two changed bits touch two blocks at most, so two fingerprints within the radius share two whole blocks: each goes to the six
shards of its pairs of blocks. A shard of more than SHARD members is dealt out again in the same way by the bytes of its other
two blocks; it then has 65,536 members at most.

Each shard has one BK-tree, children keyed by their integer distance to the parent. Every member searches the tree of those before it,
following only the edges whose distance is within the radius of its own, and joins the groups of all it finds (union-find).
Only links that join two groups leave the task, so a shard of m members gives m - 1 at most, and no link between groups is
lost. The trees are built where their shard's rows meet instead of being broadcast: fingerprints grow with the documents,
so no bound on a broadcast of all trees could be proven, and collecting them is ruled out.

Groups of near texts begin with these: rows whose fingerprints are linked are in one group, as they are for the query. Fingerprints
within the radius miss most texts with a few changed words, so what they leave apart is looked at further: texts of a similarity of 0.8 of
their sets of distinct five-word shingles are joined too, and none of these links is lost:
* A node is a distinct set of shingles. All sets are put in one order of shingles, those of common buckets last. Two sets of the
  wanted similarity share one of their first n - ceil(0.8 n) + 1 shingles, whatever the order: these are the shards of a node.
  At their first common shingle, what follows in either set must still hold the wanted number of common ones; and the parities
  of a set's shingles over some buckets differ in no more bits than there are shingles in one set alone (512 buckets for a
  first look, then as many as there are shingles). Both bounds are exact, so candidates are left out only where the
  similarity can't be reached. Whole sets then decide; a pair is looked at once, and a set is made once.
* The first candidates are the members of a shard with its first member and with the SMALL - 1 members before each; all pairs of a
  shard of SMALL members or fewer are among them. After that, confirmed links make components, and each round looks at all
  pairs of a larger shard that aren't in one component: members outside the largest component of the shard are dealt into blocks
  of BLOCK members, each block with itself, with later ones and with the blocks of that component as its own task. A round
  hands on a limited number of candidates for each member, and rounds with a larger number follow until nothing was held back.
Groups are chains of near pairs; none is lost but by equal 64-bit hashes.

Texts are lower-cased in A-Z; words are runs outside x20 and x09-x0D. A text with fewer words than a shingle is one shingle; one
without words has fingerprint zero and no shingle, and all such are one node. Null texts are empty; null ids never become a
component's id unless the whole component has none. Very long texts are hashed whole. An empty table gives no rows.

Rows are told apart by id and text: of a group the row with the smallest id stays (null ids last, then the smaller hash of the
row), rows that share its id but not its group are judged by themselves, and of equal rows one stays. Texts don't move for that:
the keys of the rows that go are broadcast up to a fixed number, or looked up in sorted files beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents_of, row_key, salted_join, tidy
from tessera.llm.mapped import among
from tessera.operators.graph import components
from tessera.plans.lineage import discard, written

SEED, SHINGLE, RADIUS, SHARD = 42, 3, 2, 2048
#: For near texts: words of a shingle, share of common distinct shingles, members of a shard whose pairs are all first candidates, members
#: of a block, candidates of a member in the first round and their growth, bits of a bucket of shingles whose occurrences are counted, bits of
#: a bucket of parities.
TEXT_SHINGLE, SIMILARITY, SMALL, BLOCK, FIRST, GROWTH, COMMON_BITS, PARITY_BITS = 5, 0.8, 16, 2048, 16, 64, 20, 9
_MASK = (1 << 64) - 1
#: Odd factors that mix hashes anew.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in runs], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(shingle_hashes(text, size, seed))) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    d = documents_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(tidy(run), "doc_id bigint, fp bigint")


def _block(fp: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))


def block_shards(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(k, v, sk, sv, fp): fingerprints under the keys of their shards; shards of one member are left out."""
    pairs = list(combinations(range(4), 2))
    b = [_block(F.col("fp"), i, 16) for i in range(4)]
    keys = F.array(*[F.struct(F.lit(n).alias("k"), F.shiftleft(b[i], 16).bitwiseOR(b[j]).alias("v")) for n, (i, j) in enumerate(pairs)])
    keyed = written(nodes.select("fp", F.inline(keys)), "shards")
    sizes = keyed.groupBy("k", "v").count().where("count > 1")
    keyed = keyed.join(sizes, ["k", "v"])
    cold = keyed.where(F.col("count") <= shard).select("k", "v", F.lit(-1).alias("sk"), F.lit(0).cast("bigint").alias("sv"), "fp")
    rest = F.element_at(F.array(*[F.array(*[x for m in range(4) if m not in p for x in (_block(F.col("fp"), 2 * m, 8), _block(F.col("fp"), 2 * m + 1, 8))]) for p in pairs]), F.col("k") + 1)
    again = F.array(*[F.struct(F.lit(n).alias("sk"), F.shiftleft(rest[i], 8).bitwiseOR(rest[j]).alias("sv")) for n, (i, j) in enumerate(pairs)])
    hot = keyed.where(F.col("count") > shard).select("k", "v", F.inline(again), "fp").select("k", "v", "sk", "sv", "fp")
    return cold.unionByName(hot)


class BKTree:
    """Children keyed by integer Hamming distance to the parent; ``calls`` counts the distances that were taken."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.calls = 0

    def add(self, value: int) -> None:
        at, number = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at < number:
            self.calls += 1
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, number)

    def near(self, value: int, radius: int) -> list[int]:
        """The numbers of all members within the radius, by following edges within the radius of the distance to their parent."""
        found, values, children = [], self.values, self.children
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            self.calls += 1
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [child for e, child in below.items() if -radius <= e - d <= radius]
            else:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found


def shard_links(members: list[int], radius: int, tree: BKTree | None = None) -> list[tuple[int, int]]:
    """Links that join distinct fingerprints into the groups of all links within the radius."""
    tree = BKTree() if tree is None else tree
    up = list(range(len(members)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    links = []
    for i, x in enumerate(members):
        for j in tree.near(x, radius):
            if (a := root(i)) != (b := root(j)):
                up[a] = b
                links.append((x, members[j]))
        tree.add(x)
    return links


def links(shards: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links enough to join all fingerprints of a shard that chains within the radius join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def out() -> pa.RecordBatch:
            found = shard_links(members, radius) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([_signed(p[i]) for p in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

        for b in batches:
            for *k, fp in zip(*(b.column(c).to_pylist() for c in ("k", "v", "sk", "sv", "fp")), strict=True):
                if k != key:
                    if len(members) > 1:
                        yield out()
                    key, members = k, []
                members.append(fp & _MASK)
        if len(members) > 1:
            yield out()

    dealt = shards.repartition("k", "v", "sk", "sv").sortWithinPartitions("k", "v", "sk", "sv", "fp")
    return dealt.mapInArrow(tidy(run), "src bigint, dst bigint")


def distinct_shingles(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def set_id(h: np.ndarray) -> int:
    """64 bits that stand for a whole set of shingles."""
    return _signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))


def parities(h: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """For each of 2^bits buckets of hashes one bit: whether it holds an odd number."""
    at = ((h * ORDERS[0]) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits) & 1).tobytes()


def wide_parities(h: np.ndarray) -> bytes:
    """Parities over about as many buckets as there are hashes."""
    return parities(h, max(PARITY_BITS, int(len(h)).bit_length()))


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ, those of more buckets being added up to the number of the other."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    if len(a) == len(b):
        return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))
    a, b = (np.unpackbits(z) for z in (a, b))
    while len(a) > len(b):
        a = a[::2] ^ a[1::2]
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int((a ^ b).sum(dtype=np.int64))


def least_common(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles two sets of ``n`` in all share at least if they reach the similarity."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-6)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * ORDERS[1]) >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def commonness(docs: DataFrame, size: int) -> np.ndarray:
    """For each bucket of shingles the quarter-octave of its occurrences over all texts: one byte each, whatever the size of the input."""
    chunks = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COMMON_BITS, dtype=np.int64)
        for b in batches:
            h = [distinct_shingles(t, size) for t in b.column("text").to_pylist()]
            n += np.bincount(_bucket(np.concatenate([*h, np.empty(0, np.uint64)])), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in np.split(n, chunks)], pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(n, np.uint32).astype(np.int64)
        levels = [np.rint(4 * np.log2(n + 1)).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(levels, pa.binary())], ["chunk", "n"])

    d = documents_of(docs).select(F.col("text").cast("binary").alias("text"))
    got = d.mapInArrow(tidy(count), "chunk int, n binary").repartition("chunk").mapInArrow(tidy(add), "chunk int, n binary").collect()
    return np.frombuffer(b"".join(bytes(r["n"]) for r in sorted(got, key=lambda r: r["chunk"])), np.uint8)


def text_sets(docs: DataFrame, size: int, similarity: float, marked: bool = False) -> DataFrame:
    """(doc_id, rk, fp, n, bits, wide, first, sim): each row's key, the id of its set of shingles, their number, parities, those that a near text may share first, and the row's fingerprint."""
    common = commonness(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ns, bits, wide, first, sims = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = distinct_shingles(text, size)
                fps.append(set_id(h))
                ns.append(len(h))
                bits.append(parities(h))
                wide.append(wide_parities(h))
                kept = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1 if len(h) else 0
                first.append(h[np.lexsort((h, common[_bucket(h)]))[:kept]].view(np.int64))
                sims.append(_signed(fingerprint(shingle_hashes(text, SHINGLE))) if marked else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(sims, pa.int64())], ["doc_id", "rk", "fp", "n", "bits", "wide", "first", "sim"])

    d = documents_of(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(tidy(run), "doc_id bigint, rk bigint, fp bigint, n int, bits binary, wide binary, first array<bigint>, sim bigint")


def text_shards(nodes: DataFrame, similarity: float) -> DataFrame:
    """(sh, fp, n, pos, head, nth, others): nodes under their first shingles, where two nodes at least have one.

    nth is a node's place in its shard, from 0; head is the first node of the shard, and others are those of the SMALL - 1 nodes before
    it but the head, as far as they may be near.
    """
    names = ["sh", "fp", "n", "pos", "head", "nth", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, nth = None, None, 0  # the last rows of the last shard, its head (fp, n, pos), and the place of the first of them

        def step(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """What is known of ``rows``, of which all held ones but one have gone out before; and what to hold of them."""
            nonlocal held, head, nth
            sh, *of = (rows.column(c).to_numpy() for c in ("sh", "fp", "n", "pos"))
            new = np.concatenate([[True], sh[1:] != sh[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
            place, heads = np.arange(len(sh)) - start, [x[start] for x in of]
            if held is not None:
                place[start == 0] += nth
                for x, known in zip(heads, head, strict=True):
                    x[start == 0] = known
            may = (place > 0) & (np.minimum(of[1] - of[2], heads[1] - heads[2]) >= least_common(of[1] + heads[1], similarity))
            begin = 0 if held is None else held.num_rows - 1
            near = [np.empty((2, 0), np.int64)]
            for d in range(1, SMALL):
                i = begin + np.flatnonzero(np.arange(begin, len(sh)) - d >= start[begin:])
                i = i[place[i] > d]
                j = i - d
                ok = np.minimum(of[1][i] - of[2][i], of[1][j] - of[2][j]) >= least_common(of[1][i] + of[1][j], similarity)
                near.append(np.stack([i[ok], of[0][j[ok]]]))
            i, others = np.concatenate(near, axis=1)
            order = np.argsort(i, kind="stable")
            ends = np.searchsorted(i[order], np.arange(len(sh) + 1))
            out = [*(rows.column(c) for c in names[:4]), pa.array(heads[0], pa.int64(), mask=~may), pa.array(place, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others[order], pa.int64()))]
            keep = (place > 0) | np.concatenate([~new[1:], [False]])
            keep[:begin] = False
            if not last:
                keep[-1] = False
            yield from pa.table(out, names=names).filter(pa.array(keep)).combine_chunks().to_batches()
            first = max(start[-1], len(sh) - SMALL)
            held, head, nth = rows.slice(first).combine_chunks(), [int(x[-1]) for x in heads], int(place[first])

        for b in batches:
            if not b.num_rows:
                continue
            b = pa.Table.from_batches([b])
            rows = (b if held is None else pa.concat_tables([held, b])).combine_chunks()
            sh, fp = (rows.column(c).to_numpy() for c in ("sh", "fp"))
            again = np.concatenate([[False], (sh[1:] == sh[:-1]) & (fp[1:] == fp[:-1])])  # rows that are the same
            yield from step(rows.filter(pa.array(~again)).combine_chunks(), False)
        if held is not None:
            yield from step(held, True)

    keyed = nodes.select("fp", "n", F.posexplode("first").alias("pos", "sh")).select("sh", "fp", "n", "pos")
    return keyed.repartition("sh").sortWithinPartitions("sh", "fp").mapInArrow(tidy(run), "sh bigint, fp bigint, n int, pos int, head bigint, nth int, others array<bigint>")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def block_pairs(group: np.ndarray, side: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of one group, of different sides (or side -1) and components, that the bounds allow to be near; and whether some were held back.

    Groups are runs of rows. All rows are compared with those d further on, d by d. A pair is held back if both have ``limit`` already.
    """
    got, more, found = np.zeros(len(group), dtype=np.int64), False, []
    at, d = np.arange(len(group)), 1
    while len(at := at[at + d < len(group)]) and len(at := at[group[at] == group[at + d]]):
        i = at[(comp[at] != comp[at + d]) & ((side[at] != side[at + d]) | (side[at] < 0))]
        need = least_common(n[i] + n[i + d], similarity)
        ok = np.minimum(n[i] - pos[i], n[i + d] - pos[i + d]) >= need
        i, need = i[ok], need[ok]
        i = i[_differ(bits[i], bits[i + d]) <= n[i] + n[i + d] - 2 * need]
        few = (got[i] < limit) | (got[i + d] < limit)
        more = more or not few.all()
        i = i[few]
        got[i] += 1
        got[i + d] += 1
        found.append(i)
        d += 1
    i = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    return i, i + np.repeat(np.arange(1, len(found) + 1), [len(x) for x in found]), more


def open_pairs(shards: DataFrame, nodes: DataFrame, comps: DataFrame, limit: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(src, dst): candidates of different components, up to ``limit`` for each member of a task; a row of nulls where some were held back."""
    held = shards.join(comps, "fp", "left").select("sh", "fp", "n", "pos", F.coalesce("comp", "fp").alias("comp"))
    each = held.groupBy("sh", "comp").count()
    sizes = each.groupBy("sh").agg(F.max_by("comp", "count").alias("major"), F.max("count").alias("majors"), F.sum("count").alias("all")).where("all > majors")
    sizes = written(sizes.select("sh", "major", F.ceil((F.col("all") - F.col("majors")) / block).cast("int").alias("na"), F.ceil(F.col("majors") / block).cast("int").alias("nb")), "open")
    rows = held.join(sizes, "sh").join(nodes.select("fp", "bits"), "fp")
    at = rows.withColumn("of", F.expr("cast(if(comp = major, na + pmod(xxhash64(fp), nb), pmod(xxhash64(fp), na)) as int)"))
    tasks = "if(of < na, concat(transform(sequence(0, na - 1), b -> struct(least(of, b) as a, greatest(of, b) as b)), transform(sequence(na, na + nb - 1), b -> struct(of as a, b as b))), transform(sequence(0, na - 1), b -> struct(b as a, of as b)))"
    dealt = at.select("sh", "fp", "n", "pos", "comp", "bits", "of", F.expr(f"inline({tasks})"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> pa.RecordBatch:
            sh, a, b, of, fp, comp, n, pos = (rows.column(c).to_numpy() for c in ("sh", "a", "b", "of", "fp", "comp", "n", "pos"))
            group = np.concatenate([[0], np.cumsum((sh[1:] != sh[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            i, j, more = block_pairs(group, np.where(a == b, -1, of), comp, n, pos, _bits(rows.column("bits").combine_chunks()), limit, similarity)
            pairs = np.unique(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array([*x.tolist(), *[None] * more], pa.int64()) for x in pairs], ["src", "dst"])

        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])]).combine_chunks()
            keys = [rows.column(c).to_numpy() for c in ("sh", "a", "b")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(ends):
                yield out(rows.slice(0, ends[-1] + 1))
                rows = rows.slice(ends[-1] + 1)
            kept = rows
        if kept is not None:
            yield out(kept)

    dealt = dealt.repartition("sh", "a", "b").sortWithinPartitions("sh", "a", "b", "fp")
    return dealt.mapInArrow(tidy(run), "src bigint, dst bigint").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose wide parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy() + b.column("m").to_numpy()
            far = np.array([apart(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)], dtype=np.int64)
            yield b.select(["src", "dst"]).filter(pa.array(far <= n - 2 * least_common(n, similarity), pa.bool_()))

    both = pairs.join(nodes.select(F.col("fp").alias("src"), "n", F.col("wide").alias("x")), "src")
    both = both.join(nodes.select(F.col("fp").alias("dst"), F.col("n").alias("m"), F.col("wide").alias("y")), "dst")
    return both.select("src", "dst", "n", "m", "x", "y").mapInArrow(tidy(run), "src bigint, dst bigint")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float, made: list[DataFrame]) -> DataFrame:
    """Those of ``pairs`` (src, dst; written) whose texts share enough of their distinct shingles; a node's text is that of its first row.

    Only sorted hashes of linked texts move; a pair needs both of its own in memory, nothing else. ``made`` has the sets of earlier
    calls, and gets those that this one makes.
    """
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    for earlier in made:
        ends = ends.join(earlier.select("fp"), "fp", "left_anti")
    wanted = nodes.join(ends, "fp").select(F.col("least.rk").alias("key"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [distinct_shingles(t, size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["fp", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(a.as_buffer(), np.uint64) for a in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    d = documents_of(docs)
    texts = among(d, row_key(d["doc_id"], d["text"]), wanted, "linked").select(F.col("text").cast("binary").alias("text"))
    made.append(written(texts.mapInArrow(tidy(shingles), "fp bigint, h binary").dropDuplicates(["fp"]), "shingles"))
    sets = reduce(DataFrame.unionByName, made)
    both = pairs.join(sets.select(F.col("fp").alias("src"), F.col("h").alias("x")), "src").join(sets.select(F.col("fp").alias("dst"), F.col("h").alias("y")), "dst")
    return both.select("src", "dst", "x", "y").mapInArrow(tidy(compare), "src bigint, dst bigint")


def _components(found: DataFrame) -> DataFrame:
    """(fp, comp) of the linked nodes."""
    return written(components(found).select(F.col("id").alias("fp"), "comp"), "components")


def _named(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, first): for each node the first row of all nodes of its component; ``linked`` has fp and comp of those that aren't alone."""
    named = nodes.select("fp", "least").join(linked, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    names = written(named.groupBy("comp").agg(F.min("least").alias("first")), "names")
    return salted_join(named.select("fp", "comp"), names, ["comp"]).select("fp", "first")


def fingerprint_components(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, comp) of the distinct fingerprints that have a link."""
    return _components(written(links(block_shards(nodes), radius).distinct(), "links"))


def fingerprint_links(rows: DataFrame, radius: int) -> DataFrame:
    """(src, dst): of the sets ``fp`` whose fingerprints ``sim`` are in one component, each with the smallest."""
    pairs = written(rows.select("fp", "sim").distinct(), "set-fingerprints")
    comps = fingerprint_components(pairs.select(F.col("sim").alias("fp")).distinct(), radius)
    named = written(salted_join(pairs, comps.withColumnRenamed("fp", "sim"), ["sim"], "left").select("fp", F.coalesce("comp", "sim").alias("comp")), "set-components")
    least = written(named.groupBy("comp").agg(F.min("fp").alias("src"), F.max("fp").alias("most")).where("src <> most").select("comp", "src"), "least-sets")
    found = written(salted_join(named, least, ["comp"]).where("src <> fp").select("src", F.col("fp").alias("dst")).distinct(), "fingerprint-links")
    discard(pairs, comps, named, least)
    return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the contract's fingerprints, linked at two or fewer differing bits."""
    marked = written(fingerprints(docs, size), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    named = written(_named(nodes, fingerprint_components(nodes)), "named")
    return salted_join(marked, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def near_text_groups(docs: DataFrame, size: int = TEXT_SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """(doc_id, rk, component_id, first) of near texts: chains of pairs whose sets of distinct shingles reach the similarity, and with
    a ``radius`` of pairs whose fingerprints differ in so many bits or fewer.

    rk is the row's key, component_id the smallest id of the group and ``first`` the key of the row that stands for it.
    """
    marked = written(text_sets(docs, size, similarity, radius is not None), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("least")
    nodes = written(marked.groupBy("fp").agg(least, F.first(F.struct("n", "bits", "wide")).alias("of")).select("fp", "least", "of.n", "of.bits", "of.wide"), "nodes")
    shards = written(text_shards(among(marked, marked["rk"], nodes.select(F.col("least.rk").alias("key")), "first-rows"), similarity), "shards")
    made: list[DataFrame] = []

    def check(pairs: DataFrame) -> DataFrame:
        """The near ones of candidates; of the step's tables the sets alone stay."""
        left = written(possible(pairs, nodes, similarity), "pairs")
        near = written(confirmed(docs, nodes, left, size, similarity, made), "near")
        discard(left)
        return near

    found = None if radius is None else fingerprint_links(marked, radius)
    comps = None if found is None else _components(found)
    firsts = F.concat(F.when(F.col("head").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("head")), "others")
    tested = shards.select(F.explode(firsts).alias("src"), F.col("fp").alias("dst")).distinct()
    if comps is not None:
        of = lambda c: comps.select(F.col("fp").alias(c), F.col("comp").alias(f"{c}_comp"))
        tested = tested.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("src_comp is null or dst_comp is null or src_comp <> dst_comp").select("src", "dst")
    tested, limit = written(tested, "candidates"), FIRST
    near = check(tested)
    found = near if found is None else found.unionByName(near)
    comps = _components(found)
    large = among(shards, F.col("sh"), shards.where(F.col("nth") == SMALL).select(F.col("sh").alias("key")), "large").select("sh", "fp", "n", "pos")
    large = written(large, "large-shards")
    discard(shards)
    while True:
        pairs = written(open_pairs(large, nodes, comps, limit, similarity, block), "candidates")
        some = written(pairs.where("src is not null").join(tested, ["src", "dst"], "left_anti"), "new-candidates")
        if not some.isEmpty():
            more, tested = check(some), tested.unionByName(some)
            if not more.isEmpty():
                found, before = found.unionByName(more), comps
                comps = _components(found)
                discard(before)
        last = pairs.where("src is null").isEmpty()
        discard(pairs)
        if last:
            break
        limit *= GROWTH
    discard(large, *made)
    named = written(_named(nodes, comps).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.rk").alias("first")), "named")
    groups = written(salted_join(marked.select("doc_id", "rk", "fp"), named, ["fp"]).select("doc_id", "rk", "component_id", "first"), "groups")
    discard(marked, nodes, named)
    return groups


def one_of_each_group(docs: DataFrame, size: int = TEXT_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near texts, by fingerprints and by sets, all columns as they are; see the head of this module for which."""
    groups = near_text_groups(docs, size, similarity, radius=RADIUS)
    gone = groups.where("rk <> first").select(F.col("rk").alias("key")).distinct()
    again = written(groups.where("rk = first").groupBy("rk").count().where("count > 1").select(F.col("rk").alias("key")), "again")
    rest = among(docs, row_key(docs["doc_id"], docs["text"]), gone, "gone", without=True)
    if again.isEmpty():
        return rest
    key = row_key(rest["doc_id"], rest["text"])
    once = among(rest, key, again, "again-once").select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), key.alias("key"))
    once = once.groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return among(rest, key, again, "again-not", without=True).unionByName(once)
