"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Words are 64-bit hashes. Counting: a task collects the (context, word) pairs of its texts up to CHUNK of them, sorts and counts them
with numpy, and sends each shard (the leading bits of the context's hash) one packed block, so nearly equal pairs are
summed before the shuffle and cost about a dozen bytes each. A task per group of shards merges the blocks and writes the
shard's file into the shared folder: sorted pair hashes with counts, and the contexts with their totals. Word counts and
continuation counts go on to a second, much smaller shuffle by the word's own bits and are written likewise. The number of shards
follows the input, so a shard stays small at any size; a file is written under a passing name and renamed, so a repeated
task leaves the same file. The driver sees a few sums.

Hot contexts (the begin of a text, and words that make up HOT_SHARE of the tokens in every HOT_SAMPLE-th text by hash, HOT at
most) follow neither their own bits nor one shard: their pairs are dealt by a hash of both words over all shards, and their totals
are sums over shards. Which contexts are hot decides how work is dealt, never a count.

Scoring reads each text once. Workers map the files into memory and look pairs up in sorted order; no worker loads the model. Where
the shared folder is no mounted path they fetch the files they need and hold a few.

The order is two: each distinct triple of a chunk would add about 24 bytes to what is shuffled and 9 to what is kept, which on text is
over three times the input besides what pairs take.

    p(w | v) = max(c(vw) - D(c), 0) / c(v.) + g(v) p(w)      p(w) = max(n(.w) - D'(n), 0) / n(..) + g' / (V + 1)

with three discounts each; an unseen context leaves p(w), an unseen word the last term. Texts are lower-cased in A-Z; words are
runs outside x20 and x09-x0D; each text ends with one end token. Null and empty texts are the end token alone; a null id counts
as held in; rows that share an id or are repeated are counted and scored one by one. An empty table gives no rows, an empty
learning share a uniform model. Very long texts are taken whole. Counts have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents_of, share, tidy
from tessera.llm.mapped import Arrays, save, shared_folder
from tessera.plans.lineage import written

FOLDS, HELD_OUT = 7, 2
#: Pairs that a counting task holds at most; bytes of text for each shard; words that a worker remembers.
CHUNK, SHARD_BYTES, MEMO_WORDS = 4_000_000, 12_000_000, 400_000
#: See the head of this module.
HOT, HOT_SHARE, HOT_SAMPLE = 256, 1 / 1024, 64
BEGIN, END = np.uint64(0x0B0E0717), np.uint64(0xE0D0E0D0E0D)
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def token_hashes(text: bytes) -> np.ndarray:
    """The hashes of the words, then the end."""
    words = text.lower().split()
    return np.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), END)


def is_hot(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of ``v`` are among the sorted ``hot``."""
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v


def pair_hash(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keeps the leading 24 bits of ``v``, so that pairs are in order of their shards, if it isn't one of ``hot``; the rest mixes both words."""
    x = (v ^ (w * _MIX1)) * _MIX2
    x = (x ^ (x >> np.uint64(29))) * _MIX1
    x ^= x >> np.uint64(32)
    return np.where(is_hot(v, hot), x, (v & np.uint64(0xFFFFFF0000000000)) | (x >> np.uint64(24)))


def hot_contexts(docs: DataFrame) -> np.ndarray:
    """Contexts that are dealt over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, n = np.unique(np.concatenate([*map(token_hashes, b.column("text").to_pylist()), np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n, pa.int64())], ["v", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(tidy(count), "v bigint, n bigint")
    counts = written(some.groupBy("v").agg(F.sum("n").alias("n")), "sampled-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= total * HOT_SHARE).orderBy(F.desc("n"), "v").limit(HOT).collect()
    return np.unique(np.array([int(BEGIN), *(r["v"] % (1 << 64) for r in found)], dtype=np.uint64))


def contexts_of(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each token of texts laid end to end; ``ends`` are the places after each text."""
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = BEGIN
    return v


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Sorted by the last of the keys, equal rows summed."""
    order = np.lexsort(keys)
    keys, n = tuple(k[order] for k in keys), n[order]
    if not len(n):
        return keys, n
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), np.add.reduceat(n, at)


def _pack(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of v: each v once with the number of its words, then the words and the counts."""
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    runs = np.diff(np.append(at, len(v))).astype(np.uint32)
    big = np.flatnonzero(n > 255)
    head = np.array([len(at), len(v), len(big)], dtype=np.int64)
    return b"".join(a.tobytes() for a in (head, v[at], runs, w, np.minimum(n, 255).astype(np.uint8), big.astype(np.int64), n[big].astype(np.int64)))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, k, b = np.frombuffer(block, np.int64, 3)
    at = 24
    out = []
    for kind, size in ((np.uint64, m), (np.uint32, m), (np.uint64, k), (np.uint8, k), (np.int64, b), (np.int64, b)):
        out.append(np.frombuffer(block, kind, size, at))
        at += np.dtype(kind).itemsize * int(size)
    v, runs, w, small, big, counts = out
    n = small.astype(np.int64)
    n[big] = counts
    return np.repeat(v, runs), w, n


def _sums(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks by shard from rows in order of shard."""
    now, blocks = None, []
    for b in batches:
        for s, block in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), strict=True):
            if s != now:
                if blocks:
                    yield now, blocks
                now, blocks = s, []
            blocks.append(block)
    if blocks:
        yield now, blocks


def train(docs: DataFrame) -> dict:
    """Counts the texts of ``docs`` (text, binary) and writes the arrays; returns where they are, and a few sums."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / SHARD_BYTES)), 2, 24))
    shift = np.uint64(64 - bits)
    hot = hot_contexts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            w = np.concatenate(held)
            v = contexts_of(w, np.cumsum([len(x) for x in held]))
            h, first, n = np.unique(pair_hash(v, w, hot), return_index=True, return_counts=True)
            h, v, w = h >> shift, v[first], w[first]
            order = np.lexsort((v, h))
            h, v, w, n = h[order], v[order], w[order], n[order]
            shards, at = np.unique(h, return_index=True)
            blocks = [_pack(v[i:j], w[i:j], n[i:j]) for i, j in zip(at, [*at[1:], len(v)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int64)), pa.array(blocks, pa.binary())], ["shard", "block"])

        for b in batches:
            for text in b.column("text").to_pylist():
                held.append(token_hashes(text))
                total += len(held[-1])
                if total >= CHUNK:
                    yield out()
                    held, total = [], 0
        if total:
            yield out()

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blocks in _groups(batches):
            if not (blocks := [b for b in blocks if len(b)]):
                for kind, nothing in (("pair", np.empty(0, np.uint64)), ("count", np.empty(0, np.uint32)), ("context", np.empty(0, np.uint64)), ("stats", np.empty((4, 0), np.int64))):
                    save(folder, f"{kind}-{s:07d}", nothing)
                continue
            v, w, n = (np.concatenate(x) for x in zip(*map(_unpack, blocks), strict=True))
            h = pair_hash(v, w, hot)
            order = np.argsort(h, kind="stable")
            h, v, w, n = h[order], v[order], w[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, v, w, n = h[at], v[at], w[at], np.add.reduceat(n, at)
            save(folder, f"pair-{s:07d}", h)
            save(folder, f"count-{s:07d}", n.astype(np.uint32) if n.max() < 1 << 32 else n)
            order = np.argsort(v, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
            seen = v[order][first]
            stats = np.stack([np.add.reduceat(x[order].astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)])
            part = is_hot(seen, hot)
            save(folder, f"context-{s:07d}", seen[~part])
            save(folder, f"stats-{s:07d}", stats[:, ~part])
            (words,), c = _summed((w,), n)
            types = _summed((w,), np.ones(len(w), dtype=np.int64))[1]
            to, first = np.unique(words >> shift, return_index=True)
            ends = [*first[1:], len(words)]
            blocks = [np.int64(j - i).tobytes() + words[i:j].tobytes() + c[i:j].tobytes() + types[i:j].tobytes() for i, j in zip(first, ends, strict=True)]
            rows = [(t, block, None, None) for t, block in zip(to.tolist(), blocks, strict=True)]
            rows += [(None, None, c, x) for c, x in zip(seen[part].view(np.int64).tolist(), stats[:, part].T.tolist(), strict=True)]
            rows.append((None, None, None, _sums(n) + [len(n), int(n.sum())]))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["shard", "block", "context", "sums"])

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blocks in _groups(batches):
            if not (blocks := [b for b in blocks if len(b)]):
                save(folder, f"word-{s:07d}", np.empty(0, np.uint64))
                save(folder, f"uses-{s:07d}", np.empty((2, 0), np.int64))
                continue
            parts = []
            for b in blocks:
                k = int(np.frombuffer(b, np.int64, 1)[0])
                parts.append((np.frombuffer(b, np.uint64, k, 8), np.frombuffer(b, np.int64, k, 8 + 8 * k), np.frombuffer(b, np.int64, k, 8 + 16 * k)))
            w, c, t = (np.concatenate(x) for x in zip(*parts, strict=True))
            (words,), n = _summed((w,), c)
            types = _summed((w,), t)[1]
            save(folder, f"word-{s:07d}", words)
            save(folder, f"uses-{s:07d}", np.stack([n, types]))
            yield pa.RecordBatch.from_arrays([pa.array([_sums(types) + [len(words), 0]], pa.list_(pa.int64()))], ["sums"])

    every = spark.range(1 << bits).select(F.col("id").alias("shard"), F.lit(b"").alias("block"))  # so that each shard has its files
    dealt = docs.select("text").mapInArrow(tidy(count), "shard bigint, block binary").unionByName(every).repartition("shard").sortWithinPartitions("shard")
    pairs = written(dealt.mapInArrow(tidy(merge_pairs), "shard bigint, block binary, context bigint, sums array<bigint>"), "word-blocks")
    words = written(pairs.where("shard is not null").select("shard", "block").unionByName(every).repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(merge_words), "sums array<bigint>"), "word-sums")
    total = lambda df: [x or 0 for x in df.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(6)]).first()]
    of_hot = pairs.where("context is not null").groupBy("context").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(4)]).collect()
    stats = {r[0] % (1 << 64): list(r[1:]) for r in of_hot}
    return {"folder": folder, "bits": bits, "pairs": total(pairs.where("sums is not null and context is null")), "words": total(words), "hot": [(h, *stats.get(h, [0] * 4)) for h in hot.tolist()]}


def discounts(counts: list[int]) -> np.ndarray:
    """D for counts of 0, 1, 2 and 3 or more, from how many are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in counts[:4])
    if not n1:
        return np.zeros(4)
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))])


class Model:
    def __init__(self, spec: dict):
        self.pairs, self.contexts, self.words = (Arrays(spec["folder"], spec["bits"], k, v) for k, v in (("pair", "count"), ("context", "stats"), ("word", "uses")))
        self.hot = {h: stats for h, *stats in spec["hot"]}
        self.hot_keys = np.array([*self.hot], dtype=np.uint64)
        self.d2, self.d1 = discounts(spec["pairs"]), discounts(spec["words"])
        self.types, self.tokens, self.vocabulary = spec["pairs"][4], spec["pairs"][5], spec["words"][4]
        n1, n2, n3 = spec["words"][0], spec["words"][1], spec["words"][4] - spec["words"][0] - spec["words"][1]
        self.rest = float(self.d1[1:] @ [n1, n2, n3]) / self.types if self.types else 1.0

    def score(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts laid end to end: log10 p and log10 of the base of each token, and whether it is known."""
        v = contexts_of(tokens, ends)
        seen, inverse = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        uses, stats = self.words.get(seen, 2), self.contexts.get(seen, 4)
        for i in np.flatnonzero(is_hot(seen, self.hot_keys)):
            stats[:, i] = self.hot[int(seen[i])]
        low = np.maximum(uses[1] - self.d1[np.minimum(uses[1], 3)], 0) / max(self.types, 1) + self.rest / (self.vocabulary + 1)
        total = stats[0]
        back = np.where(total > 0, (self.d2[1:] @ stats[1:]) / np.maximum(total, 1), 1.0)
        word = inverse[:-1]
        before = np.searchsorted(seen, v)
        h = pair_hash(v, tokens, self.hot_keys)
        order = np.argsort(h)
        c = np.empty(len(h), dtype=np.int64)
        c[order] = self.pairs.get(h[order], 1)[0]
        p = np.maximum(c - self.d2[np.minimum(c, 3)], 0) / np.maximum(total[before], 1) + back[before] * low[word]
        base = np.log10((uses[0] + 1) / (self.tokens + self.vocabulary + 1))
        return np.log10(p), base[word], (uses[0] > 0)[word]

    def probability(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w | v) of single pairs of hashes, for tests."""
        both = np.stack([v, w], axis=1).ravel()
        return 10 ** self.score(both, np.arange(2, len(both) + 2, 2))[0][1::2]


@lru_cache(maxsize=2)
def _model(folder: str, spec: tuple) -> Model:
    return Model(dict(spec) | {"folder": folder})


def score(docs: DataFrame, spec: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    fixed = tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in spec.items() if k != "folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(spec["folder"], fixed)
        for b in batches:
            ids, held = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            texts, at = b.column("text"), 0
            while at < len(ids):
                tokens, first, total = [], at, 0
                while at < len(ids) and total < CHUNK // 4:
                    tokens.append(token_hashes(texts[at].as_py()))
                    total += len(tokens[-1])
                    at += 1
                n = np.array([len(t) for t in tokens])
                starts = np.cumsum(n) - n
                p, base, known = model.score(np.concatenate(tokens), np.cumsum(n))
                cols = [pa.array(ids[first:at], pa.int64()), pa.array(held[first:at]), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.full(len(n), model.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(p, starts))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def scored(docs: DataFrame) -> DataFrame:
    """Learns from the documents of the learning share and scores all."""
    d = documents_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(share(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return score(d, train(d.where(~F.col("held_out"))))
