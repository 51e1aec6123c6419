"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Lexicon. Words that toxic rows of the learning share hold and clean ones don't. Each word's toxic and clean texts are counted
   in Spark over all labelled rows; every word that toxic rows hold several times as often as chance would have it is kept.
   Such a word needs several toxic rows, so the lexicon, which the workers hold, is bounded by the labelled toxic words.
2. Voters. Sixteen yes-or-no voters read a text: eight hold a part of the lexicon each, the others look for several hits, dense
   hits, hits behind symbols or blanks inside words, shouting, strings of exclamation marks, and address. A document's votes are
   16 bits, so all documents together have 65,536 patterns at most, and the counts of patterns are all that the driver sees.
3. Label model. Expectation maximisation over the counts estimates how often each voter fires for either class; labelled rows
   of the share keep their label. Voters that go together more than the class explains are found from the fitted model and
   put into one factor with a joint distribution (of ``largest`` voters at most, a parameter: a table of 2^largest numbers has
   to be estimated); then the model is fitted again. So correlated voters don't count twice.
4. Classifier. Logistic regression on lexicon words and votes, trained on the posteriors of FIT_ROWS rows at most, chosen by a
   hash of the id. The OWN words of the largest gain have a weight each, all others share POOLS weights by their gain (a text
   counts each of its words). So its weights are a few hundred numbers; scoring is one pass without a shuffle.

Null and empty texts get the score of a text without any feature. Without labels, or without a toxic one, no voter has a
lexicon and every score is the prior. Labels are joined by doc_id; an id with several labels is toxic if one is, and a label counts
for every row of its id. Rows are scored one by one and removed by id and text, so of rows that share an id only those that
read as toxic go. Very long texts are read whole; a word of more than LONG_WORD bytes is known by its digest. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, documents_of, row_key, share, tidy, weigh
from tessera.llm.mapped import among
from tessera.plans.lineage import written

#: Folds of crc32 of the id, of which the first is held out; lexicon words with a weight of their own; weights of all others.
FOLDS, OWN, POOLS = 5, 200, 8
#: Rows to fit the classifier on, in order of a hash of the id.
FIT_ROWS = 20_000
#: For a word of the lexicon: least toxic rows, least log-likelihood ratio (20: over four standard errors) and least log odds.
LEAST_ROWS, GAIN, ODDS = 3, 20.0, float(np.log(8))
LONG_WORD = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")
_INSIDE = re.compile(rb"[A-Za-z]+(?:[0-9@$!*._-]+[A-Za-z]+)+|[0-9@$][A-Za-z0-9@$]{2,}")
_SPACED = re.compile(rb"(?<![A-Za-z])[A-Za-z](?:[ .-][A-Za-z]){3,}(?![A-Za-z])")
_DROP = re.compile(rb"[*._ -]")


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(_FOLD).split()
    return words if all(len(w) <= LONG_WORD for w in words) else [w if len(w) <= LONG_WORD else b"md5 " + md5(w).hexdigest().encode() for w in words]


class Voters:
    """Votes (16 bits) and lexicon words (their numbers) of a text."""

    def __init__(self, lexicon: list[str]):
        self.number = {w.encode(): i for i, w in enumerate(lexicon)}
        self.known = frozenset(self.number)

    def read(self, text: bytes) -> tuple[int, list[int]]:
        words = words_of(text)
        hits = sorted(self.number[w] for w in self.known.intersection(words))
        votes = 0
        for i in hits:
            votes |= 1 << i % 8
        if len(hits) > 1:
            votes |= 1 << 8
        if hits and 50 * sum(w in self.known for w in words) >= len(words):
            votes |= 1 << 9
        hidden = set()
        for bit, found in ((10, _INSIDE.findall(text)), (11, _SPACED.findall(text))):
            plain = {_DROP.sub(b"", x.translate(_LEET)).lower() for x in found} | {_DROP.sub(b"", x).lower() for x in found}
            if got := self.known.intersection(plain):
                votes |= 1 << bit
                hidden |= got
        upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if 2 * upper > len(text):
            votes |= 1 << 12
        if 20 * text.count(b"!!") > len(words):
            votes |= 1 << 13
        if hits and b"you" in words:
            votes |= 1 << 14
        if len(hits) + len(hidden) > 3:
            votes |= 1 << 15
        return votes, sorted({*hits, *(self.number[w] for w in hidden)})


def feature_of(i: int) -> int:
    """The number of the weight of the i-th lexicon word: its own, or one that words of some gain share, by octaves of their rank."""
    return i if i < OWN else OWN + min((i // OWN).bit_length() - 1, POOLS - 1)


def lexicon(toxic: DataFrame, clean: DataFrame) -> list[str]:
    """All words that mark toxic rows, largest gain first; both have text (binary)."""

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[w.decode("utf-8", "replace") for w in set(words_of(t))] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w for s in sets for w in s], pa.string())], ["word"])

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return texts.select("text").mapInArrow(tidy(distinct_words), "word string").groupBy("word").agg(F.count("*").alias(name))

    toxic_rows, clean_rows = toxic.count(), clean.count()
    if not toxic_rows or not clean_rows:
        return []
    held = counted(toxic.select("text").distinct(), "a").where(F.col("a") >= LEAST_ROWS)
    both = held.join(counted(clean, "b"), "word", "left").select("word", F.col("a").cast("double"), F.coalesce("b", F.lit(0)).cast("double").alias("b"))
    rate, a, b = toxic_rows / (toxic_rows + clean_rows), F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (toxic_rows + 1)) - F.log((b + 0.5) / (clean_rows + 1))
    gain = 2 * (a * F.log(a / ((a + b) * rate)) + b * F.log(F.greatest(b, F.lit(1e-9)) / ((a + b) * (1 - rate))))
    keep = both.select("word", gain.alias("gain"), odds.alias("odds")).where((F.col("gain") >= GAIN) & (F.col("odds") >= ODDS))
    return [w for _, w in sorted((-r["gain"], r["word"]) for r in keep.collect())]


@dataclass
class LabelModel:
    """P(votes | class) as a product over groups of voters; groups of several have a joint table."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]

    @staticmethod
    def _codes(votes: np.ndarray, group: list[int]) -> np.ndarray:
        return sum((votes >> v & 1) << k for k, v in enumerate(group))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for group, table in zip(self.groups, self.tables, strict=True):
            code = self._codes(votes, group)
            odds += np.log(table[1][code]) - np.log(table[0][code])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def maximise(self, votes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> None:
        self.prior = float(np.clip((weight @ p + 1) / (weight.sum() + 20), 1e-6, 1 - 1e-6))
        for group, table in zip(self.groups, self.tables, strict=True):
            code = self._codes(votes, group)
            for y, q in ((0, 1 - p), (1, p)):
                n = np.bincount(code, weight * q, minlength=table.shape[1]) + 0.5
                table[y] = n / n.sum()


def fit_label_model(votes: np.ndarray, known: np.ndarray, weight: np.ndarray, voters: int = 16, rounds: int = 30, least: float = 0.3, largest: int = 4) -> LabelModel:
    """From the counts (weight) of vote patterns; known is the label of labelled ones, else -1."""

    def run(groups: list[list[int]]) -> tuple[LabelModel, np.ndarray]:
        model = LabelModel(0.1, groups, [np.full((2, 1 << len(g)), 1.0 / (1 << len(g))) for g in groups])
        model.maximise(votes, np.where(known >= 0, weight, 0), np.where(known > 0, 1.0, 0.0))
        for _ in range(rounds):
            p = np.where(known >= 0, known, model.posterior(votes)).astype(float)
            model.maximise(votes, weight, p)
        return model, p

    bits = (votes[:, None] >> np.arange(voters) & 1).astype(float)
    groups = [[v] for v in range(voters)]
    while True:  # the strongest dependence first: others may only mirror it, and vanish when it is modelled
        model, p = run(groups)
        found = []
        for q in (1 - p, p):
            w = weight * q
            mean = w @ bits / max(w.sum(), 1e-9)
            d = bits - mean
            sd = np.sqrt(np.maximum(w @ (d * d) / max(w.sum(), 1e-9), 1e-9))
            corr = (d * w[:, None]).T @ d / max(w.sum(), 1e-9) / np.outer(sd, sd)
            found += [(abs(corr[i, j]), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups[:a]) if len(g) + len(h) <= largest for i in g for j in h if abs(corr[i, j]) > least and min(mean[i], mean[j]) * w.sum() > 5]
        if not found:
            return model
        _, a, b = max(found)
        groups = [g for n, g in enumerate(groups) if n not in (a, b)] + [sorted(groups[a] + groups[b])]


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last of a constant, of logistic regression on soft labels: Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, rk, score) of every row, rk being its key; learns from rows outside the held-out share alone."""
    d = documents_of(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("text").cast("binary").alias("text"))
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(share(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "labels")
    known_size = weigh(known)
    learning = d.where(share(F.col("doc_id"), FOLDS) != 0)
    words = lexicon(*[learning.join(broadcast_if_small(known.where(known["toxic"] == y), known_size), "doc_id") for y in (1, 0)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(words)
        for b in batches:
            got = [voters.read(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array([v for v, _ in got], pa.int32()), pa.array([[feature_of(i) for i in h] for _, h in got], pa.list_(pa.int16()))], ["doc_id", "rk", "votes", "hits"])

    votes = written(d.mapInArrow(tidy(read), "doc_id bigint, rk bigint, votes int, hits array<smallint>"), "votes")
    patterns = votes.join(broadcast_if_small(known, known_size), "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("known")).count().toPandas()
    if patterns.empty:
        return votes.select("doc_id", "rk", F.lit(0.0).alias("score"))
    label_model = fit_label_model(patterns["votes"].to_numpy(np.int64), patterns["known"].to_numpy(np.int64), patterns["count"].to_numpy(float))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id", "rk").limit(fit_rows).select("votes", "hits").toPandas()
    own = feature_of(len(words) - 1) + 1 if words else 0
    x = np.zeros((len(sample), own + 16))
    for i, hits in enumerate(sample["hits"]):
        np.add.at(x[i], np.asarray(hits, dtype=np.int64), 1)
    bits = sample["votes"].to_numpy(np.int64)
    x[:, own:] = bits[:, None] >> np.arange(16) & 1
    weights = fit_linear(x, label_model.posterior(bits))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_votes = ((np.arange(1 << 16)[:, None] >> np.arange(16) & 1) @ weights[own:-1]) + weights[-1]
        for b in batches:
            z = of_votes[b.column("votes").to_numpy()] + np.array([weights[h].sum() for h in b.column("hits").to_numpy(zero_copy_only=False)] or [], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "rk", "score"])

    return votes.mapInArrow(tidy(judge), "doc_id bigint, rk bigint, score double")


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return scored_rows(docs, labels, fit_rows).select("doc_id", (share(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, all columns as they are."""
    bad = scored_rows(docs, labels).where("score >= 0.5").select(F.col("rk").alias("key")).distinct()
    return among(docs, row_key(docs["doc_id"], docs["text"]), bad, "toxic", without=True)
