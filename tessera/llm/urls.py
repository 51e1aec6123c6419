"""URL filters: rules first, then naive Bayes over the words that a unigram Viterbi finds in host names and paths.

Letter runs of hosts and paths (labels) are segmented into words: the split with the highest product of unigram probabilities. The
unigrams are counted over the visible text of all pages, nothing is added by hand. A string that the pages lack counts as an
unknown word, ten times less likely with each letter; no word is longer than LONGEST_WORD. A label's substrings meet the
counts in a shuffled join, so neither is broadcast; the best split is a loop over the letters of one label. Only a table whose
rows and bytes have been counted is ever broadcast; joins of others are marked, for by its own estimate Spark would send some of them through the driver.

The classifier is multinomial naive Bayes with two classes. It learns from the verdicts of the rules: every address that a
rule blocks or allows is an example, weighted by its pages, and its tokens are the words of its host and path. Addresses that
no rule fits are judged by the words they share with those. Each distinct label gets one weight, the sum over its words, and an
address the sum over its labels and the log odds of the classes; it is blocked above zero.

Labels such as ``com`` or ``www`` stand in nearly all addresses: they are counted with partial sums first, and joined by a broadcast
of checked size or with a salt. Copies of one address are spread likewise.

Null urls and those without ``://`` have an empty host and path, and are judged by the class odds. Without any page that a rule fits,
all others are allowed. Rows stay rows: a repeated url gets the same verdict each time. Nulls in page_id stay null; an empty table
gives no rows. Null html has no words. Long hosts, paths and labels are taken whole: no row but an address's
and a label's own carries them, so the work grows with their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, shuffled, small_batches, tidy
from tessera.plans.lineage import written

#: (verdict, host, path); the longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LONGEST_WORD = 24
#: Letters of a label that are cut into substrings together.
PIECE = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<verdict,rule> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages."""
    visible = F.regexp_replace(F.coalesce(pages["html"], F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _labels(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")


def viterbi(label: str, known: np.ndarray, total: float) -> list[str]:
    """The best split of ``label``: row j of ``known`` has, by length, the log probabilities of the dictionary words that end before place j, NaN elsewhere; ``total`` is the dictionary's count."""
    unknown = np.array([unknown_word(k, total) for k in range(LONGEST_WORD + 1)])
    scores = np.where(np.isnan(known), unknown, known).tolist()
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(label) + 1):
        row = scores[j]
        best.append(max((best[i][0] + row[j - i], i) for i in range(max(0, j - LONGEST_WORD), j)))
    words, j = [], len(label)
    while j:
        words.append(label[best[j][1] : j])
        j = best[j][1]
    return words[::-1]


def unknown_word(letters: int, total: float) -> float:
    return math.log(10 / (total + 10)) - letters * math.log(10)


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(l, word) from (l, label): the words of each label in the best split, repeats included; ``l`` numbers the labels, which stay where they are.

    A label has LONGEST_WORD substrings for each of its letters. They go without it: distinct substrings meet the dictionary, so a letter that
    all labels have is one row there, and what is known comes back by a broadcast of checked size or with a salt.
    """
    small_batches(labels.sparkSession)
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    own = labels.where(F.length("label") > 0).select("l", "label")
    cut = own.select("l", "label", F.explode(F.sequence(F.lit(0), F.length("label") - 1, F.lit(PIECE))).alias("from"))
    cut = cut.select("l", "from", F.substr("label", F.col("from") + 1, F.lit(PIECE + LONGEST_WORD - 1)).alias("piece"))
    begun = cut.select("l", "from", "piece", F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE)))).alias("at"))
    begun = begun.select("l", (F.col("from") + F.col("at") - 1).alias("i"), F.substr("piece", F.col("at"), F.lit(LONGEST_WORD)).alias("rest"))
    spans = begun.select("l", "i", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("k")).select("l", "i", "k", F.left("rest", "k").alias("word"))
    known = written(spans.select("word").distinct().join(shuffled(counts), "word").select("word", F.log(F.col("n") / total).alias("p")), "known-words")
    edges = salted_join(spans, known, ["word"]).groupBy("l").agg(F.collect_list(F.struct((F.col("i") + F.col("k")).alias("j"), "k", "p")).alias("edges"))
    listed = own.join(shuffled(edges), "l", "left").select("l", "label", F.coalesce("edges", F.array().cast("array<struct<j:int,k:int,p:double>>")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # a label may be very long
                label, of = b.column("label")[row].as_py(), b.column("edges").slice(row, 1).flatten()
                best = np.full((len(label) + 1, LONGEST_WORD + 1), np.nan)
                j, k, p = (of.field(c).to_numpy() for c in ("j", "k", "p"))
                best[j, k] = p
                words = viterbi(label, best, total)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("l")[row], len(words)), pa.array(words, pa.string())], ["l", "word"])

    return listed.mapInArrow(tidy(run), "l bigint, word string")


def _by_class(verdict: str) -> Column:
    return F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0))


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_and_path(pages["url"])
    urls = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    addresses = urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("r", longest_rule(F.col("host"), F.col("path")))
    addresses = written(addresses.select(F.monotonically_increasing_id().alias("a"), "host", "path", "n", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")), "addresses")
    tokens = addresses.select("a", "n", "verdict", F.explode(F.concat(_labels(F.col("host")), _labels(F.col("path")))).alias("label"))
    by_label = tokens.groupBy("label").agg(_by_class("block").alias("bad"), _by_class("allow").alias("good"))
    by_label = written(by_label.select(F.monotonically_increasing_id().alias("l"), "label", "bad", "good"), "labels")
    words = written(segment(by_label, written(word_counts(pages), "words")), "segments")

    by_word = words.join(shuffled(by_label.select("l", "bad", "good")), "l").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    by_word = written(by_word, "word-classes")
    of_bad, of_good, kinds = (x or 0 for x in by_word.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    weight = F.log((F.col("bad") + 1) / F.lit(of_bad + kinds + 1.0)) - F.log((F.col("good") + 1) / F.lit(of_good + kinds + 1.0))
    summed = salted_join(words, by_word.select("word", weight.alias("weight")), ["word"]).groupBy("l").agg(F.sum("weight").alias("weight"))
    of_label = written(by_label.join(shuffled(summed), "l").select("label", "weight"), "weights")

    bad, good = (x or 0 for x in addresses.agg(_by_class("block"), _by_class("allow")).first())
    odds = math.log((bad + 1) / (good + 1))
    unruled = tokens.where("verdict is null").select("a", "label")
    scores = salted_join(unruled, of_label, ["label"]).groupBy("a").agg(F.sum("weight").alias("w"))
    blocked = (F.coalesce("w", F.lit(0.0)) + odds) > 0
    judged = addresses.join(shuffled(scores), "a", "left").select("host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
    return salted_join(urls, written(judged, "judged"), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
