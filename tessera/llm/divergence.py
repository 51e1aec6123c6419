"""Source divergence audit: how the terms of each source differ from those of the other sources and from the whole of its language.

Terms are runs of A-Z, a-z and everything beyond ASCII, lower-cased in A-Z alone. A language keeps the terms of at least MIN_DOCS of its
documents. The share p of a term in a group (a language, or a source of it) is a whole number, 1 + floor(1e9 (count + 5) / (N + 5 V)), so all
sums are exact; numerators beyond 64 bits are decimals.

Counts are sparse: only terms that a group holds have a row. A group gives each term that it lacks the same share, its baseline b. So for
two sources s and t of one language the sum of |p - q| over all V kept terms is
  V |b - c|  +  over terms of s: |p - c| - |b - c|  +  over terms of t: |b - q| - |b - c|  +  over common terms: |p - q| - |p - c| - |b - q| + |b - c|.
The first comes from the groups alone, the next two from a table of how often each share occurs in a source, and the last is added up in
tasks that hold all sources of a term: a term's rows are compared with those one, two, .. further on, and only sums for two sources leave
a task. The pairs of sources of a language are the result itself.

Terms are ranked by radix select. Histograms of the leading bits of the values, one for each group, find the digit in which the group's
K-th value lies; the next bits are counted among its rows alone, until that value is known. Rows of larger values are in. Of those
of equal value the bytes after all that they begin with in common decide in the same way, two at a time, until no digit is split. A
histogram has some thousand rows for each group at most (2^16 for bytes), whatever the number of terms, and no group is ever sorted:
only the K rows that are left are.

Null text, language and source are empty strings. Groups without terms have their pairs with sum 0 where a language keeps no term. A source
alone in its language has no pairs. Rows that share an id are documents each. Very long texts are cut into terms whole. Columns of other
names do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.llm.common import salted_join, small_batches, tidy
from tessera.plans.lineage import written

MIN_DOCS, K, PRIOR, UNIT = 30, 50, 5, 1_000_000_000
#: Bits of one digit, and how many bits a value has: it is less than 2^30 + 2.
DIGIT, BITS = 11, 33
#: Bytes of a term that one histogram takes.
BYTES = 2
#: Rows that a task compares at once, about; pairs that it holds before it adds them up.
BLOCK, HELD = 65_536, 1 << 20

#: Terms that a task holds before it hands on what it has counted.
COUNTED = 1 << 18
#: What a byte of UTF-8 becomes: A-Z lower-cased, other letters and all bytes beyond ASCII kept, everything else a blank.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, cnt, docs): occurrences of terms and documents that have them, partial sums of tasks."""
    names = ["lang", "source", "term", "cnt", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (cnt, seen) in held.items():
                own = [*cnt]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(x, pa.string()), len(own)) for x in (lang, source)] + [pa.array(own, pa.binary()), pa.array([*cnt.values()], pa.int64()), pa.array([seen[t] for t in own], pa.int64())], names)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                cnt, seen = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                cnt.update(found)
                seen.update({*found})
            if sum(len(cnt) for cnt, _ in held.values()) > COUNTED:
                yield from out()
        yield from out()

    rows = _plain(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(tidy(run), "lang string, source string, term binary, cnt bigint, docs bigint")
    return rows.withColumn("term", F.col("term").cast("string"))


def cells(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, cnt, of_lang, leads): occurrences of kept terms in each source that has them, and in the language.

    ``leads`` is true in one row of each term of a language.
    """
    held = counted(docs).groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    summed = held.select("lang", "source", "term", "cnt", F.sum("cnt").over(of_term).alias("of_lang"), F.sum("docs").over(of_term).alias("docs"), (F.min("source").over(of_term) == F.col("source")).alias("leads"))
    return summed.where(F.col("docs") >= min_docs).drop("docs")


def share(cnt: str, n: str, v: str) -> Column:
    """1 + floor(UNIT (cnt + PRIOR) / (n + PRIOR v)) of three columns, exact; 0 where a language keeps no term."""
    return F.expr(f"if({v} = 0, 0L, 1 + (cast({cnt} + {PRIOR} as decimal(20,0)) * {UNIT} div cast({n} + {PRIOR} * {v} as decimal(20,0))))")


def groups(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(g, lang, source, n, of_lang, v, b): each group with a number, its occurrences, those of the language, kept terms and baseline."""
    each = _plain(docs).select("lang", "source").distinct()
    own = held.groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    of_lang = held.groupBy("lang").agg(F.sum("cnt").alias("of_lang"), F.count_if("leads").alias("v"))
    zero = F.lit(0).cast("bigint")
    full = each.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "of_lang", "v"]).withColumn("none", zero)
    return full.select(F.monotonically_increasing_id().alias("g"), "lang", "source", "n", "of_lang", "v", share("none", "n", "v").alias("b"))


def _split(counts: DataFrame, ascending: bool = False) -> DataFrame:
    """Of (g, need, digit, n) the digit of each group that holds the need-th row, with how many rows come before that digit."""
    order = Window.partitionBy("g").orderBy(F.col("digit").asc() if ascending else F.col("digit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    return upto.where((F.col("before") < F.col("need")) & (F.col("upto") >= F.col("need"))).drop("upto")


def bounds(values: DataFrame, k: int = K) -> DataFrame:
    """(g, at, last, size): what is among the first k of a group has a value above ``at``, or that value and ``size`` bytes up to ``last`` (null: any).

    ``values`` has g, item and value, each item once in its group; a group of fewer than k rows has no bound.
    """
    digit = lambda shift: F.shiftright("value", shift)
    found: DataFrame | None = None
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        rows = values.withColumn("need", F.lit(k).cast("bigint")) if found is None else salted_join(values, found, ["g"]).where(digit(shift + DIGIT) == F.col("at"))
        counts = rows.groupBy("g", "need", digit(shift).alias("digit")).agg(F.count("*").alias("n"))
        found = written(_split(counts).select("g", (F.col("need") - F.col("before")).alias("need"), F.col("digit").alias("at"), "n"), "digits")
    done = found.where("n = need").select("g", "at", F.lit(None).cast("binary").alias("last"), F.lit(0).alias("size"))
    tied = found.where("n > need").select("g", "at", "need", F.lit(b"").alias("last"))
    while not tied.isEmpty():
        item = F.encode("item", "UTF-8")
        inside = salted_join(values, tied, ["g"]).where((F.col("value") == F.col("at")) & (F.substring(item, F.lit(1), F.octet_length("last")) == F.col("last")))
        ends = inside.groupBy("g", "at", "need").agg(F.min(item).alias("low"), F.max(item).alias("high"))
        tied = written(ends.select("g", "at", "need", common_bytes("low", "high").alias("last")), "ends")
        digit = F.substring(item, F.octet_length("last") + 1, F.lit(BYTES))
        counts = salted_join(values, tied, ["g"]).where((F.col("value") == F.col("at")) & (F.substring(item, F.lit(1), F.octet_length("last")) == F.col("last")))
        counts = counts.groupBy("g", "at", "last", "need", digit.alias("digit")).agg(F.count("*").alias("n"))
        split = _split(counts, ascending=True).select("g", "at", (F.col("need") - F.col("before")).alias("need"), F.concat("last", "digit").alias("last"), (F.octet_length("last") + BYTES).alias("size"), "n")
        found = written(split, "ties")
        done = done.unionByName(found.where("n = need").select("g", "at", "last", "size"))
        tied = found.where("n > need").select("g", "at", "need", "last")
    return done


@F.pandas_udf(BinaryType())
def common_bytes(low: pd.Series, high: pd.Series) -> pd.Series:
    """What two byte strings begin with in common."""
    return pd.Series([os.path.commonprefix([bytes(a), bytes(b)]) for a, b in zip(low, high, strict=True)], dtype=object)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    return rows.select("g", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def top_terms(values: DataFrame, k: int = K) -> DataFrame:
    """(g, part, item, value, rank): the k largest values of each group, ties by the bytes of the item."""
    bound = written(bounds(values, k), "bounds")
    begins = F.expr("substring(encode(item, 'UTF-8'), 1, size)")
    kept = salted_join(values, bound, ["g"], "left").where(F.col("at").isNull() | (F.col("value") > F.col("at")) | ((F.col("value") == F.col("at")) & (F.col("last").isNull() | (begins <= F.col("last")))))
    return _ranked(kept, "term")


def _added(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``value`` for each pair (a, b)."""
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(value, first) if len(a) else value


def common_terms(shares: DataFrame) -> DataFrame:
    """(s, t, value), s < t: over the terms that two groups of a language both have, |p - q| - |p - c| - |b - q| + |b - c|; partial sums of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            sums = _added(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sums], ["s", "t", "value"])

        def compare(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            g, p, b = (rows.column(c).to_numpy() for c in ("g", "p", "b"))
            term = np.cumsum(new)
            i, d = np.arange(len(g)), 1
            while len(i := i[i + d < len(g)]) and len(i := i[term[i] == term[i + d]]):
                j = i + d
                value = np.abs(p[i] - p[j]) - np.abs(p[i] - b[j]) - np.abs(b[i] - p[j]) + np.abs(b[i] - b[j])
                held.append(_added(np.minimum(g[i], g[j]), np.maximum(g[i], g[j]), value))
                if sum(len(h[0]) for h in held) > HELD:
                    yield out()
                d += 1

        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            lang, term = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("lang", "term"))
            new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])
            last = int(np.flatnonzero(new)[-1])
            if last and (rows.num_rows > BLOCK or rest is None):
                yield from compare(rows.slice(0, last), new[:last])
                rows = rows.slice(last)
            rest = rows
        if rest is not None:
            lang, term = (rest.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("lang", "term"))
            yield from compare(rest, np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])]))
        if held:
            yield out()

    rows = shares.select("lang", "term", "g", "p", "b").repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    return rows.mapInArrow(tidy(run), "s bigint, t bigint, value bigint")


def divergences(of: DataFrame, shares: DataFrame) -> DataFrame:
    """(g, item, value): for each group every other source of its language, and the sum of |p - q| over all kept terms."""
    other = of.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("b").alias("c"))
    pairs = salted_join(of.select("lang", "g", "b", "v"), other, ["lang"])
    alone = pairs.where("g < h").select(F.col("g").alias("s"), F.col("h").alias("t"), F.expr("v * abs(b - c)").alias("value"))
    often = written(shares.groupBy("lang", "g", "b", "p").agg(F.count("*").alias("n")), "often")
    own = salted_join(often, other, ["lang"]).where("g <> h").select(F.expr("least(g, h)").alias("s"), F.expr("greatest(g, h)").alias("t"), F.expr("n * (abs(p - c) - abs(b - c))").alias("value"))
    sums = alone.unionByName(own).unionByName(common_terms(shares)).groupBy("s", "t").agg(F.sum("value").alias("value"))
    ways = sums.select(F.inline(F.array(F.struct(F.col("s").alias("g"), F.col("t").alias("h")), F.struct(F.col("t").alias("g"), F.col("s").alias("h")))), "value")
    return salted_join(ways, other.select("h", "item"), ["h"]).select("g", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = K) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their divergence, part ``term`` the terms that a source has more of than its language."""
    small_batches(docs.sparkSession)
    held = written(cells(docs, min_docs), "cells")
    of = written(groups(docs, held), "groups")
    named = salted_join(held.select("lang", "source", "term", "cnt", F.col("of_lang").alias("cnt_lang")), of, ["lang", "source"])
    shares = written(named.select("g", "lang", "term", "b", share("cnt", "n", "v").alias("p"), share("cnt_lang", "of_lang", "v").alias("q")), "shares")
    values = shares.where("p > q").select("g", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    both = _ranked(divergences(of, shares), "pair").unionByName(top_terms(values, k))
    return salted_join(both, of.select("g", "lang", "source"), ["g"]).select("lang", "source", "part", "item", "value", "rank")
