"""Word and bigram counts, relative frequencies, co-occurrence, integer means, histograms, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import adjacent, around, tokenize
from tessera.plans.lineage import written

#: Entries of one map, about; words of more that are broadcast at most.
PART, HEAVY = 65_536, 100_000


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, cnt). Tokens do not cross blanks, so whole texts need no cutting into lines."""
    return texts.select(F.explode(tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest ``by``; ties in order of the other columns. Plans as a per-partition heap and a merge."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def _pairs(lines: DataFrame, line: str) -> DataFrame:
    return lines.select(tokenize(F.col(line)).alias("t")).select(F.inline(adjacent(F.col("t"))))


def bigram_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """(bigram, cnt) of neighbours on one line."""
    counts = _pairs(lines, line).groupBy("l", "r").agg(F.count("*").alias("cnt"))
    return counts.select(F.concat_ws(" ", "l", "r").alias("bigram"), "cnt")


def _shares(lines: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """(l, r, val) and (l, total).

    The pair counts are already small, so the marginal comes from them: a second, partially aggregated sum instead of a
    window that would hold all pairs of a frequent word in one task. The null test stands before both uses of the counts,
    so that their plans are the same and one exchange serves both.
    """
    counts = _pairs(lines, line).where(F.col("l").isNotNull()).groupBy("l", "r").agg(F.count("*").alias("cnt"))
    total = counts.groupBy("l").agg(F.sum("cnt").alias("total"))
    return counts.join(total, "l").select("l", "r", (F.col("cnt") / F.col("total")).alias("val")), total


def bigram_relfreq_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """(l, r, val): P(r after l); the row r='*' has the number of bigrams that start with l."""
    shares, total = _shares(lines, line)
    return shares.unionByName(total.select("l", F.lit("*").alias("r"), F.col("total").cast("double").alias("val")))


def _stripes(pairs: DataFrame, part: int) -> DataFrame:
    """(l, part, total, e): the entries (r, cnt) of each word, and the sum of all its counts. A word of more than ``part`` neighbours has several rows, by a hash.

    The pairs are written once. Words of so many neighbours are few: as many as fit ``part`` times into the pairs at most. Where there are
    none, nothing is joined; up to HEAVY of them are broadcast.
    """
    pairs = written(pairs, "pairs")
    heavy = written(pairs.groupBy("l").agg(F.count("r").alias("kinds"), F.sum("cnt").alias("whole")).where(F.col("kinds") > part), "heavy")
    n = heavy.count()
    if n:
        pairs = pairs.join(F.broadcast(heavy) if n <= HEAVY else heavy, "l", "left")
        number = F.coalesce(F.pmod(F.xxhash64("r"), F.ceil(F.col("kinds") / part)).cast("int"), F.lit(0))
        whole = F.coalesce(F.first("whole"), F.sum("cnt"))
    else:
        number, whole = F.lit(0), F.sum("cnt")
    entries = F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "cnt")))
    return pairs.withColumn("part", number).groupBy("l", "part").agg(whole.alias("total"), entries.alias("e"))


def bigram_relfreq_stripes(lines: DataFrame, line: str = "line", part: int = PART) -> DataFrame:
    """(l, part, freqs map<string,double>): one map for each word, or several with about ``part`` neighbours each."""
    counts = _pairs(lines, line).where(F.col("l").isNotNull()).groupBy("l", "r").agg(F.count("*").alias("cnt"))
    shares = F.transform("e", lambda x: F.struct(x["r"], x["cnt"] / F.col("total")))
    return _stripes(counts, part).select("l", "part", F.map_from_entries(shares).alias("freqs"))


def cooccur_pairs(lines: DataFrame, window: int = 2, line: str = "line") -> DataFrame:
    """(l, r, cnt) of tokens within ``window`` places on one line; a repeated word meets itself."""
    pairs = lines.select(tokenize(F.col(line)).alias("t")).select(F.inline(around(F.col("t"), window)))
    return pairs.groupBy("l", "r").agg(F.count("*").alias("cnt"))


def cooccur_stripes(lines: DataFrame, window: int = 2, line: str = "line", part: int = PART) -> DataFrame:
    """(l, part, counts map<string,bigint>), as in bigram_relfreq_stripes; a word that is always alone on its line has an empty map."""
    alone = F.array(F.struct(F.col("t")[0].alias("l"), F.lit(None).cast("string").alias("r")))
    met = lines.select(tokenize(F.col(line)).alias("t")).select(F.inline(F.when(F.size("t") == 1, alone).otherwise(around(F.col("t"), window))))
    return _stripes(met.groupBy("l", "r").agg(F.count("r").alias("cnt")), part).select("l", "part", F.map_from_entries("e").alias("counts"))


def log_sum_by_key(pairs: DataFrame, key: str = "k", value: str = "x") -> DataFrame:
    """(k, x): ln of the sum of e^x for each key, against the key's largest value, so nothing overflows; nulls are left out."""
    known = pairs.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("x"))
    tops = known.groupBy("k").agg(F.max("x").alias("top"))
    summed = known.join(tops, "k").groupBy("k", "top").agg(F.sum(F.when(F.col("x") == F.col("top"), 1.0).otherwise(F.exp(F.col("x") - F.col("top")))).alias("s"))
    return summed.select("k", (F.col("top") + F.log("s")).alias("x"))


def int_mean(pairs: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """(k, mean), the mean cut towards zero to a whole number."""
    return pairs.groupBy(F.col(key).alias("k")).agg(F.expr(f"cast(sum(cast({value} as bigint)) div count({value}) as int)").alias("mean"))
