"""I-Match document fingerprints: hashes of the sorted distinct terms that a lexicon of middling document frequency holds.

The lexicon keeps the terms whose inverse document frequency, ln(documents / documents with the term), lies within a band. A term that
is in one of e^high documents at least makes room for e^high times the mean number of distinct terms of a text, so its size doesn't grow
with the number of documents; it is broadcast if its counted rows and bytes allow it, else the join shuffles with a salt.

A fingerprint has the hash of all its lexicon terms, and hashes of the terms in randomised subsets of the lexicon; terms are sorted as 64-bit
numbers, by which they are dealt to subsets too. A subset that holds
many terms of a text changes with any edit, and one that holds none says nothing: so subsets of one term or so in a text are wanted,
and their size follows the text. At level l the lexicon is dealt by a hash into 2^l subsets, of which the first SUBSETS are looked at; a text
of n distinct terms has the levels floor(log2 n) and the next. Levels are nested, equal texts have equal levels, and texts that differ
in length up to fourfold share one. The likeness of two fingerprints is 1 if they are equal; else the share of equal hashes among
all hashes of either, at the levels that both have, and 0 without any.

The next document is found on ids and hashes alone: keys are dealt by ranges of (doc_id, text's hash), each range looks at its own
followers, and a range's last row meets the first of the next range, of which there is one row for each task. Texts move once, by their
key, so that the beginnings of their followers and all later grouping meet them where they are.

Terms are runs of letters, marks and digits, lower-cased. Null texts are empty; a text without lexicon terms has the hash of its whole text
instead, and is like equal texts alone. Null ids come last. Rows that share an id follow each other by their text's
hash; equal rows take one place, and each of them is returned. A single document is its own next. Very long texts are taken whole.
Other columns do no harm; an empty table gives no rows. No Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import salted_join
from tessera.llm.decontam import words
from tessera.plans.lineage import written

#: The band of inverse document frequency, the subsets of a level, bits of a subset's hash.
LOW, HIGH, SUBSETS, BITS = 1.0, 8.0, 32, 16


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) whose inverse document frequency lies within the band."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct(words(docs["text"]))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return seen.where(F.col("df").between(n * math.exp(-high), n * math.exp(-low))).select("term")


def followers(keys: DataFrame) -> DataFrame:
    """(k, next_k, prev_k, prev_half) from (k, doc_id, n_chars), the rows in order of (doc_id, k) and the first after the last."""
    order = ["none", "doc_id", "k"]
    dealt = keys.withColumn("none", F.col("doc_id").isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = written(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    near = ranges.select("range", "k", F.lead("k").over(inside).alias("next_k"), F.lag("k").over(inside).alias("prev_k"), F.lag(half).over(inside).alias("prev_half"))
    place = F.struct(*order)
    ends = ranges.groupBy("range").agg(F.min_by("k", place).alias("first"), F.max_by("k", place).alias("last"), F.max_by(half, place).alias("last_half"))
    # A row for each range: as many as there are tasks.
    around = Window.orderBy("range")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first").over(around), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(around), F.last("last").over(whole)).alias("before"),
        F.coalesce(F.lag("last_half").over(around), F.last("last_half").over(whole)).alias("before_half"),
    )
    joined = salted_join(near, written(ends, "range-ends"), ["range"])
    return joined.select("k", F.coalesce("next_k", "after").alias("next_k"), F.coalesce("prev_k", "before").alias("prev_k"), F.coalesce("prev_half", "before_half").alias("prev_half"))


def edited(docs: DataFrame) -> DataFrame:
    """(k, doc_id, n_chars, copies, prev_k, text, edited): distinct rows, and each text with its second half replaced by its follower's beginning."""
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    of_id = F.unhex(F.coalesce(F.lpad(F.hex("doc_id"), 16, "0"), F.lit("")))
    keyed = plain.select(F.concat(F.unhex(F.left(F.sha2("text", 256), F.lit(32))), of_id).alias("k"), F.struct("doc_id", "text", F.length("text").alias("n_chars")).alias("row"))
    keys = keyed.select("k", "row.doc_id", "row.n_chars").distinct()
    pointers = written(followers(keys), "followers")
    rows = keyed.groupBy("k").agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    base = rows.join(pointers, "k").where("copies > 0")  # always so; both uses of the rows keep the same columns and share one exchange
    begins = base.select(F.col("prev_k").alias("k"), F.left("row.text", F.col("prev_half")).alias("begin"))
    own = F.left("row.text", F.col("row.n_chars") - F.floor(F.col("row.n_chars") / 2).cast("int"))
    return base.join(begins, "k").select("k", "row.doc_id", "row.n_chars", "copies", "prev_k", F.col("row.text").alias("text"), F.concat(own, "begin").alias("edited"))


def signatures(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(k, of, base0, low0, high0, base1, low1, high1) of the two texts t0 and t1 of each key, ``of`` having their levels besides.

    low and high are the subsets' hashes at the two levels, with the subset's number before the hash. ``of`` travels in a row of its own,
    without terms. Bases of texts without lexicon terms are null.
    """
    level = lambda c: F.floor(F.log2(F.greatest(F.size(c), F.lit(1)))).cast("int")
    cut = texts.select("k", "of", F.array_distinct(words(F.col("t0"))).alias("a"), F.array_distinct(words(F.col("t1"))).alias("b"))
    cut = cut.select("k", F.struct("of.*", level("a").alias("level0"), level("b").alias("level1")).alias("of"), "a", "b")
    side = lambda i, c: F.struct(F.lit(i).alias("side"), c.alias("t"))
    sides = cut.select("k", "of", F.inline(F.array(side(0, F.col("a")), side(1, F.col("b")), side(2, F.array().cast("array<string>")))))
    each = sides.select("k", F.when(F.col("side") == 2, F.col("of")).alias("of"), "side", F.explode_outer("t").alias("term"))
    known = salted_join(each, terms.withColumn("h", F.xxhash64("term")), ["term"], "left").where("h is not null or side = 2")
    listed = [F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("h")))).alias(f"h{i}") for i in (0, 1)]
    held = known.select("k", "of", "side", "h").groupBy("k").agg(F.first("of", ignorenulls=True).alias("of"), *listed)

    mask = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1
    few = lambda h, m: F.filter(h, lambda x: x.bitwiseAND(F.col(m)) < SUBSETS)
    numbers = lambda of: F.transform(f"few{of}", lambda x: x.bitwiseAND(F.col(f"mask{of}")))
    # Each step has its own columns, so that a list is filtered once for all subsets; a term of the subsets of one level is in those of the level below.
    both = (0, 1)
    at = {i: F.col(f"of.level{i}") for i in both}
    base = [F.when(F.size(f"h{i}") > 0, F.xxhash64(f"h{i}")).alias(f"base{i}") for i in both]
    masks = held.select("k", "of", "h0", "h1", *[mask(at[i] + j).alias(f"mask{i}{j}") for i in both for j in both])
    low = masks.select("k", "of", "mask00", "mask01", "mask10", "mask11", *base, *[few(f"h{i}", f"mask{i}0").alias(f"few{i}0") for i in both])
    high = low.select("*", *[few(f"few{i}0", f"mask{i}1").alias(f"few{i}1") for i in both])
    numbered = high.select("*", *[F.array_sort(F.array_distinct(numbers(f"{i}{j}"))).alias(f"numbers{i}{j}") for i in both for j in both])

    def subsets(of: str) -> Column:
        own = lambda n: F.xxhash64(F.filter(f"few{of}", lambda x: x.bitwiseAND(F.col(f"mask{of}")) == n)).bitwiseAND(F.lit((1 << BITS) - 1))
        return F.transform(f"numbers{of}", lambda n: (n * (1 << BITS) + own(n)).cast("int"))

    return numbered.select("k", "of", *[x for i in both for x in (F.col(f"base{i}"), subsets(f"{i}0").alias(f"low{i}"), subsets(f"{i}1").alias(f"high{i}"))])


def fingerprint(s: str) -> Column:
    """The text form: hash of all terms, level, hashes of both levels' subsets."""
    marks = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), (BITS + 8) // 4, "0")), "")
    return F.lower(F.concat_ws(":", F.lpad(F.hex(f"base{s}"), 16, "0"), F.col(f"level{s}").cast("string"), marks(f"low{s}"), marks(f"high{s}")))


def likeness(s: str, t: str) -> Column:
    """Of the fingerprints in the columns that end in ``s`` and ``t``."""

    def of(*pairs: tuple[str, str]) -> Column:
        common = sum((F.size(F.array_intersect(a, b)) for a, b in pairs), F.lit(0))
        either = sum((F.size(F.array_union(a, b)) for a, b in pairs), F.lit(0))
        return F.when(either > 0, common / either).otherwise(0.0)

    step = F.col(f"level{t}") - F.col(f"level{s}")
    same = (F.col(f"base{s}") == F.col(f"base{t}")) & (step == 0)
    low, high = (f"low{s}", f"low{t}"), (f"high{s}", f"high{t}")
    shared = F.when(step == 0, of(low, high)).when(step == 1, of((f"high{s}", f"low{t}"))).when(step == -1, of((f"low{s}", f"high{t}"))).otherwise(0.0)
    return F.when(same, 1.0).otherwise(shared)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    terms = written(lexicon(docs, low, high), "lexicon")
    texts = edited(docs)
    of = F.struct("doc_id", "n_chars", "copies", "prev_k", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"))
    found = signatures(texts.select("k", of.alias("of"), F.col("text").alias("t0"), F.col("edited").alias("t1")), terms).select("*", "of.*").drop("of")
    whole = lambda c: F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("bigint")  # noqa: E731  the first 64 bits of a text's SHA-256
    found = found.withColumn("base0", F.coalesce("base0", whole("k"))).withColumn("base1", F.coalesce("base1", whole("edited_sha256")))
    found = written(found, "signatures")
    follower = found.select(F.col("prev_k").alias("k"), *[F.col(f"{c}0").alias(f"{c}2") for c in ("base", "level", "low", "high")])
    both = found.join(follower, "k")
    both = both.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), fingerprint("0").alias("fingerprint"), fingerprint("1").alias("edited_fingerprint"), likeness("0", "1").alias("near_edited"), likeness("0", "2").alias("near_next"), "copies")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy")
