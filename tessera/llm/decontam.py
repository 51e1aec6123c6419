"""Benchmark decontamination: short test items found inside long documents.

A document leaks an item if it holds at least ``threshold`` of the item's distinct shingles (five words; an item of fewer
words is one shingle of all its words). Words are runs of letters, marks and digits, lower-cased.

Items are partitioned by size into classes of [2^j, 2^(j+1)) shingles. The MinHash sketch of an item is its k smallest
shingle hashes, k being fixed for the class: one more than an item of the class may miss. So a leaking document holds at least
one hash of the sketch, whatever its own length; an item with n shingles needs k - (n - ceil(threshold * n)) of them. Documents
that reach that number are candidates, and candidates are verified by exact containment of the shingles as text. Nothing is
missed or guessed: hashes only choose what to verify.

The benchmark's sketches are broadcast if their counted rows and bytes allow it, and so are the ids of candidates; else both joins
shuffle. Each text is cut into words once, whatever the number of item lengths below five. Null or empty texts have no
shingles and never match; in ``leaks`` rows with one doc_id count as one document, ``without_leaks`` judges rows by id and text.
Item rows with the same id and words are one item; those that share an id but not the words are items each, and null ids are ids like others.
An item without words matches nothing; an empty table gives no rows, an empty benchmark no leak. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, row_key, weigh
from tessera.plans.lineage import written

SHINGLE, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    """array<string>; empty for a null or blank text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.array_remove(F.split(plain, " "), "")


def shingle_texts(w: Column, size: int) -> Column:
    n = F.size(w) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))


def _runs(docs: DataFrame, sizes: list[int], what: str) -> DataFrame:
    """(doc_id, size, hash or shingle) of all runs of words ``w`` of each size, from zipped slices and plain columns: all is generated code."""
    names = [f"w{i}" for i in range(max(sizes))]
    zipped = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.size("w")).alias(name) for i, name in enumerate(names)])
    value = {"hash": lambda own: F.xxhash64(*[F.xxhash64(name) for name in own]), "shingle": lambda own: F.concat_ws(" ", *own)}[what]
    at = docs.select("doc_id", F.inline(zipped))
    if len(sizes) == 1:
        return at.where(F.col(names[-1]).isNotNull()).select("doc_id", F.lit(sizes[0]).alias("size"), value(names).alias(what))
    each = F.array(*[F.struct(F.lit(k).alias("size"), F.when(F.col(names[k - 1]).isNotNull(), value(names[:k])).alias(what)) for k in sizes])
    return at.select("doc_id", F.inline(each)).where(F.col(what).isNotNull())


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, size, n, shingle, hash): the distinct shingles of each item that has words."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(shingle)))
    texts = F.coalesce(*[F.when(F.col("size") == k, shingle_texts(F.col("w"), k)) for k in range(1, shingle + 1)])
    s = w.select("item_id", "size", F.explode(F.array_distinct(texts)).alias("shingle")).distinct()
    parts = F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x))
    hashed = F.coalesce(*[F.when(F.col("size") == k, F.xxhash64(*[F.get(parts, F.lit(i)) for i in range(k)])) for k in range(1, shingle + 1)])
    counts = s.groupBy("item_id").agg(F.count("*").alias("n"))
    return s.withColumn("hash", hashed).join(counts, "item_id").select("item_id", "size", "n", "shingle", "hash")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size, need, hash): the bottom-k sketch of each item."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1
    missing = lambda n: n - F.ceil(n * threshold - 1e-9)
    k = (missing(largest) + 1).cast("int")
    one = shingles.groupBy("item_id", "size", "n").agg(F.sort_array(F.collect_set("hash")).alias("h"))
    one = one.select("item_id", "size", F.greatest(F.least(k, F.size("h")) - missing(F.col("n")), F.lit(1)).cast("int").alias("need"), F.slice("h", F.lit(1), k).alias("h"))
    return one.select("item_id", "size", "need", F.explode("h").alias("hash"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document and item with containment >= threshold."""
    docs = docs.select(docs["doc_id"], docs["text"])
    of_text = F.sha2(F.array_join(words(items["text"]), " "), 256)
    kind = items.schema["item_id"].dataType
    items = items.select(F.struct(items["item_id"].alias("id"), of_text.alias("text")).alias("item_id"), items["text"])  # a struct is never null
    of_items = written(item_shingles(items, shingle), "items")
    sizes, weight = sorted(of_items.agg(F.collect_set("size")).first()[0]), weigh(of_items)
    if not sizes:
        nothing = docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"))
        return nothing.select("doc_id", "item_id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_shared", "n_shingles")], F.lit(0.0).alias("containment")).where("false")

    worded = docs.select("doc_id", words(F.col("text")).alias("w"))
    wanted = broadcast_if_small(sketches(of_items, threshold), weight)
    hits = _runs(worded, sizes, "hash").join(wanted, ["size", "hash"]).groupBy("doc_id", "item_id", "need", "hash").agg(F.lit(1).alias("one"))
    candidates = written(hits.groupBy("doc_id", "item_id", "need").count().where("count >= need").select("doc_id", "item_id"), "candidates")
    ids = written(candidates.select("doc_id").distinct(), "candidate-ids")
    near = docs.join(broadcast_if_small(ids, weigh(ids)), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    part = broadcast_if_small(of_items.select("item_id", "size", "n", "shingle"), weight)
    pairs = _runs(near, sizes, "shingle").join(part, ["size", "shingle"]).select("doc_id", "item_id", "n", "shingle").distinct()
    shared = pairs.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    kept = shared.where(F.col("n_shared") >= F.col("n") * threshold - 1e-9)
    return kept.select("doc_id", F.col("item_id.id").alias("item_id"), "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that hold no item, all columns as they are; of rows that share an id only those go whose own text leaks."""
    key = row_key(docs["doc_id"], docs["text"])
    rows = docs.select(F.struct(docs["doc_id"].alias("id"), key.alias("key")).alias("doc_id"), docs["text"].alias("text"))
    found = written(leaks(rows, items, threshold).select("doc_id.id", "doc_id.key").distinct(), "leaking")
    return docs.join(broadcast_if_small(found, weigh(found)), docs["doc_id"].eqNullSafe(found["id"]) & (key == found["key"]), "left_anti")
