"""Inverted index, postings lookup, Boolean retrieval in reverse Polish notation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ellipsis, tokenize
from tessera.sources.ranged import fetch_lines
from tessera.sources.text import write_sorted

#: Document numbers of one row of the index.
SEGMENT = 65_536


def postings(texts: DataFrame, docno: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, docno, tf)."""
    tokens = texts.select(F.explode(tokenize(F.col(text))).alias("term"), F.col(docno).alias("docno"))
    return tokens.groupBy("term", "docno").agg(F.count("*").alias("tf"))


def store(posts: DataFrame, path: str) -> DataFrame:
    """Writes the postings in order of terms, and reads them back: a lookup then skips what can't hold its term."""
    write_sorted(posts, path, "term")
    return stored(posts.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, docno bigint, tf bigint").parquet(path)


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def build_index(posts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(term, segment, df, postings): the postings of a term in order of docno, in segments of ``segment`` document numbers.

    Segments follow each other, so a term of very many documents is several rows of bounded size; df counts within the row.
    """
    listed = posts.groupBy("term", F.floor(F.col("docno") / segment).alias("segment"))
    return listed.agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("docno", "tf"))).alias("postings"))


def lookup(posts: DataFrame, term: str) -> DataFrame:
    """(docno, tf) of one term; no rows if it is absent. The predicate reaches the scan of a stored index."""
    return posts.where(F.col("term") == term).select("docno", "tf")


def tf_histogram(posts: DataFrame, term: str) -> DataFrame:
    """(tf, n_docs)."""
    return lookup(posts, term).groupBy("tf").agg(F.count("*").alias("n_docs"))


def store_line_index(lines: DataFrame, path: str) -> DataFrame:
    """The postings of (file, docno, line), docno being a line's offset, in order of terms; read back by ``stored_line_index``."""
    posts = postings(lines.select(F.struct("file", "docno").alias("place"), "line"), "place", "line")
    write_sorted(posts.select("term", "docno.file", "docno.docno", "tf"), path, "term")
    return stored_line_index(lines.sparkSession, path)


def stored_line_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, docno struct<file, docno>, tf)."""
    return spark.read.schema("term string, file string, docno bigint, tf bigint").parquet(path).select("term", F.struct("file", "docno").alias("docno"), "tf")


def matching_lines(index: DataFrame, query: str, width: int | None = 80) -> DataFrame:
    """(file, docno, line, n_read) of the lines that satisfy ``query``, each fetched by its offset; no text is scanned."""
    return fetch_lines(boolean(index, query).select("docno.file", "docno.docno"), width)


def _evaluate(query: str, operand: Callable[[str], Any], both: Callable[[Any, Any], Any], either: Callable[[Any, Any], Any]) -> Any:
    """A query in reverse Polish notation over whatever ``operand`` makes of a word."""
    stack = []
    for word in query.split():
        if word not in ("AND", "OR"):
            stack.append(operand(word))
            continue
        if len(stack) < 2:
            raise ValueError(f"{word} needs two operands: {query!r}")
        right, left = stack.pop(), stack.pop()
        stack.append((both if word == "AND" else either)(left, right))
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} results are left on the stack: {query!r}")
    return stack[0]


def boolean(posts: DataFrame, query: str) -> DataFrame:
    """(docno) that satisfy a query such as ``white red OR rose AND``.

    Words are taken as they are; only the exact AND and OR are operators. An absent term is the empty set; an operator
    without two operands, or operands left over, raise ValueError. All terms are read in one scan, which a stored index prunes;
    a document's hits meet in one partial aggregate. ``docno`` may be a struct, such as a file and an offset.
    """
    terms = sorted({*query.split()} - {"AND", "OR"})
    kept = _evaluate(query, lambda word: F.col(f"t{terms.index(word)}"), lambda x, y: x & y, lambda x, y: x | y)
    held = posts.where(F.col("term").isin(*terms)).groupBy("docno").agg(*[F.bool_or(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(terms)])
    return held.where(kept).select("docno")


def bitmaps(posts: DataFrame) -> DataFrame:
    """(term, bucket, bits): the document numbers of a term as bitmaps, a row for each bucket of 32,768 numbers that has any."""
    return posts.groupBy("term", F.bitmap_bucket_number("docno").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("docno")).alias("bits"))


def store_bitmaps(posts: DataFrame, path: str) -> DataFrame:
    """Writes the bitmaps in order of terms and buckets, a common term over several files, and reads them back."""
    bitmaps(posts).repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(path)
    return stored_bitmaps(posts.sparkSession, path)


def stored_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, bucket bigint, bits binary").parquet(path)


def boolean_bits(index: DataFrame, query: str) -> DataFrame:
    """(bucket, bits) of the documents that satisfy ``query``, as ``boolean`` has it: bucket by bucket, without a row for a document."""

    def merged(left: DataFrame, right: DataFrame, how: Callable[[str], Column], least: int) -> DataFrame:
        rows = left.unionByName(right).groupBy("bucket").agg(how("bits").alias("bits"), F.count("*").alias("sides"))
        return rows.where(F.col("sides") >= least).select("bucket", "bits")

    found = _evaluate(
        query,
        lambda word: index.where(F.col("term") == word).select("bucket", "bits"),
        lambda x, y: merged(x, y, F.bitmap_and_agg, 2),
        lambda x, y: merged(x, y, F.bitmap_or_agg, 1),
    )
    return found.where(F.bitmap_count("bits") > 0)


def docnos(found: DataFrame) -> DataFrame:
    """(docno) of (bucket, bits), ascending: buckets are put in order, and a bucket's numbers come out of its bits in order."""
    span = 32_768
    ahead = F.col("bucket") > 0  # buckets up to 0 count downwards
    way = lambda n: F.when(ahead, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)))
    octets = found.orderBy("bucket").select("bucket", "bits", F.explode(way(span // 8)).alias("at"))
    octets = octets.select("bucket", "at", F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int").alias("octet")).where("octet > 0")
    bits = octets.select("bucket", "octet", "at", F.explode(way(8)).alias("bit")).where(F.getbit(F.col("octet").cast("bigint"), F.col("bit")) == 1)
    place = F.col("at") * 8 + F.col("bit")
    return bits.select(F.when(ahead, (F.col("bucket") - 1) * span + 1 + place).otherwise(F.col("bucket") * span - place).alias("docno"))


def snippets(texts: DataFrame, docno: str = "doc_id", text: str = "text") -> DataFrame:
    """(docno, snippet): the first 80 characters of each text's first line."""
    return texts.select(F.col(docno).alias("docno"), ellipsis(F.get(F.split(text, "\n", 2), F.lit(0))).alias("snippet"))


def store_snippets(texts: DataFrame, path: str) -> DataFrame:
    """Snippets in order of their documents, so that hits are met without reading texts."""
    write_sorted(snippets(texts), path, "docno")
    return texts.sparkSession.read.schema("docno bigint, snippet string").parquet(path)


def with_snippets(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with their snippets (``texts`` has docno and snippet), in order of docno."""
    return hits.join(texts, "docno").orderBy("docno")
