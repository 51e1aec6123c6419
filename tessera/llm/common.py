"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a broadcast side may have at most: rows, and bytes of its values as text.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Copies of the smaller side of a salted join.
SALTS = 16


def weigh(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (of the values as text) of a written table."""
    size = F.octet_length(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])).cast("bigint")
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    return n, total or 0


def broadcast_if_small(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes (see ``weigh``) allow it; else a shuffled join does the same work."""
    return F.broadcast(df) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked for a join that shuffles it. Spark's own estimate is the bytes of compressed files, whatever rows are exploded from them, so it would broadcast what doesn't fit the driver."""
    return df.hint("merge")


def salted_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """A join of ``df`` with ``small``, of which each key has few rows, that doesn't send all rows of a hot key to one task.

    Small sides are broadcast; others are copied once for each salt, and the copies shuffled. ``how`` is inner or left.
    """
    size = weigh(small)
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), on, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(copies), [*on, "__salt"], how).drop("__salt")


#: Bytes of one Arrow batch: what a Python worker and its executor hold of a partition at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand over at most BATCH_BYTES at a time; long texts and packed blocks make 64 MB of few rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which its worker gives freed memory back: idle workers share the executor's memory with later stages."""

    def then(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return then


def share(key: Column, parts: int) -> Column:
    """crc32 of ``key`` as text, modulo ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that stand for a row: its id and its text (null: empty). Rows that share an id but not the text differ."""
    return F.xxhash64(doc_id.cast("bigint"), F.coalesce(text, F.lit("")))


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that further columns of any name do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *[docs[c] for c in columns])
