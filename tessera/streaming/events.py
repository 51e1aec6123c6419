"""Counts of events in tumbling windows, as a stream and as a batch, and logs of what a stream did."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from tessera.plans.lineage import fresh_path


def hourly_count(events: DataFrame, ts: str = "ts", width: str = "60 minutes", delay: str | None = None) -> DataFrame:
    """(window_start, cnt) of the windows that have events.

    The plan serves a batch and a stream. As a stream without ``delay`` it counts every event, however late, and state grows with the number
    of windows. With ``delay``, which a batch ignores, a stream forgets windows that ended so long before the latest event and drops
    what comes for them later: only for streams that are known never to be so late.
    """
    kind = events.schema[ts].dataType
    if delay:  # watermarks know timestamps with a zone alone
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").cast(kind).alias("window_start"), "cnt")


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1, schema: StructType | None = None) -> DataFrame:
    """Parquet files as a stream, a few at a time, by the times they were written at; see ``sources.arrivals`` for the order of names."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class BatchLog(StreamingQueryListener):
    """What the engine itself reports of the batches of one query: rows read, and rows held in state."""

    def __init__(self):
        self.name, self.rows, self.ended = "", [], threading.Event()
        self._run = None

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.rows.append((p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        if event.runId == self._run:
            self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch, rows, state_rows) of the batches that had data, kept as a table in the shared folder."""
        path = fresh_path(spark, "batch-log")
        spark.createDataFrame(self.rows, "batch bigint, rows bigint, state_rows bigint").coalesce(1).write.parquet(path)
        return spark.read.schema("batch bigint, rows bigint, state_rows bigint").parquet(path)


def run_to_end(writer: DataStreamWriter, label: str, log: BatchLog | None = None) -> None:
    """Runs a query until its source has nothing new, batch after batch, then stops it; ``log`` hears of its batches."""
    spark = SparkSession.active()
    name = f"{label}-{uuid.uuid4().hex[:8]}"
    if log:
        log.name = name
        spark.streams.addListener(log)
    try:
        query = writer.queryName(name).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        if log:
            log.ended.wait(60)
    finally:
        if log:
            spark.streams.removeListener(log)


def run_available(counts: DataFrame, label: str = "stream", location: str | None = None, keys: tuple[str, ...] = ("window_start",), log: BatchLog | None = None) -> DataFrame:
    """Runs a streaming aggregate over what is there, then stops; returns its state: the columns, and the batch of the last change.

    Update mode hands over only the rows that a batch touched; the last batch that touched a row has its final value.
    Batches and state live in ``location``. With the same location a later run goes on where the last one stopped and reads
    new files alone; without one they go to a new place in the shared folder, and nothing is resumed.
    """
    spark = counts.sparkSession
    location = location or fresh_path(spark, label)
    out, state = f"{location}/batches", f"{location}/state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/n={number}")

    run_to_end(counts.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep), label, log)
    rows = spark.read.schema(StructType([*counts.schema.fields, StructField("batch", LongType())])).option("recursiveFileLookup", "true").parquet(out)
    values = [c for c in counts.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values], F.max("batch").alias("batch"))


def batch_counts(stream: DataFrame, label: str = "batches", location: str | None = None, ts: str = "ts", log: BatchLog | None = None) -> DataFrame:
    """(batch, cnt, first_ts) of the completed batches of a stream, in order of arrival; their number is that of the rows."""
    spark = stream.sparkSession
    location = location or fresh_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.agg(F.lit(number).cast("bigint").alias("batch"), F.count("*").alias("cnt"), F.min(ts).alias("first_ts")).write.mode("overwrite").parquet(f"{location}/counts/n={number}")

    run_to_end(stream.writeStream.option("checkpointLocation", f"{location}/state").foreachBatch(keep), label, log)
    return spark.read.schema(StructType([StructField("batch", LongType()), StructField("cnt", LongType()), StructField("first_ts", stream.schema[ts].dataType)])).option("recursiveFileLookup", "true").parquet(f"{location}/counts").select("batch", "cnt", "first_ts")


def arrive(events: DataFrame, path: str, name: Column) -> None:
    """Writes events as arrivals: a folder for each ``name``, all in one write; a large one is several tasks' work."""
    events.withColumn("arrival", name).hint("rebalance", "arrival").write.partitionBy("arrival").parquet(path)
