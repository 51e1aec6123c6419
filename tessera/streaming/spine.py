"""Tumbling counts that are whole: windows without events have a row, late events are added, and each closed window gets a folder.

The state is a spine of windows from the first event's to the last one's, without gaps. Nothing is dropped for being late, so there is no
watermark: a batch hands over the windows that it changed, those that it put between, and those that it closed. Before it reaches the
state, a batch is one row for each window and task, so one key may hold the spine however many events there are. An event very far
from all others makes as many windows as lie between.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.lineage import fresh_path
from tessera.streaming.events import BatchLog, run_to_end

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds.
HOUR = 3_600_000_000
#: at is a window's start in microseconds; closed: all windows up to it had ended when a later event came.
CHANGED = "at bigint, cnt bigint, closed boolean"


def window_totals(events: DataFrame, width: int = HOUR, ts: str = "ts") -> DataFrame:
    """(one, at, n): a window's start in microseconds and its events, summed within a task; null times are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for b in batches:
            at, n = np.unique(pc.drop_null(b.column("us")).to_numpy() // width * width, return_counts=True)
            held.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int32()), pa.array([*held], pa.int64()), pa.array([*held.values()], pa.int64())], ["one", "at", "n"])

    return events.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).mapInArrow(run, "one int, at bigint, n bigint")


class Spine(StatefulProcessor):
    """Counts by window, and the first, the last and the last closed one; a window is closed once one begins ``delay`` after its end."""

    def __init__(self, width: int, delay: int):
        self.width, self.delay = width, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "at bigint", "cnt bigint")
        self.ends = handle.getValueState("ends", "first bigint, last bigint, closed bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got: Counter[int] = Counter()
        for b in rows:
            for at, n in zip(b["at"].tolist(), b["n"].tolist(), strict=True):
                got[at] += n
        first, last, closed = self.ends.get() if self.ends.exists() else (min(got), min(got) - self.width, min(got) - self.width)
        low, high = min(first, *got), max(last, *got)
        changed = {*got, *range(low, first, self.width), *range(last + self.width, high + 1, self.width)}
        upto = max(closed, high - self.delay - self.width)
        now = {}
        for at in sorted(changed | {*range(closed + self.width, upto + 1, self.width)}):
            held = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
            now[at] = held + got.get(at, 0)
            if at in changed:
                self.counts.updateValue((at,), (now[at],))
        self.ends.update((low, high, upto))
        yield pd.DataFrame({"at": [*now], "cnt": [*now.values()], "closed": [at <= upto for at in now]})

    def close(self) -> None:
        pass


def spine_counts(stream: DataFrame, width: int = HOUR, delay: int = 0, ts: str = "ts") -> DataFrame:
    """(at, cnt, closed) of the windows that each batch changes or closes."""
    totals = window_totals(stream, width, ts)
    return totals.groupBy("one").transformWithStateInPandas(statefulProcessor=Spine(width, delay), outputStructType=CHANGED, outputMode="Update", timeMode="None")


def count_windows(stream: DataFrame, location: str | None = None, width: int = HOUR, delay: int = 0, ts: str = "ts", log: BatchLog | None = None) -> DataFrame:
    """Runs the counts over what there is; returns (window_start, cnt) of all windows from the first to the last.

    ``location`` holds the state, the changes of each batch, and under ``closed`` a folder for each closed window, named by its start, with
    the text ``(all,count)``. A batch that is run again leaves the same folders; an event that comes after its window was closed has
    the folder written anew with the whole count. With the same location a later run goes on where the last one stopped.
    """
    spark = stream.sparkSession
    location = location or fresh_path(spark, "windows")
    when = F.timestamp_micros("at")

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{location}/changes/n={number}")
        lines = batch.where("closed").select(F.format_string("(all,%d)", "cnt").alias("value"), F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss").alias("window"))
        lines.repartition("window").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").text(f"{location}/closed")
        batch.unpersist()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run_to_end(spine_counts(stream, width, delay, ts).writeStream.outputMode("update").option("checkpointLocation", f"{location}/state").foreachBatch(keep), "windows", log)
    finally:
        spark.conf.set(PROVIDER, before)
    rows = spark.read.schema(f"{CHANGED}, batch bigint").option("recursiveFileLookup", "true").parquet(f"{location}/changes")
    return rows.groupBy("at").agg(F.max_by("cnt", "batch").alias("cnt")).select(when.alias("window_start"), "cnt")


def closed_windows(stream: DataFrame, location: str) -> DataFrame:
    """(window, line) of the folders of closed windows."""
    return stream.sparkSession.read.schema("line string, window string").text(f"{location}/closed").select("window", "line")
