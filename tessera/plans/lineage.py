"""Where iterative jobs cut their lineage: always reliable storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Where the tables of ``written`` lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may leave it unset, and gets a temporary one; a cluster may not."""
    context = spark.sparkContext
    there = context.getCheckpointDir()
    if there is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(root)
        there = context.getCheckpointDir()
    return there


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in reliable storage, without its history."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; survives the loss of any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing will read again; what it doesn't know is left alone."""
    for df in tables:
        path = _PLACES.pop(df, None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
