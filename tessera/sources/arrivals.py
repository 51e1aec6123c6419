"""A streaming source of Parquet files that arrive in the order of their names, whatever the times they were written at.

Spark's own file source orders files by modification time. Here an arrival is an entry of the folder: a file, or a folder with all the
files below it. Each batch is one arrival, the next in order of names; a later run goes on after the last name of the one before. Entries
whose names begin with ``_`` or ``.`` aren't data. A task reads one row group. An entry that comes to a name before the last one taken
is not looked at again, as with any log of names.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "named_arrivals"


def store_of(address: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(address)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(address)


class RowGroup(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__((path, number))
        self.path, self.number = path, number


class ArrivalReader(DataSourceStreamReader):
    """Offsets are names. The last name that a batch was planned to is kept at ``progress``, so that a new run knows where to go on."""

    def __init__(self, schema: StructType, path: str, progress: str):
        self.columns, self.path, self.progress = schema.fieldNames(), path, progress
        self.last = self._kept()

    def _kept(self) -> str:
        store, at = store_of(self.progress)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return ""
        with store.open_input_stream(at) as f:
            return json.loads(f.read())["name"]

    def _keep(self, name: str) -> None:
        store, at = store_of(self.progress)
        store.create_dir(posixpath.dirname(at), recursive=True)
        passing = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(passing) as f:
            f.write(json.dumps({"name": name}).encode())
        store.move(passing, at)

    def _names(self) -> list[str]:
        store, at = store_of(self.path)
        entries = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(e.base_name for e in entries if not e.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"name": next((n for n in self._names() if n > self.last), self.last)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["name"] > self.last:
            self.last = end["name"]
            self._keep(self.last)
        store, at = store_of(self.path)
        out: list[InputPartition] = []
        for name in (n for n in self._names() if start["name"] < n <= end["name"]):
            entry = store.get_file_info(f"{at}/{name}")
            files = [entry] if entry.type == fs.FileType.File else store.get_file_info(fs.FileSelector(entry.path, recursive=True))
            for path in sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
                with store.open_input_file(path) as f:
                    out += [RowGroup(path, i) for i in range(pq.ParquetFile(f).num_row_groups)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        with store.open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches(row_groups=[partition.number], columns=self.columns)


class Arrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> ArrivalReader:  # noqa: N802
        return ArrivalReader(schema, self.options["path"], self.options["progress"])


def arrivals(spark: SparkSession, path: str, schema: StructType, location: str) -> DataFrame:
    """The arrivals in ``path`` as a stream; ``location`` is where its query keeps its state."""
    spark.dataSource.register(Arrivals)
    return spark.readStream.format(FORMAT).schema(schema).option("progress", f"{location}/arrived/last.json").load(path)
