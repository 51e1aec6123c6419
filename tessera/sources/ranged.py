"""Lines fetched by their byte offsets: only the bytes that hits point at are read, wherever the file lies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits of one file within so many bytes are one task's, so a file that holds most hits is several tasks' work.
RANGE = 64 << 20
#: Bytes of one read where a line is wanted whole.
STEP = 4096


def open_ranged(address: str) -> BinaryIO:
    """A file to seek in: a path, or an address as Spark names it."""
    parts = urlparse(address)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb", buffering=0)  # noqa: SIM115
    store, path = fs.FileSystem.from_uri(address)
    return store.open_input_file(path)


def line_at(file: BinaryIO, offset: int, width: int | None) -> tuple[str, int]:
    """The line that begins at ``offset`` and how many bytes were read for it: up to its end, or enough for ``width`` characters and one more."""
    file.seek(offset)
    held, most = b"", None if width is None else 4 * (width + 1)  # a character has four bytes at most
    while most is None or len(held) < most:
        more = file.read(STEP if most is None else most - len(held))
        held += more
        if not more or b"\n" in more:
            break
    line = held.partition(b"\n")[0].decode("utf-8", "replace")
    return (line if width is None or len(line) <= width else line[:width] + "..."), len(held)


def fetch_lines(hits: DataFrame, width: int | None = 80) -> DataFrame:
    """(file, docno, line, n_read) for distinct (file, docno): the line at each offset, clipped to ``width`` characters, or whole without it.

    Hits are grouped by file and range of bytes, and read in order of their offsets. Bytes that aren't UTF-8 become replacement
    characters; an offset at or beyond the end gives an empty line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for b in batches:
                got = []
                for address, offset in zip(b.column("file").to_pylist(), b.column("docno").to_pylist(), strict=True):
                    if address != name:
                        if file is not None:
                            file.close()
                        name, file = address, open_ranged(address)
                    got.append(line_at(file, offset, width))
                yield pa.RecordBatch.from_arrays([b.column("file"), b.column("docno"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["file", "docno", "line", "n_read"])
        finally:
            if file is not None:
                file.close()

    near = F.floor(F.col("docno") / RANGE).alias("near")
    dealt = hits.select("file", F.col("docno").cast("bigint").alias("docno")).distinct().withColumn("near", near).repartition("file", "near")
    return dealt.sortWithinPartitions("file", "docno").select("file", "docno").mapInArrow(run, "file string, docno bigint, line string, n_read bigint")
