"""Sorted arrays in the shared folder: workers map them into memory, or fetch them file by file where the folder is no mounted path.

Keys are dealt to files by their leading bits, so the file of a key follows from the key, and nothing is listed or loaded beforehand. Every
file of a kind is there, an empty one for leading bits without keys: a file that is missing was lost, and raises.
"""

from __future__ import annotations

import io
import math
import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tidy
from tessera.plans.lineage import fresh_path, written

#: Fetched files, and mapped ones, that a worker holds at once; keys in one file, about; keys that may be broadcast.
HELD, MAPS, FILE_KEYS, BROADCAST_KEYS = 8, 4096, 1 << 20, 1_000_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """The address of a new folder that driver and executors see: a local path if it is a mounted one, else as Spark names it."""
    path = fresh_path(spark, label)
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        os.makedirs(path, exist_ok=True)
    return path


def save_bytes(folder: str, name: str, data: bytes) -> None:
    """Writes under a passing name, then renames: a task that runs again leaves the same file."""
    passing = f".{name}.{os.getpid()}.{os.urandom(6).hex()}"
    if "://" not in folder:
        with open(f"{folder}/{passing}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{passing}", f"{folder}/{name}")
        return
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{passing}") as f:
        f.write(data)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{root}/{name}")  # of an earlier attempt, with the same content
    store.move(f"{root}/{passing}", f"{root}/{name}")


def load_bytes(folder: str, name: str) -> bytes | None:
    """The content; None if there is no such file."""
    if "://" not in folder:
        if not os.path.exists(f"{folder}/{name}"):
            return None
        with open(f"{folder}/{name}", "rb") as f:
            return f.read()
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def remove(folder: str, names: list[str]) -> None:
    if "://" not in folder:
        for name in names:
            os.remove(f"{folder}/{name}")
        return
    store, root = fs.FileSystem.from_uri(folder)
    for name in names:
        store.delete_file(f"{root}/{name}")


def save(folder: str, name: str, array: np.ndarray) -> None:
    held = io.BytesIO()
    np.save(held, array)
    save_bytes(folder, f"{name}.npy", held.getbuffer())


def load(folder: str, name: str) -> np.ndarray:
    if "://" not in folder:
        path = f"{folder}/{name}.npy"
        return np.load(path, mmap_mode="r" if os.path.getsize(path) > 256 else None)  # what has hardly more than a header isn't mapped
    data = load_bytes(folder, f"{name}.npy")
    if data is None:
        raise FileNotFoundError(f"{folder}/{name}.npy")
    return np.load(io.BytesIO(data))


class Arrays:
    """Sorted 64-bit keys of one kind, in files by their leading ``bits``, with values; looked up by sorted keys, a file at a time."""

    def __init__(self, folder: str, bits: int, key: str, value: str | None = None):
        self.folder, self.shift, self.key, self.value = folder, np.uint64(64 - bits), key, value
        self.files: OrderedDict[str, np.ndarray] = OrderedDict()

    def _file(self, kind: str, number: int) -> np.ndarray:
        name = f"{kind}-{number:07d}"
        if name in self.files:
            self.files.move_to_end(name)
        else:
            self.files[name] = load(self.folder, name)
            if len(self.files) > (2 * HELD if "://" in self.folder else MAPS):
                self.files.popitem(last=False)
        return self.files[name]

    def _ranges(self, keys: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        if not len(keys):
            return
        numbers, first = np.unique(keys >> self.shift, return_index=True)
        for n, i, j in zip(numbers.tolist(), first, np.append(first[1:], len(keys)), strict=True):
            known = self._file(self.key, n)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[i:j]), len(known) - 1)
                yield n, i, j, at, known[at] == keys[i:j]

    def get(self, keys: np.ndarray, rows: int) -> np.ndarray:
        """Values of sorted keys, a column each; 0 where a key is missing."""
        out = np.zeros((rows, len(keys)), dtype=np.int64)
        for n, i, j, at, hit in self._ranges(keys):
            out[:, i:j] = np.where(hit, self._file(self.value, n)[..., at], 0)
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are there; in any order."""
        order = np.argsort(keys)
        out = np.zeros(len(keys), dtype=bool)
        for _, i, j, _, hit in self._ranges(keys[order]):
            out[order[i:j]] = hit
        return out


def bits_for(keys: int) -> int:
    """Leading bits that make files of about FILE_KEYS keys."""
    return max(1, math.ceil(math.log2(max(keys, 1) / FILE_KEYS)))


def save_keys(keys: DataFrame, label: str, count: int) -> tuple[str, int]:
    """Writes distinct 64-bit keys (one column ``key``) as sorted files; their folder and bits. A file is one task's."""
    folder, bits = shared_folder(keys.sparkSession, label), bits_for(count)
    shift = np.uint64(64 - bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [np.empty(0, np.uint64)], []
        for b in batches:
            held.append(b.column("key").drop_null().to_numpy().view(np.uint64))
            own += b.column("number").drop_null().to_pylist()
        found = np.sort(np.concatenate(held))
        for n in own:
            i, j = np.searchsorted(found >> shift, [n, n + 1])
            save(folder, f"key-{n:07d}", found[i:j])
        yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], ["n"])

    numbers = keys.sparkSession.range(1 << bits).select(F.lit(None).cast("bigint").alias("key"), F.col("id").alias("number"))
    both = keys.select("key", F.lit(None).cast("bigint").alias("number")).unionByName(numbers)
    dealt = both.repartition(1 << bits, F.coalesce("number", F.shiftrightunsigned("key", 64 - bits)))
    written(dealt.mapInArrow(tidy(keep), "n bigint"), f"{label}-sums")
    return folder, bits


@lru_cache(maxsize=8)
def keys_of(folder: str, bits: int) -> Arrays:
    return Arrays(folder, bits, "key")


def among(df: DataFrame, key: Column, keys: DataFrame, label: str, without: bool = False) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``key`` is one of ``keys`` (distinct, one column ``key``), or is none of them; wide rows don't move.

    Keys are broadcast up to BROADCAST_KEYS of 8 bytes; beyond, workers look them up in sorted files.
    """
    keys = written(keys, label)
    n = keys.count()
    if n <= BROADCAST_KEYS:
        known = keys.select(F.col("key").alias("__key"))
        return df.join(F.broadcast(known), key == known["__key"], "left_anti" if without else "left_semi")
    folder, bits = save_keys(keys, f"{label}-files", n)

    @F.pandas_udf("boolean")
    def known_key(values: pd.Series) -> pd.Series:
        return pd.Series(keys_of(folder, bits).has(values.to_numpy(np.int64).view(np.uint64)) != without)

    return df.where(known_key(key))
