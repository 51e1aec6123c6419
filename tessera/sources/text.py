"""Line-oriented text: reading with or without byte offsets, key-value files, text and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, dealt to all cores if they are fewer and smaller than there are cores; else it is left where it lies."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return df.repartition(cores) if (files.agg(F.sum("file_size")).first()[0] or 0) < cores * split else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def seekable(df: DataFrame) -> DataFrame:
    """``df``, a scan of files; ValueError if one of them is compressed, in whatever folder or pattern, for its offsets can't be looked up."""
    packed = [f for f in df.inputFiles() if f.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate"))]
    if packed:
        raise ValueError(f"offsets of a compressed collection cannot be looked up: {packed[0]}")
    return df


def read_lines_with_offset(spark: SparkSession, path: str) -> DataFrame:
    """(file, docno, line), docno being the byte offset of the line in its file.

    The text source hides offsets, but hands a file's splits over in order, each whole: an offset is the sum of the bytes before
    it, in the same split (a window for each split) and in earlier splits (their totals, one row for each). Only plain files
    have offsets that a reader can seek to, so compressed ones are refused.
    """
    size = (F.octet_length("value") + 1).cast("bigint")
    scan = seekable(spark.read.option("lineSep", "\n").text(path))
    rows = scan.select(F.col("value").alias("line"), size.alias("size"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "split").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("begin"))
    before = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return inside.join(splits, ["file", "split"]).select("file", (F.col("begin") + F.col("inside")).alias("docno"), "line")


def write_collection(rows: DataFrame, path: str, files: list[str], order: list[str]) -> None:
    """Lines (column line) as one text file for each value of the columns ``files``, in ``order``; a task writes each file."""
    rows.repartition(*files).sortWithinPartitions(*files, *order).select(*files, "line").write.partitionBy(*files).option("lineSep", "\n").text(path)


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): one row for each line of each document; a null text has none."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_key_values(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(k, v) cut at the first separator only; a line without one has a null v."""
    return key_values(spark.read.text(path).select(F.col("value")), sep)


def key_values(values: DataFrame, sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep, 2)
    return values.select(F.get(parts, F.lit(0)).alias("k"), F.get(parts, F.lit(1)).cast("int").alias("v"))


def write_key_values(df: DataFrame, path: str, files: int | None = None, text: bool = True, tuples: bool = False) -> None:
    """Text lines with the columns between tabs (as ``(k,v)`` with ``tuples``), or a binary file (Parquet), replacing what was there; ``files`` fixes the number of part files."""
    df = df.repartition(files) if files else df
    if not text:
        df.write.mode("overwrite").parquet(path)
        return
    cells = [F.col(c).cast("string") for c in df.columns]
    line = F.concat(F.lit("("), F.concat_ws(",", *cells), F.lit(")")) if tuples else F.concat_ws("\t", *cells)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """Parquet in key order, so that a point lookup skips row groups by their statistics."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def put_table(df: DataFrame, name: str, key: str) -> None:
    """A managed table of keys and values in order of keys, dropped first if it exists."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").saveAsTable(name)


def get_key(spark: SparkSession, name: str, key: str, value: str) -> DataFrame:
    """Rows with this key; none if it is absent."""
    return spark.table(name).where(F.col(key) == value)


def random_pairs(ids: DataFrame, key_length: int = 1, value_range: int = 2**31 - 1, seed: int = 0) -> DataFrame:
    """(k, v) for each ``id``: k of ASCII letters, v in [0, value_range). A row depends on the seed and its id alone."""
    letters = F.lit(LETTERS)
    draw = lambda place: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{place}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint")
    pick = [F.substr(letters, (draw(place) % len(LETTERS) + 1).cast("int"), F.lit(1)) for place in range(1, key_length + 1)]
    return ids.select(F.concat(*pick).alias("k"), (draw(0) % value_range).cast("int").alias("v"))


def random_key_values(spark: SparkSession, rows: int, key_length: int = 1, value_range: int = 2**31 - 1, seed: int = 0, tasks: int = 10) -> DataFrame:
    """``rows`` rows of ``random_pairs``, numbered from 0."""
    return random_pairs(spark.range(0, rows, 1, tasks), key_length, value_range, seed)
