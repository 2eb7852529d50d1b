"""Text, character and byte files, directory listings and path algebra; parquet tables; random lists."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.plans.index import dense_index, ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(i0, line): the lines of a text file in order. Lines are numbered by splits of the file, which Spark reads in order."""
    ensure_checkpoint_dir(spark)
    read = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("__f"), F.expr("input_file_block_start()").alias("__s"), F.monotonically_increasing_id().alias("__m")).checkpoint()
    made, _ = dense_index(read, ["__f", "__s", "__m"], "i0")
    return made.select("i0", "line")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def chars(spark: SparkSession, path: str) -> str:
    """The text of one file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def write_chars(path: str, text: str) -> str:
    Path(path).write_text(text, encoding="utf-8")
    return text


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modificationTime) of files."""
    return spark.read.format("binaryFile").load(path)


map_bytes = read_bytes  # content is read when a plan uses it


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, modified) of the files in a folder, however many; contents aren't read."""
    found = read_bytes(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def write_bytes(path: str, values: list[int]) -> list[int]:
    Path(path).write_bytes(bytes(values))
    return values


def listing(path: str) -> list[str]:
    return sorted(os.listdir(path))


def kind(path: str) -> str:
    """'f', 'd' or 'l'; an absent path raises."""
    p = Path(path)
    if p.is_symlink():
        return "l"
    if p.is_dir():
        return "d"
    if p.is_file():
        return "f"
    raise FileNotFoundError(path)


def at(base: str, path: str) -> str:
    return os.path.normpath(os.path.join(base, path))


def stat(path: str) -> dict[str, float]:
    s = os.stat(path)
    return {"size": s.st_size, "created": s.st_ctime, "modified": s.st_mtime, "accessed": s.st_atime}


name, parent, exists, real_path = os.path.basename, os.path.dirname, os.path.exists, os.path.realpath
create_dir, remove, rename = os.mkdir, os.remove, os.rename


def random_range(spark: SparkSession, n: int, below: int, seed: int) -> DArray:
    """n whole numbers under a bound, from a hash of place and seed: the same for any partitioning. Below 0 all are 0."""
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below)) if below else F.lit(0)
    return DArray(spark.range(n).select(F.col("id").alias("i0"), draw.cast("double").alias("v")), (n,))


def deal(spark: SparkSession, n: int, seed: int) -> DArray:
    """A permutation of 0..n-1."""
    made, _ = dense_index(spark.range(n).withColumn("__h", F.xxhash64("id", F.lit(seed))), ["__h", "id"], "i0")
    return DArray(made.select("i0", F.col("id").cast("double").alias("v")), (n,))


class Rand:
    """Random lists from one seed: the same draws in the same order give the same lists, in any process."""

    def __init__(self, spark: SparkSession, seed: int) -> None:
        self.spark, self.seed, self.draws = spark, seed, 0

    def _next(self) -> int:
        self.draws += 1
        return self.seed * 1_000_003 + self.draws

    def range(self, n: int, below: int) -> DArray:
        return random_range(self.spark, n, below, self._next())

    def deal(self, n: int) -> DArray:
        return deal(self.spark, n, self._next())

    def subset(self, k: int, n: int) -> DArray:
        return subset(self.spark, k, n, self._next())


def subset(spark: SparkSession, k: int, n: int, seed: int) -> DArray:
    """k different numbers of 0..n-1, by a top-k of their hashes."""
    rows = spark.range(n).withColumn("__h", F.xxhash64("id", F.lit(seed))).orderBy("__h", "id").limit(k)
    made, _ = dense_index(rows, ["__h", "id"], "i0")
    return DArray(made.select("i0", F.col("id").cast("double").alias("v")), (k,))
