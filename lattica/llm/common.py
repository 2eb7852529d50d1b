"""Shared parts of the training-data operators: tables in the shared folder, Arrow batches, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but space, tab, newline, vertical tab, form feed, return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ASCII_LOWER_BYTES = bytes(_ASCII_LOWER.get(c, c) for c in range(256))


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def lower_ascii_bytes(data: bytes) -> bytes:
    """lower_ascii on UTF-8, where the bytes of A-Z stand for nothing else."""
    return data.translate(_ASCII_LOWER_BYTES)


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text) if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one for this session, which only a local master may do."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or None
    if path is None:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, which cuts its lineage: later stages that lose an executor read the files again instead of computing df anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def per_task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over batches of at most that many rows. Workers live on after a task, so its memory is given back at the end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(part.slice(k, rows) for part in parts for k in range(0, part.num_rows, rows)) if rows else f(parts)
        finally:
            give_back()

    return run


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive slices of values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and the list lengths."""
    lengths = np.diff(np.asarray(column.offsets))
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def crc_rest(doc_id: str | Column, by: int) -> Column:
    """crc32(doc_id as text) mod by."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % by


def bounded_sample(df: DataFrame, key: str, group: str, per_group: int) -> DataFrame:
    """About per_group rows of each group by the hash of key: one light pass counts the groups, one filter takes the rows.

    The number of rows taken follows a binomial distribution around per_group; it doesn't grow with df.
    """
    counts = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect() if r[group] is not None}
    if not counts:
        return df.limit(0)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        keep = keep | ((F.col(group) == F.lit(value)) & (draw < min(1.0, per_group / n)))
    return df.where(keep)
