"""Dense positions and running totals without putting all rows into one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir where it is set, else a folder of this session, which only a local master may do."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc.getConf().get("spark.checkpoint.dir") or None
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="lattica-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)


def dense_index(df: DataFrame, order: list[str | Column], name: str) -> tuple[DataFrame, int]:
    """df with its places 0..n-1 in that order as a long column, and n.

    Rows are sorted by range; the number of rows of each partition, one number a partition, gives the offsets. The
    sorted rows are checkpointed first, as a range partitioning that is computed again may cut elsewhere.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    before, bases = 0, []
    for r in placed.groupBy(F.shiftright("__place", 33).alias("part")).count().orderBy("part").collect():
        bases.append((r["part"], before))
        before += r["count"]
    base = spark.createDataFrame(bases, "__part long, __base long")
    out = placed.join(F.broadcast(base), F.shiftright("__place", 33) == F.col("__part"))  # a row a partition
    return out.withColumn(name, F.col("__base") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", "__part", "__base"), before


#: Elements of a block; a block is the unit of the first pass of a running total.
BLOCK = 1 << 16
KEYED_BLOCK = 1 << 20


def running(df: DataFrame, place: str, value: str, how: str, block: int | None = None, keys: list[str] | None = None, n: int | None = None) -> DataFrame:
    """df with `value` replaced by its running sum, product, min or max in the order of a dense place, for each key.

    Blocks of places run side by side, also those of one key; only block totals, one row a key and block, pass through
    one ordered window a key. Where the n places are known to be one block, no totals are needed.
    """
    keys = keys or []
    block = block or (KEYED_BLOCK if keys else BLOCK)
    one = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[how]
    within = Window.partitionBy(*keys, "__run_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    if keys and n is not None and n <= block:
        return df.withColumn(value, one(value).over(Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("__run_block", F.floor(F.col(place) / block))
    inner = cut.withColumn("__run_within", one(value).over(within))
    earlier = Window.partitionBy(*keys).orderBy("__run_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__run_block").agg(one(value).alias("__run_total")).withColumn("__run_total", one("__run_total").over(earlier))
    if keys:  # most keys lie in one block and have nothing to add; nulls are a key as any other
        totals = totals.where(F.col("__run_total").isNotNull()).select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__run_block").alias("__key_block"), "__run_total")
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys), F.col("__run_block") == F.col("__key_block"))
        both = inner.join(totals, same, "left").drop(*(c for c in totals.columns if c.startswith("__key_")))
    else:
        both = inner.join(totals, "__run_block")
    w, t = F.col("__run_within"), F.col("__run_total")
    joined = {"sum": w + t, "product": w * t, "min": F.least(w, t), "max": F.greatest(w, t)}[how]
    return both.withColumn(value, F.when(t.isNull(), w).otherwise(joined)).drop("__run_block", "__run_within", "__run_total")


def nth(df: DataFrame, keys: list[str], place: str, name: str, n: int | None = None) -> DataFrame:
    """df with the number of earlier rows of equal keys: a key of many rows is counted in blocks."""
    return running(df.withColumn(name, F.lit(1).cast("long")), place, name, "sum", keys=keys, n=n).withColumn(name, F.col(name) - 1)
