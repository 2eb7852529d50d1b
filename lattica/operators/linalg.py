"""Matrix products, by join and sum or by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.errors import ShapeError

#: Side of a block; blocks of a result that a task holds at once.
BLOCK, HELD = 512, 32


def matmul(w: DArray, x: DArray, kind: str = "double") -> DArray:
    """Rows of w by columns of x. Blocks of BLOCK x BLOCK meet on the inner axis and are multiplied in one call each.

    Work per task is bounded by the block; partial products are added before they meet, and empty inner axes give zeros.
    """
    if w.rank != 2 or x.rank != 2 or w.shape[1] != x.shape[0]:
        raise ShapeError("inner axes differ")
    spark, shape = w.df.sparkSession, (w.shape[0], x.shape[1])
    if not w.shape[1]:
        out = DArray(w.df, shape)
        return out.with_df(out.numbered(spark.range(out.size), "id").withColumn("v", F.lit(0.0)))
    left, right = blocks(w, kind), blocks(x, kind)
    pairs = left.select(F.col("b0").alias("r"), F.col("b1").alias("k"), F.col("cells").alias("a")).join(right.select(F.col("b0").alias("k"), F.col("b1").alias("c"), F.col("cells").alias("b")), "k")
    width, dtype = BLOCK, np.float32 if kind == "float" else np.float64

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of blocks, those that meet in a task added up."""
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (r, c), m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([c]), pa.array([m.tobytes()], type=pa.binary())], names=["r", "c", "cells"])
            held.clear()

        for part in parts:
            for r, c, a, b in zip(*(part.column(n).to_pylist() for n in ("r", "c", "a", "b")), strict=True):
                m = np.frombuffer(a, dtype=dtype).reshape(width, width) @ np.frombuffer(b, dtype=dtype).reshape(width, width)
                held[r, c] = held[r, c] + m if (r, c) in held else m
                if len(held) > HELD:
                    yield from out()
        yield from out()

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that come side by side, added up and spelled out in elements."""
        at, total = None, np.zeros((width, width))
        i, j = np.divmod(np.arange(width * width), width)

        def out(r: int, c: int) -> pa.RecordBatch:
            keep = (r * width + i < shape[0]) & (c * width + j < shape[1])
            return pa.RecordBatch.from_arrays([pa.array(r * width + i[keep]), pa.array(c * width + j[keep]), pa.array(total.ravel()[keep].astype(np.float64))], names=["i0", "i1", "v"])

        for part in parts:
            for r, c, cells in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if at not in (None, (r, c)):
                    yield out(*at)
                    total = np.zeros((width, width))
                at, total = (r, c), total + np.frombuffer(cells, dtype=dtype).reshape(width, width)
        if at is not None:
            yield out(*at)

    summed = pairs.mapInArrow(multiply, "r long, c long, cells binary").repartition("r", "c").sortWithinPartitions("r", "c")
    made = summed.mapInArrow(spell, "i0 long, i1 long, v double")
    return DArray(made, shape).with_df(made, shape)


def blocks(x: DArray, kind: str = "double") -> DataFrame:
    """(b0, b1, cells): square blocks as bytes, zeros where there is no element."""
    width = BLOCK
    dtype = np.float32 if kind == "float" else np.float64

    def pack(group: pa.Table) -> pa.Table:
        out = np.zeros((width, width), dtype=dtype)
        out[group["p0"].to_numpy(), group["p1"].to_numpy()] = group["v"].to_numpy()
        return pa.table({"b0": group["b0"].slice(0, 1), "b1": group["b1"].slice(0, 1), "cells": pa.array([out.tobytes()], type=pa.binary())})

    placed = x.df.select(F.floor(F.col("i0") / width).cast("long").alias("b0"), F.floor(F.col("i1") / width).cast("long").alias("b1"), F.pmod("i0", F.lit(width)).cast("int").alias("p0"), F.pmod("i1", F.lit(width)).cast("int").alias("p1"), "v")
    return placed.groupBy("b0", "b1").applyInArrow(pack, "b0 long, b1 long, cells binary")


def matmul_sparse(w: DArray, x: DArray) -> DArray:
    """The same by one join on the inner axis, which suits few elements: zeros need no rows."""
    if w.rank != 2 or x.rank != 2 or w.shape[1] != x.shape[0]:
        raise ShapeError("inner axes differ")
    both = w.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("a")).join(x.df.select(F.col("i0").alias("k"), "i1", F.col("v").alias("b")), "k")
    made = both.groupBy("i0", "i1").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return DArray(made, (w.shape[0], x.shape[1])).with_df(made, (w.shape[0], x.shape[1]))
