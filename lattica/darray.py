"""Distributed arrays: a DataFrame with one row an element, index columns i0, i1, ... and the value v.

The shape is metadata, so empty arrays keep theirs, and order is data: nothing depends on the order of rows. Numbers
are doubles; characters are code points with kind 'c'.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import RankError, ShapeError
from lattica.plans.index import dense_index

FILLS = {"n": 0.0, "c": 32}


@dataclass(frozen=True)
class DArray:
    df: DataFrame
    shape: tuple[int, ...]
    kind: str = "n"
    fill: float | int | None = 0.0

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    def with_df(self, df: DataFrame, shape: tuple[int, ...] | None = None, kind: str | None = None) -> DArray:
        """The same array over other rows; columns beside the axes and v are dropped."""
        shape = self.shape if shape is None else shape
        kind = kind or self.kind
        return replace(self, df=df.select(*(F.col(f"i{k}").cast("long").alias(f"i{k}") for k in range(len(shape))), "v"), shape=shape, kind=kind, fill=self.fill if kind == self.kind else FILLS[kind])

    def map(self, f: Any, kind: str | None = None) -> DArray:
        """f (Column -> Column) of every element."""
        return self.with_df(self.df.withColumn("v", f(F.col("v"))), kind=kind)

    def flat(self) -> Column:
        """The place of an element in row-major order."""
        at: Column = F.lit(0).cast("long")
        for k, n in enumerate(self.shape):
            at = at * F.lit(n) + F.col(f"i{k}")
        return at

    def numbered(self, df: DataFrame, flat: str | Column) -> DataFrame:
        """df with axes of this shape made from a row-major place."""
        at, out = F.col(flat) if isinstance(flat, str) else flat, {}
        for k in range(self.rank):
            below = prod(self.shape[k + 1 :])
            place = F.floor(at / F.lit(below)) if below > 1 else at
            out[f"i{k}"] = (place if k == 0 else F.pmod(place, F.lit(self.shape[k]))).cast("long")
        return df.withColumns(out)

    def collect(self) -> Any:
        """The array as nested lists on the driver, for small results."""
        values = {tuple(r[a] for a in self.axes): (chr(r["v"]) if self.kind == "c" else r["v"]) for r in self.df.collect()}

        def build(at: tuple[int, ...]) -> Any:
            return values[at] if len(at) == self.rank else [build((*at, k)) for k in range(self.shape[len(at)])]

        return build(())


class Engine:
    """Makes arrays from tables, literals and ranges."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def array(self, df: DataFrame, order: list[str], value: str | Column, kind: str = "n") -> DArray:
        """A list of values in the order of columns that together are unique, numbered by one sort and prefix sums."""
        v = F.col(value) if isinstance(value, str) else value
        numbered, n = dense_index(df.withColumn("__v", v), order, "i0")
        return DArray(numbered.select("i0", F.col("__v").cast("double" if kind == "n" else "int").alias("v")), (n,), kind, FILLS[kind])

    def dense(self, df: DataFrame, place: str | Column, value: str | Column, n: int | None = None, kind: str = "n") -> DArray:
        """A list whose places 0..n-1 are in a column already."""
        p, v = (F.col(x) if isinstance(x, str) else x for x in (place, value))
        made = df.select(p.cast("long").alias("i0"), v.cast("double" if kind == "n" else "int").alias("v"))
        return DArray(made, (df.count() if n is None else n,), kind, FILLS[kind])

    def matrix(self, df: DataFrame, row: str, cells: str, width: int, n: int | None = None) -> DArray:
        """A rank-2 array from rows numbered 0..n-1 with an array column of that width."""
        made = df.select(F.col(row).cast("long").alias("i0"), F.posexplode(cells).alias("i1", "v")).select("i0", F.col("i1").cast("long"), F.col("v").cast("double"))
        return DArray(made, (df.count() if n is None else n, width))

    def iota(self, *shape: int) -> DArray:
        """0, 1, 2, ... in row-major order; never stored."""
        if any(n < 0 for n in shape):
            raise ShapeError("a range takes natural numbers")
        out = DArray(self.spark.range(0), shape)
        return out.with_df(out.numbered(self.spark.range(prod(shape)).withColumn("v", F.col("id").cast("double")), "id"))

    def literal(self, values: Any, shape: tuple[int, ...] | None = None) -> DArray:
        """An array from nested lists or a string."""
        found, at, rows = [], values, []
        while isinstance(at, (list, tuple, str)) and not (isinstance(at, str) and len(at) == 1 and found):
            found.append(len(at))
            if not len(at):
                break
            at = at[0]
        shape = tuple(found) if shape is None else shape

        def walk(x: Any, place: tuple[int, ...]) -> None:
            if len(place) == len(shape):
                rows.append((*place, x))
            else:
                if len(x) != shape[len(place)]:
                    raise ShapeError("cells have different shapes")
                for k, y in enumerate(x):
                    walk(y, (*place, k))

        walk(values, ())
        kind = "c" if rows and all(isinstance(r[-1], str) for r in rows) or isinstance(values, str) else "n"
        rows = [(*r[:-1], ord(r[-1]) if kind == "c" else float(r[-1])) for r in rows]
        columns = ", ".join([*(f"i{k} long" for k in range(len(shape))), f"v {'int' if kind == 'c' else 'double'}"])
        return DArray(self.spark.createDataFrame(rows, columns), shape, kind, FILLS[kind])


def want_rank(x: DArray, least: int, what: str) -> None:
    if x.rank < least:
        raise RankError(f"{what} takes an array of rank {least} or more")
