"""Sorting, grading, ranks and limits. Grades are stable in both directions: equal keys keep their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.plans.index import dense_index


def _by(down: bool, *names: str) -> list[Column]:
    return [F.col(n).desc() if down else F.col(n).asc() for n in names]


def _rows(x: DArray) -> tuple[DataFrame, list[str]]:
    """One row a major cell, with a column for each element of it."""
    if x.rank == 1:
        return x.df.select("i0", F.col("v").alias("c0")), ["c0"]
    n = reduce(lambda a, b: a * b, x.shape[1:], 1)
    at = reduce(lambda s, j: s * F.lit(x.shape[j]) + F.col(f"i{j}"), range(1, x.rank), F.lit(0).cast("long"))
    wide = x.df.groupBy("i0").agg(*(F.max(F.when(at == k, F.col("v"))).alias(f"c{k}") for k in range(n)))
    return wide, [f"c{k}" for k in range(n)]


def grade(x: DArray, down: bool = False) -> DArray:
    """The places of the cells in sorted order."""
    rows, names = _rows(x)
    made, _ = dense_index(rows, [*_by(down, *names), F.col("i0").asc()], "__p")
    return DArray(made.select(F.col("__p").alias("i0"), F.col("i0").cast("double").alias("v")), (x.shape[0],))


def sort(x: DArray, down: bool = False) -> DArray:
    """The cells in order; rows of a matrix by their elements from the first on."""
    rows, names = _rows(x)
    made, _ = dense_index(rows, [*_by(down, *names), F.col("i0").asc()], "__p")
    if x.rank == 1:
        return x.with_df(made.select(F.col("__p").alias("i0"), F.col("c0").alias("v")))
    cells = made.select(F.col("__p").alias("i0"), F.posexplode(F.array(*names)).alias("__c", "v"))
    return x.with_df(_split(cells, x))


def _split(cells: DataFrame, x: DArray) -> DataFrame:
    at, out = F.col("__c").cast("long"), {}
    size = 1
    for k in range(x.rank - 1, 0, -1):
        out[f"i{k}"] = F.pmod(F.floor(at / size), F.lit(x.shape[k])).cast("long")
        size *= x.shape[k]
    return cells.withColumns(out)


def ranks(x: DArray) -> DArray:
    """The place of each element in sorted order."""
    g = grade(x)
    return DArray(g.df.select(F.col("v").cast("long").alias("i0"), F.col("i0").cast("double").alias("v")), x.shape)


def top(x: DArray, k: int, down: bool = True) -> DArray:
    """The first k of the sorted cells, by a partial top-k of every partition and never a full sort."""
    kept = x.df.orderBy(F.col("v").desc() if down else F.col("v").asc(), F.col("i0").asc()).limit(k)
    made, n = dense_index(kept, [F.col("v").desc() if down else F.col("v").asc(), F.col("i0").asc()], "__p")
    return DArray(made.select(F.col("__p").alias("i0"), "v"), (n,), x.kind, x.fill)


def atom(v: Column, char: Column | bool = False) -> Column:
    """An element of a mixed array: numbers stand before characters, which are given by their code points."""
    return F.struct((F.lit(char) if isinstance(char, bool) else char).cast("int").alias("kind"), v.cast("double").alias("v"))


def _nested(df: DataFrame, down: bool) -> tuple[DataFrame, int]:
    shape = [F.size("shape"), F.col("shape")] if "shape" in df.columns else []
    keys = [F.col("cell"), *shape]
    return dense_index(df, [*((k.desc() if down else k.asc()) for k in keys), F.col("i0").asc()], "__p")


def grade_nested(df: DataFrame, down: bool = False) -> DArray:
    """The places of nested arrays in sorted order.

    df: (i0, cell) and, where they aren't all lists, shape. A cell is the array's elements in row-major order: numbers,
    atoms of mixed arrays, or arrays of these. Arrays are compared element by element; where one ends first it is the
    smaller; equal elements leave it to the rank, then to the shape.
    """
    made, n = _nested(df, down)
    return DArray(made.select(F.col("__p").alias("i0"), F.col("i0").cast("double").alias("v")), (n,))


def sort_nested(df: DataFrame, down: bool = False) -> DataFrame:
    """Nested arrays in order, as in grade_nested: (i0, cell) and shape where it was given."""
    made, _ = _nested(df, down)
    return made.select(F.col("__p").alias("i0"), *(c for c in ("shape", "cell") if c in df.columns))


def sort_cells(cells: Column, down: bool = False) -> Column:
    """Sorts an array column in the row."""
    return F.sort_array(cells, asc=not down)


def grade_cells(cells: Column, down: bool = False) -> Column:
    """Stable grade of an array column in the row."""
    tagged = F.transform(cells, lambda v, k: F.struct((-v if down else v).alias("v"), k.alias("k")))
    return F.transform(F.array_sort(tagged), lambda s: s["k"])
