"""Set and bag operations over lists; order and repeats of the left side are kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.operators.search import key, progressive_index_of
from lattica.operators.structural import concat
from lattica.plans.index import dense_index


def _again(df, x: DArray) -> DArray:
    made, n = dense_index(df.select("i0", "v"), ["i0"], "__p")
    return DArray(made.select(F.col("__p").alias("i0"), "v"), (n,), x.kind, x.fill)


def _keyed(a: DArray, side: str):
    return a.df.withColumn("__k", key(F.col("v"), side, F.col("i0"), a.kind == "n"))


def unique(x: DArray) -> DArray:
    """Distinct values in the order of first occurrence."""
    return _again(_keyed(x, "x").groupBy("__k").agg(F.min_by("v", "i0").alias("v"), F.min("i0").alias("i0")), x)


def union_all(w: DArray, x: DArray) -> DArray:
    return concat(w, x)


def union(w: DArray, x: DArray) -> DArray:
    return unique(concat(w, x))


def intersect(w: DArray, x: DArray) -> DArray:
    """w's elements that occur in x."""
    return _again(_keyed(w, "w").join(_keyed(x, "x").select("__k"), "__k", "left_semi"), w)


def without(w: DArray, x: DArray) -> DArray:
    """w's elements that don't occur in x."""
    return _again(_keyed(w, "w").join(_keyed(x, "x").select("__k"), "__k", "left_anti"), w)


def bag_intersect(w: DArray, x: DArray) -> DArray:
    """w's elements matched one to one with x's."""
    found = progressive_index_of(x, w).df.where(F.col("v") < x.shape[0]).select("i0")
    return _again(w.df.join(found, "i0", "left_semi"), w)


def bag_without(w: DArray, x: DArray) -> DArray:
    """w's elements left when each of x takes one equal element away."""
    found = progressive_index_of(x, w).df.where(F.col("v") == x.shape[0]).select("i0")
    return _again(w.df.join(found, "i0", "left_semi"), w)
