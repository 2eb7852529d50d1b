"""Element by element over arrays whose shapes agree: equal, or one a prefix of the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.errors import DomainError, ShapeError


def zip_with(f: Callable[[Column, Column], Column], w: DArray | float, x: DArray | float) -> DArray:
    """f of the elements in the same place; the array of lower rank is repeated along the other's further axes."""
    if not isinstance(w, DArray):
        return x.map(lambda v: f(F.lit(w), v))
    if not isinstance(x, DArray):
        return w.map(lambda v: f(v, F.lit(x)))
    low = min(w.rank, x.rank)
    if w.shape[:low] != x.shape[:low]:
        raise ShapeError(f"expected equal shape prefix, got {w.shape} and {x.shape}")
    big = w if w.rank > x.rank else x
    both = w.df.select(*w.axes, F.col("v").alias("__w")).join(x.df.select(*x.axes, F.col("v").alias("__x")), w.axes[:low]) if low else w.df.select(*w.axes, F.col("v").alias("__w")).join(F.broadcast(x.df.select(*x.axes, F.col("v").alias("__x")))) if x.rank == 0 else F.broadcast(w.df.select(F.col("v").alias("__w"))).join(x.df.select(*x.axes, F.col("v").alias("__x")))
    return DArray(both, big.shape).with_df(both.withColumn("v", f(F.col("__w"), F.col("__x"))))


def chars(w: DArray, x: DArray | int, minus: bool = False) -> DArray:
    """Characters moved by numbers, or the distance of two characters; a code point out of range raises."""
    def checked(v: Column) -> Column:
        return F.when((v >= 0) & (v <= 1114111), v).otherwise(F.raise_error(F.lit("code point out of range")).cast("int"))

    if w.kind == "c" and isinstance(x, DArray) and x.kind == "c":
        if not minus:
            raise DomainError("characters don't add")
        return DArray(zip_with(lambda a, b: (a - b).cast("double"), w, x).df, w.shape)
    if w.kind != "c":
        raise DomainError("no characters")
    moved = zip_with(lambda a, b: checked((a - b if minus else a + b).cast("int")), w, x)
    return DArray(moved.df, moved.shape, "c", 32)


def match(w: DArray, x: DArray) -> bool:
    """Whether shapes and all elements are the same; not-a-number matches nothing."""
    if w.shape != x.shape or w.kind != x.kind:
        return False
    if not w.rank:
        return bool(zip_with(lambda a, b: a == b, w, x).df.first()["v"])
    same = (F.col("__w") == F.col("__x")) & (~F.isnan("__w") if w.kind == "n" else F.lit(True))
    both = w.df.select(*w.axes, F.col("v").alias("__w")).join(x.df.select(*x.axes, F.col("v").alias("__x")), w.axes)
    return both.where(same).count() == w.size


def table(f: Callable[[Column, Column], Column], w: DArray, x: DArray) -> DArray:
    """f of every pair. The result has a row a pair by definition; the smaller list is the one repeated."""
    moved = x.df.select(*(F.col(a).alias(f"i{w.rank + k}") for k, a in enumerate(x.axes)), F.col("v").alias("__x"))
    both = w.df.withColumnRenamed("v", "__w").crossJoin(moved)
    return DArray(both, (*w.shape, *x.shape)).with_df(both.withColumn("v", f(F.col("__w"), F.col("__x"))))
