"""Folds, inserts, groups and tallies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.darray import DArray, want_rank
from lattica.errors import DomainError, RankError
from lattica.functions.numeric import IDENTITY, NAN

#: Associative folds as aggregates; a not-a-number poisons extremes.
AGGREGATES = {
    "add": lambda v: F.sum(v),
    "multiply": lambda v: F.product(v),
    "minimum": lambda v: F.when(F.max(F.isnan(v)), NAN).otherwise(F.min(v)),
    "maximum": lambda v: F.when(F.max(F.isnan(v)), NAN).otherwise(F.max(v)),
    "both": lambda v: F.product(v),
    "either": lambda v: 1.0 - F.product(1.0 - v),
}


def right_aggregate(name: str, v: Column, place: Column) -> Column:
    """Folds from the right as aggregates of a dense place."""
    odd = F.pmod(place, F.lit(2)) == 1
    if name == "subtract":
        return F.sum(F.when(odd, -v).otherwise(v))
    if name == "divide":
        return F.product(F.when(odd, 1.0).otherwise(v)) / F.product(F.when(odd, v).otherwise(1.0))
    return AGGREGATES[name](v)


def fold(name: str, x: DArray, seed: float | None = None) -> float:
    """The value of a whole list, from the right; the identity if it is empty."""
    if x.rank != 1:
        raise RankError("a fold takes a list")
    df = x.df
    if seed is not None:  # the seed stands after the last element
        df = df.unionByName(df.sparkSession.createDataFrame([(x.shape[0], float(seed))], "i0 long, v double"))
    if name in AGGREGATES or name in ("subtract", "divide"):
        got = df.agg(right_aggregate(name, F.col("v"), F.col("i0")).alias("v")).first()["v"]
        return IDENTITY[name] if got is None else got
    raise DomainError(f"{name} has no distributed fold; use fold_cells for lists in rows")


def fold_frame(name: str, x: DArray) -> DataFrame:
    """fold as a DataFrame with one row."""
    return x.df.agg(F.coalesce(right_aggregate(name, F.col("v"), F.col("i0")), F.lit(IDENTITY[name])).alias("v"))


def folds_frame(made: dict[str, tuple[str, Column]], x: DArray) -> DataFrame:
    """Several folds of one list as a DataFrame with one row: name -> (fold, its column of x's rows)."""
    wide = x.df.select("i0", *(of.alias(name) for name, (_, of) in made.items()))
    return wide.agg(*(F.coalesce(right_aggregate(how, F.col(name), F.col("i0")), F.lit(IDENTITY[how])).alias(name) for name, (how, _) in made.items()))


def insert(name: str, x: DArray) -> DArray:
    """Reduces the leading axis; a result of an empty axis is the identity in every cell."""
    want_rank(x, 1, "an insert")
    rest = x.axes[1:]
    folded = x.df.groupBy(*rest).agg(right_aggregate(name, F.col("v"), F.col("i0")).alias("v"))
    out = DArray(folded, x.shape[1:])
    every = out.numbered(x.df.sparkSession.range(out.size), "id").select(*out.axes)
    moved = folded.select(*(F.col(a).alias(f"i{k}") for k, a in enumerate(rest)), "v")
    full = every.join(moved, out.axes, "left") if rest else moved
    return out.with_df(full.withColumn("v", F.coalesce("v", F.lit(IDENTITY[name]))))


def fold_rows(name: str, x: DArray) -> DArray:
    """Folds each row (the last axis), frames kept."""
    last = x.axes[-1]
    folded = x.df.groupBy(*x.axes[:-1]).agg(right_aggregate(name, F.col("v"), F.col(last)).alias("v"))
    return DArray(folded, x.shape[:-1]).with_df(folded)


def fold_cells(step: object, cells: Column, start: Column | None = None) -> Column:
    """A right fold by any two-argument Column function over an array column: the last element starts unless a seed does."""
    back = F.reverse(cells)
    if start is not None:
        return F.aggregate(back, start, lambda acc, v: step(v, acc))
    return F.aggregate(F.slice(back, 2, F.greatest(F.size(back) - 1, F.lit(0))), F.element_at(back, 1), lambda acc, v: step(v, acc))


def fold_associative(step: Callable[[Column, Column], Column], x: DArray, block: int = 4096) -> DataFrame:
    """The fold of a list of any length by a user's associative function of two Columns, as a DataFrame with one row.

    Places form blocks, each folded in its row by one task; block results are a shorter list, folded the same way. The
    order of the elements is kept, so the function need not commute. An empty list has no result: v is null.
    """
    df, n = x.df.select("i0", "v"), x.size
    while True:
        cells = F.transform(F.array_sort(F.collect_list(F.struct("i0", "v"))), lambda s: s["v"])
        df = df.groupBy(F.floor(F.col("i0") / block).alias("i0")).agg(cells.alias("cells"))
        df = df.select("i0", F.aggregate(F.slice("cells", 2, F.size("cells")), F.element_at("cells", 1), step).alias("v"))
        n = -(-n // block)
        if n <= 1:
            return df.agg(F.max("v").alias("v"))


def count_distinct(x: DArray) -> int:
    return x.df.select("v").distinct().count()


def group_places(x: DArray) -> DataFrame:
    """(g, places): for each number from 0 to the largest the places that hold it; -1 is left out, others below raise."""
    low, high = x.df.agg(F.min("v"), F.max("v")).first()
    if low is not None and low < -1:
        raise DomainError("group numbers start at -1")
    every = x.df.sparkSession.range(int(-1 if high is None else high) + 1).withColumnRenamed("id", "g")
    found = x.df.where("v >= 0").groupBy(F.col("v").cast("long").alias("g")).agg(F.array_sort(F.collect_list("i0")).alias("places"))
    return every.join(found, "g", "left").withColumn("places", F.coalesce("places", F.array().cast("array<long>")))


def group_cells(w: DArray, x: DArray) -> DataFrame:
    """(g, cells): x's values by w's group numbers, in order."""
    both = w.df.select("i0", F.col("v").cast("long").alias("g")).join(x.df, "i0").where("g >= 0")
    high = w.df.agg(F.max("v")).first()[0]
    every = x.df.sparkSession.range(int(-1 if high is None else high) + 1).withColumnRenamed("id", "g")
    found = both.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i0", "v"))), lambda s: s["v"]).alias("cells"))
    return every.join(found, "g", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<double>")))


def group_fold(df: DataFrame, keys: list[str], **folds: Column) -> DataFrame:
    """Fold of each group straight to an aggregate: partial sums before the shuffle, and no list is ever built."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in folds.items()))


def group_lengths(x: DArray, least: int = 0) -> DArray:
    """Sizes of the groups 0..largest, and of as many as asked for at least."""
    high = x.df.agg(F.max("v")).first()[0]
    n = max(int(-1 if high is None else high) + 1, least)
    seen = x.df.where("v >= 0").groupBy(F.col("v").cast("long").alias("i0")).count()
    every = x.df.sparkSession.range(n).withColumnRenamed("id", "i0")
    return DArray(every.join(seen, "i0", "left").select("i0", F.coalesce("count", F.lit(0)).cast("double").alias("v")), (n,))


def softmax(df: DataFrame, keys: list[str], value: str, out: str = "v") -> DataFrame:
    """exp(v - max) over its sum, for each group of keys, by two aggregates joined back."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__m"))
    raised = df.join(top, keys).withColumn("__e", F.exp(F.col(value) - F.col("__m")))
    total = raised.groupBy(*keys).agg(F.sum("__e").alias("__t"))
    return raised.join(total, keys).withColumn(out, F.col("__e") / F.col("__t")).drop("__m", "__e", "__t")


def _with(value: Column, f: object) -> Column:
    """f of a value that is computed once, though f uses it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax_cells(cells: Column) -> Column:
    """Softmax of an array column, in the row."""
    raised = _with(F.array_max(cells), lambda top: F.transform(cells, lambda v: F.exp(v - top)))
    return _with(raised, lambda e: _with(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))
