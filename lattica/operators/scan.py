"""Running values, sliding windows and occurrence numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.darray import DArray, want_rank
from lattica.errors import DomainError, ShapeError
from lattica.operators.search import key
from lattica.plans.index import dense_index, nth, running

HOW = {"add": "sum", "multiply": "product", "minimum": "min", "maximum": "max"}


def scan(name: str, x: DArray, seed: float | None = None) -> DArray:
    """Inclusive running fold along the leading axis, left to right, in blocks of places; columns of a matrix side by side."""
    want_rank(x, 1, "a scan")
    if name not in HOW:
        raise DomainError(f"{name} has no distributed scan; use scan_cells or scan_groups")
    df = running(x.df, "i0", "v", HOW[name], keys=x.axes[1:], n=x.shape[0])
    if seed is not None:
        v, s = F.col("v"), F.lit(float(seed))
        df = df.withColumn("v", {"add": v + s, "multiply": v * s, "minimum": F.least(v, s), "maximum": F.greatest(v, s)}[name])
    return x.with_df(df)


def unscan(x: DArray) -> DArray:
    """Undoes a running sum: differences of neighbours, the first kept. A join with the places moved by one needs no global window."""
    before = x.df.select((F.col("i0") + 1).alias("i0"), *x.axes[1:], F.col("v").alias("__b"))
    return x.with_df(x.df.join(before, x.axes, "left").withColumn("v", F.col("v") - F.coalesce("__b", F.lit(0.0))))


def scan_cells(step: object, cells: Column) -> Column:
    """A running fold by any Column function over an array column, in the row."""
    start = F.struct(F.slice(cells, 1, 1).alias("out"), F.element_at(cells, 1).alias("acc"))

    def put(s: Column, v: Column) -> Column:
        made = step(s["acc"], v)
        return F.struct(F.concat(s["out"], F.array(made)).alias("out"), made.alias("acc"))

    return F.when(F.size(cells) > 0, F.aggregate(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), start, put, lambda s: s["out"])).otherwise(cells)


def scan_groups(df: DataFrame, keys: list[str], order: str, value: str, step: object, out: str = "v") -> DataFrame:
    """A running fold by any Python function of two numbers in each group, for folds that no window has.

    Rows stream through the task in order, so a group is never held whole.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc = None, 0.0
        for part in parts:
            made = []
            for k, v in zip(part[keys].itertuples(index=False, name=None), part[value].tolist(), strict=True):
                acc = v if k != last else step(acc, v)
                last = k
                made.append(acc)
            yield part.assign(**{out: made})

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def window_fold(name: str, x: DArray, length: int) -> DArray:
    """Fold of every full window of a list. Blocks overlap by the window, so no task holds the whole list."""
    if x.rank != 1 or not 0 < length <= x.shape[0] + 1:
        raise ShapeError("windows are longer than the list")
    block = max(1 << 16, 4 * length)
    one = {"add": F.sum, "multiply": F.product, "minimum": F.min, "maximum": F.max}[name]
    own = F.floor(F.col("i0") / block)
    # the places before a block that its first windows need are copied to it
    copies = x.df.withColumn("__b", F.explode(F.array_distinct(F.array(own, F.floor((F.col("i0") + length - 1) / block)))))
    frame = Window.partitionBy("__b").orderBy("i0").rowsBetween(-(length - 1), 0)
    made = copies.withColumn("v", one("v").over(frame)).where((own == F.col("__b")) & (F.col("i0") >= length - 1))
    return x.with_df(made.withColumn("i0", F.col("i0") - (length - 1)), (x.shape[0] - length + 1,))


def occurrence(x: DArray) -> DArray:
    """How many earlier cells equal each one. A value of many places is counted in blocks."""
    keyed = x.df.select("i0", key(F.col("v"), "x", F.col("i0"), x.kind == "n").alias("k"))
    return DArray(nth(keyed, ["k"], "i0", "n", x.shape[0]).select("i0", F.col("n").cast("double").alias("v")), x.shape)


def _firsts(x: DArray) -> DataFrame:
    return x.df.groupBy(key(F.col("v"), "x", F.col("i0"), x.kind == "n").alias("k")).agg(F.min("i0").alias("f"))


def mark_firsts(x: DArray) -> DArray:
    """1 where a value occurs for the first time."""
    made = x.df.join(_firsts(x).select(F.col("f").alias("i0"), F.lit(1.0).alias("__m")), "i0", "left")
    return DArray(made.select("i0", F.coalesce("__m", F.lit(0.0)).alias("v")), x.shape)


def classify(x: DArray) -> DArray:
    """Numbers the distinct values in the order of first occurrence: only one row a value is put in order."""
    firsts = _firsts(x)
    numbered, _ = dense_index(firsts, ["f"], "c")
    made = x.df.withColumn("k", key(F.col("v"), "x", F.col("i0"), x.kind == "n")).join(numbered.select("k", "c"), "k")
    return DArray(made.select("i0", F.col("c").cast("double").alias("v")), x.shape)
