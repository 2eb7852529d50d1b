"""Filters, replication, selection and picking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.darray import DArray, want_rank
from lattica.errors import DomainError, RankError, ShapeError
from lattica.plans.index import running




def indices(x: DArray) -> DArray:
    """Each place as often as its count says. Offsets of the results are running sums of the counts."""
    return replicate(x, DArray(x.df.withColumn("v", F.col("i0").cast("double")), x.shape))


def replicate(w: DArray | int, x: DArray) -> DArray:
    """x's major cells as often as w says: 0 and 1 filter, other naturals repeat."""
    want_rank(x, 1, "replication")
    if isinstance(w, int):
        if w < 0:
            raise DomainError("counts are natural numbers")
        df = x.df.withColumn("__k", F.explode(F.array_repeat(F.lit(0), w))) if w else x.df.where("false")
        spread = df if not w else x.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
        return x.with_df(spread.withColumn("i0", F.col("i0") * w + (F.col("__k") if w else 0)), (x.shape[0] * w, *x.shape[1:]))
    if w.rank != 1 or w.shape[0] != x.shape[0]:
        raise ShapeError("one count for each cell")
    counts = w.df.select("i0", F.col("v").cast("long").alias("__n"))
    ends = running(counts.withColumn("__e", F.col("__n")), "i0", "__e", "sum")
    total = counts.agg(F.sum("__n"), F.min("__n")).first()
    if total[1] is not None and total[1] < 0:
        raise DomainError("counts are natural numbers")
    kept = ends.where("__n > 0").withColumn("__s", F.col("__e") - F.col("__n"))
    spread = x.df.join(kept, "i0").withColumn("i0", F.explode(F.sequence("__s", F.col("__e") - 1)))
    return x.with_df(spread, (int(total[0] or 0), *x.shape[1:]))


def counts_of(x: DArray, length: int | None = None) -> DArray:
    """How often each number from 0 to the largest (or below a length) occurs."""
    n = int((x.df.agg(F.max("v")).first()[0] if length is None else length - 1) or 0) + 1 if x.size or length else 0
    seen = x.df.groupBy(F.col("v").cast("long").alias("i0")).agg(F.count("*").cast("double").alias("c"))
    every = x.df.sparkSession.range(n).withColumnRenamed("id", "i0")
    return DArray(every.join(seen, "i0", "left").select("i0", F.coalesce("c", F.lit(0.0)).alias("v")), (n,))


def first_cell(x: DArray) -> DArray:
    if x.rank and not x.shape[0]:
        raise ShapeError("no cells")
    df = x.df.where("i0 = 0").select(*(F.col(f"i{k}").alias(f"i{k - 1}") for k in range(1, x.rank)), "v")
    return x.with_df(df, x.shape[1:])


def select(w: DArray, x: DArray) -> DArray:
    """x's major cells at w's places; negative places count from the end. A place out of range raises when the plan runs."""
    want_rank(x, 1, "selection")
    n = x.shape[0]
    at = F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v")).cast("long")
    ok = (F.col("v") >= -n) & (F.col("v") < n)
    asked = w.df.select(*(F.col(a).alias(f"__{a}") for a in w.axes), F.when(ok, at).otherwise(F.raise_error(F.lit("index out of range")).cast("long")).alias("i0"))
    found = asked.join(x.df, "i0")
    columns = [*(F.col(f"__{a}").alias(a) for a in w.axes), *(F.col(f"i{k}").alias(f"i{w.rank + k - 1}") for k in range(1, x.rank))]
    return x.with_df(found.select(*columns, "v"), (*w.shape, *x.shape[1:]))


def pick(x: DArray, *at: int) -> float | str:
    """One element, by its place along every axis."""
    if len(at) != x.rank:
        raise RankError("one place for each axis")
    df = x.df
    for k, (p, n) in enumerate(zip(at, x.shape, strict=True)):
        if not -n <= p < n:
            raise DomainError("index out of range")
        df = df.where(F.col(f"i{k}") == (p + n if p < 0 else p))
    v = df.first()["v"]
    return chr(v) if x.kind == "c" else v


def assert_ones(x: DArray, message: str = "assertion failed") -> DArray:
    """x if every element is 1; else the plan raises."""
    return x.map(lambda v: F.when(v == 1, v).otherwise(F.raise_error(F.lit(message)).cast("double")))
