"""Lookups. Equal keys meet by equi-joins on pre-aggregated sides; not-a-number equals nothing."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.errors import DomainError, ShapeError
from lattica.plans.index import dense_index, nth, running


#: Edges of bins that an expression holds.
FEW = 64


def key(v: Column, side: str, place: Column, numeric: bool = True) -> Column:
    """A join key under which zeros are equal and not-a-number meets nothing."""
    if not numeric:
        return v.cast("string")
    return F.when(F.isnan(v), F.concat(F.lit(f"{side}nan"), place.cast("string"))).otherwise((v + 0.0).cast("string"))


def _rows(a: DArray, side: str) -> tuple:
    """(place, one key) of the major cells: rows of rank-2 arrays are keys as a whole."""
    k = key(F.col("v"), side, F.concat_ws(",", *a.axes), a.kind == "n")
    if a.rank == 1:
        return a.df.select(F.col("i0").alias("p"), k.alias("k"))
    at = reduce(lambda s, j: s * F.lit(a.shape[j]) + F.col(f"i{j}"), range(1, a.rank), F.lit(0).cast("long"))
    return a.df.groupBy(F.col("i0").alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("a"), k.alias("k")))), lambda s: s["k"]), "|").alias("k"))


def _like(w: DArray, x: DArray) -> None:
    if w.shape[1:] != x.shape[1:] and w.rank != x.rank:
        raise ShapeError("cells have different shapes")


def _sides(w: DArray, x: DArray) -> tuple[DataFrame, DataFrame]:
    """_rows of both. Lists of numbers meet as numbers: zeros are equal in joins, and w's not-a-numbers are left out."""
    if w.rank == x.rank == 1 and w.kind == x.kind == "n":
        rows = lambda a: a.df.select(F.col("i0").alias("p"), F.col("v").cast("double").alias("k"))
        return rows(w).where(~F.isnan("k")), rows(x)
    return _rows(w, "w"), _rows(x, "x")


def index_of(w: DArray, x: DArray) -> DArray:
    """For each cell of x its first place in w, or w's length. The first place is aggregated before the join, so repeats never multiply."""
    _like(w, x)
    left, right = _sides(w, x)
    found = right.join(left.groupBy("k").agg(F.min("p").alias("f")), "k", "left")
    return DArray(found.select(F.col("p").alias("i0"), F.coalesce("f", F.lit(w.shape[0])).cast("double").alias("v")), (x.shape[0],))


def progressive_index_of(w: DArray, x: DArray) -> DArray:
    """Like index_of, but each cell of w is found once: the n-th equal cell of x meets the n-th of w."""
    _like(w, x)
    known, asked = _sides(w, x)
    left, right = nth(asked, ["k"], "p", "n", x.shape[0]), nth(known, ["k"], "p", "n", w.shape[0]).withColumnRenamed("p", "f")
    found = left.join(right, ["k", "n"], "left")
    return DArray(found.select(F.col("p").alias("i0"), F.coalesce("f", F.lit(w.shape[0])).cast("double").alias("v")), (x.shape[0],))


def member(w: DArray, x: DArray) -> DArray:
    """1 for each cell of w that occurs in x."""
    _like(w, x)
    known, asked = _sides(x, w)
    found = asked.join(known.select("k").distinct().withColumn("f", F.lit(1.0)), "k", "left")
    return DArray(found.select(F.col("p").alias("i0"), F.coalesce("f", F.lit(0.0)).alias("v")), (w.shape[0],))


def bins(w: DArray, x: DArray, up: bool = True) -> DArray:
    """For each element of x the number of elements of sorted w that come before or equal it.

    Both lists are tagged and counted together in one order by value: w's running count, split into blocks of x's
    range, needs no pairs. The order is checked first. Up to FEW edges are compared in the expression itself.
    """
    if w.shape[0] <= FEW:  # a number of edges that any plan holds
        edges = [r["v"] for r in w.df.orderBy("i0").select("v").collect()]
        if any(a > b if up else a < b for a, b in pairwise(edges)):
            raise DomainError("bins must be sorted")
        v = F.col("v")
        counted = reduce(Column.__add__, (F.when(F.lit(e) <= v if up else (F.lit(e) >= v) | F.isnan(v), 1).otherwise(0) for e in edges), F.lit(0))
        return x.with_df(x.df.withColumn("v", counted.cast("double")))
    lag = w.df.select(F.col("i0"), F.col("v").alias("a")).join(w.df.select((F.col("i0") - 1).alias("i0"), F.col("v").alias("b")), "i0")
    if lag.where("a > b" if up else "a < b").limit(1).count():
        raise DomainError("bins must be sorted")
    sign = 1.0 if up else -1.0
    # edges by rank: equal edges share the count of all of them, which their last place gives
    edges = w.df.groupBy((F.col("v") * sign).alias("e")).agg((F.max("i0") + 1).cast("double").alias("c"))
    both = x.df.select((F.col("v") * sign).alias("e"), F.col("i0"), F.lit(None).cast("double").alias("c"), F.lit(1).alias("t")).unionByName(edges.select("e", F.lit(None).cast("long").alias("i0"), "c", F.lit(0).alias("t")))
    placed, _ = dense_index(both, ["e", "t"], "__at")
    filled = _last_seen(placed, "c")
    return DArray(filled.where("t = 1").select("i0", F.coalesce("c", F.lit(0.0)).alias("v")), x.shape)


def _last_seen(df: DataFrame, column: str) -> DataFrame:
    """column filled with the largest value before, in the order of __at: edge counts only rise."""
    low = -1.0
    made = running(df.withColumn(column, F.coalesce(column, F.lit(low))), "__at", column, "max")
    return made.withColumn(column, F.when(F.col(column) >= 0, F.col(column)))


def asof(w: DataFrame, x: DataFrame, on: str) -> DataFrame:
    """x's rows with the columns of the last row of w whose `on` is not later; rows of x without one are left out.

    One sort puts both sides in order and a running maximum carries w's last row on, so there are no pairs, no second
    join and no partition of all rows. Of w's rows with equal `on` the last by the other columns counts.
    """
    order = [c for c in w.columns if c != on]
    both = w.select(F.col(on).alias("__t"), F.lit(0).alias("__s"), F.struct(*order).alias("__w"), F.lit(None).cast(x.select(F.struct("*")).schema[0].dataType).alias("__x")).unionByName(
        x.select(F.col(on).alias("__t"), F.lit(1).alias("__s"), F.lit(None).cast(w.select(F.struct(*order)).schema[0].dataType).alias("__w"), F.struct(*x.columns).alias("__x"))
    )
    placed, _ = dense_index(both, ["__t", "__s", "__w"], "__at")
    marked = running(placed.withColumn("__m", F.when(F.col("__s") == 0, F.struct("__at", "__w"))).drop("__w"), "__at", "__m", "max")
    return marked.where("__s = 1 AND __m IS NOT NULL").select("__x.*", "__m.__w.*")


def find(w: str, text: Column) -> Column:
    """Flags of the places where w begins in a text; an empty w begins everywhere."""
    n = F.length(text) - len(w) + 1
    # Characters are bound once, as a list in a list: a substring would count from the text's beginning for every place.
    at = lambda chars: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: reduce(Column.__and__, (F.get(chars, k + o) == c for o, c in enumerate(w)), F.lit(True)).cast("int"))
    return F.when(n < 1, F.array().cast("array<int>")).when(n >= 1, F.transform(F.array(F.split(text, "")), at)[0])


def find_cells(w: DArray, x: DArray) -> DArray:
    """Flags of the places where list w begins in list x, by one join on the element at each offset."""
    m, n = w.shape[0], x.shape[0]
    places = max(0, n - m + 1)
    every = x.df.sparkSession.range(places).withColumnRenamed("id", "i0")
    hits = x.df.select(F.col("i0").alias("p"), "v").join(w.df.select(F.col("i0").alias("o"), "v"), "v").groupBy((F.col("p") - F.col("o")).alias("i0")).agg(F.count("*").alias("c"))
    return DArray(every.join(hits, "i0", "left").select("i0", (F.coalesce("c", F.lit(0)) == m).cast("double").alias("v")), (places,))
