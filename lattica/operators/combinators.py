"""Functions of functions: composition, inverse, under, rank, depth, repetition, choice, catch."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.darray import DArray
from lattica.errors import ArrayError, ShapeError
from lattica.functions.numeric import INVERSES, INVERSES_RIGHT
from lattica.operators.fold import right_aggregate
from lattica.operators.selection import replicate
from lattica.operators.structural import reverse
from lattica.plans.index import ensure_checkpoint_dir

Fn = Callable[..., Any]


def constant(value: Any) -> Fn:
    return lambda *_: value


def left(w: Any, x: Any = None) -> Any:
    """The left argument, or the only one."""
    return w


def right(w: Any, x: Any = None) -> Any:
    """The right argument, or the only one."""
    return w if x is None else x


def fill_by(f: Fn, g: Fn) -> Fn:
    """f; what g would make the fill of its result isn't asked for, as fills follow the kind of a result."""
    return f


def swap(f: Fn) -> Fn:
    """f with its arguments exchanged; of one argument, f of it twice."""
    return lambda a, b=None: f(a, a) if b is None else f(b, a)


def atop(f: Fn, g: Fn) -> Fn:
    """f of g's result."""
    return lambda *a: f(g(*a))


def over(f: Fn, g: Fn) -> Fn:
    """f of g's results on each argument."""
    return lambda *a: f(*(g(x) for x in a))


def before(f: Fn | Any, g: Fn) -> Fn:
    """g with f of the left (or a bound value) as left argument."""
    return lambda w, x=None: g(f(w) if callable(f) else f, w if x is None else x)


def after(f: Fn, g: Fn | Any) -> Fn:
    """f with g of the right (or a bound value) as right argument."""
    return lambda w, x=None: f(w, g(w if x is None else x) if callable(g) else g)


def fork(f: Fn, g: Fn, h: Fn) -> Fn:
    """g of what f and h make of the same arguments."""
    return lambda *a: g(f(*a), h(*a))


def valences(f: Fn, g: Fn) -> Fn:
    """f of one argument, g of two."""
    return lambda *a: f(*a) if len(a) == 1 else g(*a)


def choose(f: Fn, options: list[Fn]) -> Fn:
    """The option that f's result numbers. On Columns it is decided row by row."""
    def run(*a: Any) -> Any:
        at = f(*a)
        if isinstance(at, Column):
            out = F.raise_error(F.lit("no such option")).cast("double")
            for k, g in enumerate(options):
                out = F.when(at == k, g(*a)).otherwise(out)
            return out
        return options[int(at)](*a)

    return run


def each(f: Fn) -> Fn:
    """f of every element of arrays, or of every item of an array column."""
    return lambda x: x.map(f) if isinstance(x, DArray) else F.transform(x, f)


def inverse(name: str, *held: Any) -> Fn:
    """The inverse of a named function, with its left argument held if it takes two."""
    if held:
        return lambda x: INVERSES_RIGHT[name](held[0], x)
    return INVERSES[name][1]


def repeat(f: Fn, n: int, undo: Fn | None = None, every: int = 16) -> Fn:
    """f n times over, or its inverse if n is negative. Long loops over arrays cut their lineage by checkpoints."""
    def run(x: Any) -> Any:
        step = f if n >= 0 else undo
        if step is None:
            raise ValueError("a negative repetition needs the inverse")
        for k in range(1, abs(n) + 1):
            x = step(x)
            if isinstance(x, DArray) and k % every == 0:
                x = checkpointed(x)
        return x

    return run


def checkpointed(x: DArray) -> DArray:
    ensure_checkpoint_dir(x.df.sparkSession)
    return x.with_df(x.df.checkpoint())


def repeat_each(f: Fn, counts: list, undo: Fn | None = None) -> Fn:
    """The results after each number of repetitions, in one pass each way; counts may be nested."""
    def run(x: Any) -> Any:
        def walk(c: Any) -> list[int]:
            return [n for y in c for n in walk(y)] if isinstance(c, list) else [c]

        asked = walk(counts)
        held = {0: x}
        for sign, step in ((1, f), (-1, undo)):
            for k in range(1, max([0, *(sign * n for n in asked)]) + 1):
                held[sign * k] = step(held[sign * (k - 1)])

        def build(c: Any) -> Any:
            return [build(y) for y in c] if isinstance(c, list) else held[c]

        return build(counts)

    return run


def while_(f: Fn, g: Fn, limit: int = 10_000) -> Fn:
    """f again while g of the value is 1."""
    def run(x: Any) -> Any:
        for _ in range(limit):
            if not g(x):
                return x
            x = f(x)
        raise RuntimeError("the repetition doesn't end")

    return run


def catch(f: Fn, g: Fn) -> Fn:
    """g of the arguments if f raises an error of values or shapes. Plans are lazy, so f's result is made for the check.

    What befalls the cluster, such as a lost executor, is no such error and goes on.
    """
    def run(*a: Any) -> Any:
        try:
            out = f(*a)
            if isinstance(out, DArray):
                out.df.write.format("noop").mode("overwrite").save()
            return out
        except (ArrayError, ArithmeticError):
            return g(*a)
        except PySparkException as e:  # what a plan itself raises
            if "USER_RAISED_EXCEPTION" not in str(e):
                raise
            return g(*a)

    return run


def timed(f: Fn) -> Fn:
    """Seconds that one call takes, its result made."""
    def run(*a: Any) -> float:
        began = time.perf_counter()
        out = f(*a)
        if isinstance(out, DArray):
            out.df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return run


def under_places(f: Callable[[DArray], DArray], x: DArray, places: DArray) -> DArray:
    """f of x's cells at those places, put back where they came from; a place given twice raises ShapeError.

    places: a list of places; the part f sees is numbered as they are.
    """
    asked = places.df.select(F.col("i0").alias("__to"), F.when(F.col("v") < 0, F.col("v") + x.shape[0]).otherwise(F.col("v")).cast("long").alias("__at"))
    if asked.groupBy("__at").count().where("count > 1").limit(1).count():
        raise ShapeError("a place stands twice")
    part = x.with_df(x.df.join(asked, F.col("i0") == F.col("__at")).withColumn("i0", F.col("__to")), (places.shape[0], *x.shape[1:]))
    made = f(part)
    if made.shape != part.shape:
        raise ShapeError("the shape changed")
    back = made.df.join(asked, F.col("i0") == F.col("__to")).select(F.col("__at").alias("i0"), *x.axes[1:], F.col("v").alias("__new"))
    return x.with_df(x.df.join(back, x.axes, "left").withColumn("v", F.coalesce("__new", "v")))


def under_filter(f: Callable[[DArray], DArray], mask: DArray, x: DArray) -> DArray:
    """f of the cells that a 0/1 mask keeps, put back."""
    kept = replicate(mask, DArray(mask.df.withColumn("v", F.col("i0").cast("double")), mask.shape))
    return under_places(f, x, kept)


def under_take(f: Callable[[DArray], DArray], x: DArray, n: int) -> DArray:
    """f of the first (negative: last) n cells, put back."""
    m = x.shape[0]
    if abs(n) > m:
        raise ShapeError("more cells than there are")
    spark = x.df.sparkSession
    ids = spark.range(abs(n)) if n >= 0 else spark.range(m + n, m)
    places = ids.select((F.col("id") - (0 if n >= 0 else m + n)).alias("i0"), F.col("id").cast("double").alias("v"))
    return under_places(f, x, DArray(places, (abs(n),)))


def under_drop(f: Callable[[DArray], DArray], x: DArray, n: int) -> DArray:
    """f of all but the first (negative: last) n cells, put back."""
    left = max(0, x.shape[0] - abs(n))
    return under_take(f, x, -left if n >= 0 else left)


def under_reverse(f: Callable[[DArray], DArray], x: DArray) -> DArray:
    return reverse(f(reverse(x)))


def under_inverse(f: Fn, name: str) -> Fn:
    """Under a function with an inverse: there, f, and back."""
    there, back = INVERSES[name]
    return lambda x: back(f(there(x)))


def rank(name: str, k: int, x: DArray) -> DArray:
    """A named fold at rank k: every cell of rank k (negative: under a frame of that length) is reduced along its leading axis."""
    frame = max(0, x.rank - k) if k >= 0 else min(x.rank, -k)
    if frame == x.rank:
        return x
    rest = [a for j, a in enumerate(x.axes) if j != frame]
    made = x.df.groupBy(*rest).agg(right_aggregate(name, F.col("v"), F.col(f"i{frame}")).alias("v"))
    shape = tuple(n for j, n in enumerate(x.shape) if j != frame)
    return x.with_df(made.select(*(F.col(a).alias(f"i{j}") for j, a in enumerate(rest)), "v"), shape)


def depth(f: Callable[[Column], Column], k: int) -> Callable[[Column], Column]:
    """f at the items k levels into nested array columns."""
    return f if k == 0 else lambda c: F.transform(c, depth(f, k - 1))
