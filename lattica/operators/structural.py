"""Operators that move elements: each is a projection of the index columns, with a join only where data repeats."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.darray import DArray, want_rank
from lattica.errors import DomainError, FillError, RankError, ShapeError


def deshape(x: DArray) -> DArray:
    """The elements as a list in row-major order."""
    return x.with_df(x.df.withColumn("i0", x.flat()), (x.size,))


def reshape(x: DArray, *shape: int | str) -> DArray:
    """x's elements in a new shape, repeated from the start if they run out.

    One axis may be computed: 'exact' must divide evenly, 'floor' drops a rest, 'cycle' fills it from the start, 'pad' with the fill.
    """
    how = next((s for s in shape if isinstance(s, str)), None)
    known = prod(s for s in shape if not isinstance(s, str))
    n = x.size
    if how is not None:
        if how == "exact" and (known == 0 or n % known):
            raise ShapeError("elements don't fill the computed axis")
        many = n // known if how in ("exact", "floor") else -(-n // known)
        shape = tuple(many if isinstance(s, str) else s for s in shape)
    size = prod(shape)
    out = DArray(x.df, tuple(shape), x.kind, x.fill)
    flat = x.df.select(x.flat().alias("__f"), "v")
    if how == "pad" and size > n:
        if x.fill is None:
            raise FillError("the fill isn't known")
        rest = x.df.sparkSession.range(n, size).select(F.col("id").alias("__f"), F.lit(x.fill).cast(x.df.schema["v"].dataType).alias("v"))
        return out.with_df(out.numbered(flat.union(rest), "__f"))
    if size <= n:
        return out.with_df(out.numbered(flat.where(F.col("__f") < size), "__f"))
    if n == 0:
        raise ShapeError("no elements to repeat")
    # each element is laid out at every multiple of n that is inside
    copies = flat.withColumn("__f", F.explode(F.sequence("__f", F.lit(size - 1).cast("long"), F.lit(n).cast("long"))))
    return out.with_df(out.numbered(copies, "__f"))


def enclose_cells(x: DArray) -> DArray:
    """A list of x's major cells as arrays: column v is an array in row-major order. Only for cells that fit a row."""
    want_rank(x, 2, "cells")
    at = F.lit(0).cast("long")
    for k, n in enumerate(x.shape[1:], start=1):
        at = at * F.lit(n) + F.col(f"i{k}")
    df = x.df.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("k"), "v"))), lambda s: s["v"]).alias("v"))
    return DArray(df, (x.shape[0],), x.kind, None)


def merge(x: DArray, width: int) -> DArray:
    """A list of array cells as one array with a further axis; cells must have that width."""
    df = x.df.withColumn("v", F.when(F.size("v") == width, F.col("v")).otherwise(F.raise_error(F.lit("cells have different shapes")).cast(x.df.schema["v"].dataType)))
    out = DArray(df, (*x.shape, width), x.kind, 0.0)
    return out.with_df(df.select(*x.axes, F.posexplode("v").alias(f"i{x.rank}", "v")))


def concat(w: DArray, x: DArray) -> DArray:
    """w's major cells, then x's; an array of one rank less is a single cell."""
    if w.kind != x.kind:
        raise DomainError("numbers and characters don't share a column")
    if w.rank == x.rank - 1:
        w = couple(w)
    elif x.rank == w.rank - 1:
        x = couple(x)
    if w.rank != x.rank or w.rank == 0:
        raise RankError("ranks differ by more than one")
    if w.shape[1:] != x.shape[1:]:
        raise ShapeError("cells have different shapes")
    moved = x.df.withColumn("i0", F.col("i0") + w.shape[0])
    return w.with_df(w.df.select(*w.axes, "v").unionByName(moved.select(*x.axes, "v")), (w.shape[0] + x.shape[0], *w.shape[1:]))


def join(parts: list[DArray]) -> DArray:
    """Several arrays along the first axis."""
    out = parts[0]
    for p in parts[1:]:
        out = concat(out, p)
    return out


def couple(x: DArray, other: DArray | None = None) -> DArray:
    """A new leading axis over one array, or over two of equal shape."""
    def lift(a: DArray, at: int) -> DArray:
        df = a.df.select(F.lit(at).cast("long").alias("i0"), *(F.col(f"i{k}").alias(f"i{k + 1}") for k in range(a.rank)), "v")
        return DArray(df, (1, *a.shape), a.kind, a.fill)

    if other is None:
        return lift(x, 0)
    if x.shape != other.shape:
        raise ShapeError("shapes differ")
    return x.with_df(lift(x, 0).df.unionByName(lift(other, 1).df), (2, *x.shape))


def take(x: DArray, *counts: int) -> DArray:
    """The first (negative: last) cells along each leading axis; more than there are pads with the fill."""
    while x.rank < len(counts):
        x = couple(x)
    df, shape, pad = x.df, list(x.shape), False
    for k, c in enumerate(counts):
        n, m = x.shape[k], abs(c)
        shift = 0 if c >= 0 else m - n
        df = df.withColumn(f"i{k}", F.col(f"i{k}") + shift).where((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < m))
        shape[k], pad = m, pad or m > n
    out = DArray(df, tuple(shape), x.kind, x.fill)
    if not pad:
        return out.with_df(df)
    if x.fill is None:
        raise FillError("the fill isn't known")
    frame = out.numbered(x.df.sparkSession.range(out.size), "id")
    return out.with_df(frame.join(df.select(*out.axes, "v"), out.axes, "left").withColumn("v", F.coalesce("v", F.lit(x.fill).cast(x.df.schema["v"].dataType))))


def drop(x: DArray, *counts: int) -> DArray:
    """Without the first (negative: last) cells along each leading axis."""
    while x.rank < len(counts):
        x = couple(x)
    df, shape = x.df, list(x.shape)
    for k, c in enumerate(counts):
        n = max(0, x.shape[k] - abs(c))
        df = df.withColumn(f"i{k}", F.col(f"i{k}") - max(0, c)).where((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < n))
        shape[k] = n
    return x.with_df(df, tuple(shape))


def prefixes(x: DArray) -> DArray:
    """All n + 1 prefixes, each an array cell. The result is quadratic by nature; meant for short lists."""
    cells = x.df.agg(F.transform(F.array_sort(F.collect_list(F.struct("i0", "v"))), lambda s: s["v"]).alias("a"))
    df = cells.select(F.explode(F.sequence(F.lit(0), F.size("a"))).alias("i0"), "a").select("i0", F.expr("slice(a, 1, i0)").alias("v"))
    return DArray(df, (x.shape[0] + 1,), x.kind, None)


def suffixes(x: DArray) -> DArray:
    """All n + 1 suffixes, each an array cell."""
    cells = x.df.agg(F.transform(F.array_sort(F.collect_list(F.struct("i0", "v"))), lambda s: s["v"]).alias("a"))
    df = cells.select(F.explode(F.sequence(F.lit(0), F.size("a"))).alias("i0"), "a").select("i0", F.expr("slice(a, i0 + 1, size(a) - i0)").alias("v"))
    return DArray(df, (x.shape[0] + 1,), x.kind, None)


def windows(x: DArray, *lengths: int) -> DArray:
    """All full windows: one new axis for each length, in front of the element's place in its window."""
    r = len(lengths)
    if r > x.rank or any(m < 0 or m > n + 1 for m, n in zip(lengths, x.shape, strict=False)):
        raise ShapeError("windows are longer than their axes")
    df = x.df
    for k, m in enumerate(lengths):
        df = df.withColumn(f"__w{k}", F.explode(F.sequence(F.lit(0), F.lit(m - 1))) if m else F.explode(F.array().cast("array<int>")))
    starts = [(F.col(f"i{k}") - F.col(f"__w{k}")) for k in range(r)]
    shape = (*(n - m + 1 for m, n in zip(lengths, x.shape, strict=False)), *lengths, *x.shape[r:])
    columns = [*(s.alias(f"i{k}") for k, s in enumerate(starts)), *(F.col(f"__w{k}").cast("long").alias(f"i{r + k}") for k in range(r)), *(F.col(f"i{k}").alias(f"i{r + k}") for k in range(r, x.rank))]
    made = df.select(*columns, "v")
    for k in range(r):
        made = made.where((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < shape[k]))
    return x.with_df(made, shape)


def shift_before(x: DArray, w: DArray | float | None = None) -> DArray:
    """w's cells (or one fill) enter in front; as many leave at the end."""
    return _shift(x, w, True)


def shift_after(x: DArray, w: DArray | float | None = None) -> DArray:
    """w's cells (or one fill) enter at the end; as many leave in front."""
    return _shift(x, w, False)


def _shift(x: DArray, w: DArray | float | None, front: bool) -> DArray:
    want_rank(x, 1, "a shift")
    n = x.shape[0]
    if isinstance(w, DArray):
        if w.rank == x.rank - 1:
            w = couple(w)
        if w.shape[1:] != x.shape[1:]:
            raise ShapeError("cells have different shapes")
        m, inserted = w.shape[0], w.df
    else:
        value = x.fill if w is None else w
        if value is None:
            raise FillError("the fill isn't known")
        m = 1
        one = DArray(x.df, (1, *x.shape[1:]))
        inserted = one.numbered(x.df.sparkSession.range(prod(x.shape[1:])), "id").withColumn("v", F.lit(value).cast(x.df.schema["v"].dataType))
    if front:
        moved = x.df.withColumn("i0", F.col("i0") + m)
    else:
        moved, inserted = x.df.withColumn("i0", F.col("i0") - m), inserted.withColumn("i0", F.col("i0") + n - m)
    both = moved.select(*x.axes, "v").unionByName(inserted.select(*x.axes, "v"))
    return x.with_df(both.where((F.col("i0") >= 0) & (F.col("i0") < n)))


def reverse(x: DArray) -> DArray:
    want_rank(x, 1, "reversal")
    return x.with_df(x.df.withColumn("i0", F.lit(x.shape[0] - 1) - F.col("i0")))


def rotate(x: DArray, *by: int) -> DArray:
    """Cells move to the front by each count, and around."""
    want_rank(x, len(by), "rotation")
    df = x.df
    for k, b in enumerate(by):
        if x.shape[k]:
            df = df.withColumn(f"i{k}", F.pmod(F.col(f"i{k}") - F.lit(b), F.lit(x.shape[k])))
    return x.with_df(df)


def transpose(x: DArray) -> DArray:
    """The first axis becomes the last."""
    return x if x.rank < 2 else reorder(x, x.rank - 1)


def untranspose(x: DArray) -> DArray:
    """The last axis becomes the first."""
    if x.rank < 2:
        return x
    df = x.df.select(F.col(f"i{x.rank - 1}").alias("i0"), *(F.col(f"i{k}").alias(f"i{k + 1}") for k in range(x.rank - 1)), "v")
    return x.with_df(df, (x.shape[-1], *x.shape[:-1]))


def reorder(x: DArray, *to: int) -> DArray:
    """Leading axes go to the places in `to`, the others fill the rest in order; a place given twice takes the diagonal."""
    if len(to) > x.rank:
        raise RankError("more places than axes")
    rest = iter([p for p in range(x.rank) if p not in to])
    places = [*to, *(next(rest) for _ in range(x.rank - len(to)))]
    size = max(places) + 1
    if sorted(set(places)) != list(range(size)):
        raise DomainError("places leave an axis out")
    df, shape, columns = x.df, [], []
    for p in range(size):
        own = [k for k, q in enumerate(places) if q == p]
        for k in own[1:]:
            df = df.where(F.col(f"i{own[0]}") == F.col(f"i{k}"))
        shape.append(min(x.shape[k] for k in own))
        columns.append(F.col(f"i{own[0]}").alias(f"i{p}"))
    return x.with_df(df.select(*columns, "v"), tuple(shape))


def depth_of(x: DArray) -> int:
    """How deep arrays lie in each other: 0 for an atom, 1 for an array of atoms, one more for each level of its cells."""
    kind, levels = x.df.schema["v"].dataType, int(x.rank > 0)
    while isinstance(kind, T.ArrayType):
        kind, levels = kind.elementType, levels + 1
    return levels
