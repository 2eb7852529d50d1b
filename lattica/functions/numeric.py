"""Pervasive scalar functions as Columns: IEEE results where SQL would raise, saturate or give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
EXACT = float(1 << 53)


def num(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def identity(x: Column) -> Column:
    return x


def negate(x: Column) -> Column:
    return -num(x)


def sign(x: Column) -> Column:
    """1, 0 or -1; not-a-number counts as negative."""
    x = num(x)
    return F.when(F.isnan(x), -1.0).when(x > 0, 1.0).when(x == 0, 0.0).otherwise(-1.0)


def reciprocal(x: Column) -> Column:
    return divide(1.0, x)


def exp(x: Column) -> Column:
    return F.exp(num(x))


def sqrt(x: Column) -> Column:
    return F.sqrt(num(x))


def floor(x: Column) -> Column:
    """Stays a double, also beyond the long range."""
    x = num(x)
    return F.when(F.isnan(x) | (F.abs(x) >= EXACT), x).otherwise(F.floor(F.when(F.isnan(x) | (F.abs(x) >= EXACT), 0.0).otherwise(x)).cast("double"))


def ceiling(x: Column) -> Column:
    x = num(x)
    return F.when(F.isnan(x) | (F.abs(x) >= EXACT), x).otherwise(F.ceil(F.when(F.isnan(x) | (F.abs(x) >= EXACT), 0.0).otherwise(x)).cast("double"))


def absolute(x: Column) -> Column:
    return F.abs(num(x))


def complement(x: Column) -> Column:
    return 1.0 - num(x)


def add(w: Column | float, x: Column | float) -> Column:
    return num(w) + num(x)


def subtract(w: Column | float, x: Column | float) -> Column:
    return num(w) - num(x)


def multiply(w: Column | float, x: Column | float) -> Column:
    return num(w) * num(x)


def divide(w: Column | float, x: Column | float) -> Column:
    """Division by either zero is infinite, or not a number for 0/0."""
    w, x = num(w), num(x)
    return F.when(x == 0, F.when(w > 0, INF).when(w < 0, -INF).otherwise(NAN)).otherwise(w / F.when(x == 0, 1.0).otherwise(x))


def power(w: Column | float, x: Column | float) -> Column:
    return F.pow(num(w), num(x))


def root(w: Column | float, x: Column | float) -> Column:
    """The w-th root of x."""
    return F.pow(num(x), divide(1.0, w))


def minimum(w: Column | float, x: Column | float) -> Column:
    w, x = num(w), num(x)
    return F.when(F.isnan(w) | F.isnan(x), NAN).otherwise(F.least(w, x))


def maximum(w: Column | float, x: Column | float) -> Column:
    w, x = num(w), num(x)
    return F.when(F.isnan(w) | F.isnan(x), NAN).otherwise(F.greatest(w, x))


def modulus(w: Column | float, x: Column | float) -> Column:
    """x modulo w with the sign of w; not a number for w = 0."""
    w, x = num(w), num(x)
    r = x % F.when(w == 0, 1.0).otherwise(w)
    return F.when(w == 0, NAN).when((r != 0) & ((x < 0) != (w < 0)), r + w).otherwise(r)


def span(w: Column | float, x: Column | float) -> Column:
    return 1.0 + num(w) - num(x)


def both(w: Column | float, x: Column | float) -> Column:
    return multiply(w, x)


def either(w: Column | float, x: Column | float) -> Column:
    w, x = num(w), num(x)
    return w + x - w * x


def _flag(c: Column) -> Column:
    return c.cast("double")


def _whole(w: Column, x: Column) -> Column:
    return ~(F.isnan(w) | F.isnan(x))


def equal(w: Column | float, x: Column | float) -> Column:
    """Not-a-number equals nothing."""
    w, x = num(w), num(x)
    return _flag((w == x) & _whole(w, x))


def unequal(w: Column | float, x: Column | float) -> Column:
    return 1.0 - equal(w, x)


def less(w: Column | float, x: Column | float) -> Column:
    w, x = num(w), num(x)
    return _flag((w < x) & _whole(w, x))


def greater(w: Column | float, x: Column | float) -> Column:
    return less(x, w)


def at_most(w: Column | float, x: Column | float) -> Column:
    w, x = num(w), num(x)
    return _flag((w <= x) & _whole(w, x))


def at_least(w: Column | float, x: Column | float) -> Column:
    return at_most(x, w)


def ln(x: Column) -> Column:
    """Natural logarithm: minus infinity at zero, not a number below."""
    x = num(x)
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.ln(F.when(x <= 0, 1.0).otherwise(x)))


def log(b: Column | float, x: Column) -> Column:
    return divide(ln(x), ln(num(b)))


def log1p(x: Column) -> Column:
    x = num(x)
    return F.when(x == -1, -INF).when(x < -1, NAN).otherwise(F.log1p(F.when(x <= -1, 0.0).otherwise(x)))


def compare(w: Column, x: Column) -> Column:
    """-1, 0 or 1 by the total order."""
    return F.when(w < x, -1.0).when(w > x, 1.0).otherwise(0.0)


#: Functions with an inverse of one argument: name -> (function, inverse).
INVERSES = {
    "negate": (negate, negate),
    "reciprocal": (reciprocal, reciprocal),
    "complement": (complement, complement),
    "identity": (identity, identity),
    "exp": (exp, ln),
    "sqrt": (sqrt, lambda x: num(x) * num(x)),
    "double": (lambda x: add(x, x), lambda x: num(x) / 2.0),
    "square": (lambda x: multiply(x, x), sqrt),
}

#: Functions of two arguments that are undone in the right one, the left one held: name -> inverse.
INVERSES_RIGHT = {
    "add": lambda w, x: subtract(x, w),
    "subtract": lambda w, x: subtract(w, x),
    "multiply": lambda w, x: divide(x, w),
    "divide": lambda w, x: divide(w, x),
    "power": log,
    "root": lambda w, x: power(x, w),
}

#: Identity element of each fold over an empty list.
IDENTITY = {"add": 0.0, "subtract": 0.0, "multiply": 1.0, "divide": 1.0, "power": 1.0, "minimum": INF, "maximum": -INF, "complement": 1.0, "both": 1.0, "either": 0.0, "less": 0.0, "greater": 0.0, "unequal": 0.0, "equal": 1.0, "at_most": 1.0, "at_least": 1.0}
