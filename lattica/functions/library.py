"""The mathematical, bitwise and text library as Columns; Arrow functions only where no built-in exists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.numeric import NAN, divide, ln, log1p, num

sin, cos, tan, asin, acos, atan, cbrt = (lambda x, f=f: f(num(x)) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.cbrt))
sinh, cosh, tanh, asinh, acosh, atanh, expm1 = (lambda x, f=f: f(num(x)) for f in (F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh, F.expm1))


def atan2(w: Column, x: Column) -> Column:
    """The angle of the point with ordinate x and abscissa w."""
    return F.atan2(num(x), num(w))


def hypot(w: Column, x: Column) -> Column:
    return F.hypot(num(w), num(x))


def log2(x: Column) -> Column:
    return divide(ln(x), math.log(2))


def log10(x: Column) -> Column:
    return divide(ln(x), math.log(10))


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def _gamma(x: float) -> float:
    if x < 0:
        return NAN
    return float(math.factorial(int(x))) if x == int(x) and x <= 170 else math.gamma(x + 1) if x <= 170 else math.inf


@F.pandas_udf(T.DoubleType())
def fact(x: pd.Series) -> pd.Series:
    """Gamma of x + 1; exact for small integers, not a number below zero."""
    return x.map(_gamma, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def log_fact(x: pd.Series) -> pd.Series:
    return x.map(lambda v: NAN if v <= -1 and v == int(v) else math.lgamma(v + 1), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def comb(w: pd.Series, x: pd.Series) -> pd.Series:
    """w choose x on rounded arguments; 0 outside 0..w."""
    return pd.Series([float(math.comb(n, k)) if 0 <= k <= n else 0.0 for n, k in zip(w.round().astype(int), x.round().astype(int), strict=True)])


@F.pandas_udf(T.DoubleType())
def gcd(w: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(w.abs().round().astype("int64"), x.abs().round().astype("int64")).astype(float))


@F.pandas_udf(T.DoubleType())
def lcm(w: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np.lcm(w.abs().round().astype("int64"), x.abs().round().astype("int64")).astype(float))


# Bits of a width: numbers are taken modulo 2 ** width and given back signed.


def wrap(x: Column, width: int) -> Column:
    """The signed number of the low bits."""
    low = F.pmod(x, F.lit(1 << width).cast("decimal(38,0)" if width > 32 else "long"))
    return F.when(low >= (1 << (width - 1)), low - (1 << width)).otherwise(low).cast("long")


def _wide(x: Column, width: int) -> Column:
    return x.cast("decimal(38,0)" if width > 31 else "long")


def bit_not(x: Column, width: int) -> Column:
    return wrap(F.bitwise_not(x.cast("long")), width)


def bit_neg(x: Column, width: int) -> Column:
    return wrap(-_wide(x, width), width)


def bit_and(w: Column, x: Column) -> Column:
    return w.cast("long").bitwiseAND(x.cast("long"))


def bit_or(w: Column, x: Column) -> Column:
    return w.cast("long").bitwiseOR(x.cast("long"))


def bit_xor(w: Column, x: Column) -> Column:
    return w.cast("long").bitwiseXOR(x.cast("long"))


def bit_add(w: Column, x: Column, width: int) -> Column:
    return wrap(_wide(w, width) + _wide(x, width), width)


def bit_sub(w: Column, x: Column, width: int) -> Column:
    return wrap(_wide(w, width) - _wide(x, width), width)


def bit_mul(w: Column, x: Column, width: int) -> Column:
    if width > 32:
        raise ValueError("products are taken to 32 bits")
    return wrap(w.cast("decimal(38,0)") * x.cast("decimal(38,0)"), width)


def bit_cast(x: Column, width: int, to: int) -> Column:
    """An array column of numbers of one width read as numbers of another, low part first."""
    kinds = {8: "u1", 16: "<u2", 32: "<u4"}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: (np.unpackbits(np.asarray(v, dtype=np.int64).astype(kinds[width]).view(np.uint8), bitorder="little").astype(np.int64) if to == 1 else np.asarray(v, dtype=np.int64).astype(kinds[width]).view(kinds[to]).astype(np.int64)).tolist())

    return run(x)


# Text: strings are lists of code points.


def code_points(text: Column) -> Column:
    """Array of the characters' code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def from_code_points(codes: Column) -> Column:
    """The string of an array of code points, through hexadecimal UTF-16."""
    unit = lambda n: F.lpad(F.hex(n.cast("long")), 4, "0")
    one = lambda n: F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.floor((n - 0x10000) / 1024) + 0xD800), unit(F.pmod(n, F.lit(1024)) + 0xDC00)))
    return F.decode(F.unhex(F.array_join(F.transform(codes, one), "")), "UTF-16BE")


def shift_chars(text: Column, by: Column | int) -> Column:
    """Every character moved by a number of code points."""
    return from_code_points(F.transform(code_points(text), lambda c: c + by))


def to_utf8(text: Column) -> Column:
    """The bytes of a text as an array of numbers."""
    # Read as Latin-1, each byte is a character: a substring would count from the text's beginning for every byte.
    return F.transform(F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != ""), F.ascii)


def from_utf8(codes: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")), "")), "UTF-8")


def parse_number(text: Column) -> Column:
    """A numeral with a high minus, an infinity or pi; anything else raises."""
    plain = F.translate(text, "¯", "-")
    return F.when(plain == "∞", float("inf")).when(plain == "-∞", float("-inf")).when(plain == "π", math.pi).when(plain == "-π", -math.pi).otherwise(F.when(plain.isin("∞", "-∞", "π", "-π"), "0").otherwise(plain).cast("double"))


def format_number(x: Column) -> Column:
    """A number as text: a high minus, integers without a point, exponents from 1e15 on and under 1e-4."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(number_text)

    return run(num(x))


def format_list(x: Column) -> Column:
    """An array of numbers as text: its formatted elements between angle brackets."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f"⟨ {' '.join(map(number_text, np.asarray(v, dtype=np.float64).tolist()))} ⟩" if len(v) else "⟨⟩")

    return run(x.cast("array<double>"))


def number_text(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "∞" if v > 0 else "¯∞"
    if v == int(v) and abs(v) < 1e15:
        return str(int(v)).replace("-", "¯") if v or math.copysign(1, v) > 0 else "¯0"
    text = repr(v) if 1e-4 <= abs(v) < 1e15 else np.format_float_scientific(v, trim="-", exp_digits=1)
    return text.replace("e+", "e").replace("-", "¯")


__all__ = ["log1p", *(n for n in dir() if not n.startswith("_"))]
