"""Numeric cell tests and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.constants import NA_TOKENS, NUMERIC_PATTERN

_INT_PATTERN = r"^\s*[+-]?\d+\s*$"
_UNSIGNED_MAX = "18446744073709551615"     # 20 digits
_SIGNED_MIN_ABS = "9223372036854775808"    # 19 digits


def is_na_token(c: Column) -> Column:
    """A cell that the csv reader turns into a missing value."""
    return c.isNull() | c.isin(NA_TOKENS)


def is_numeric_token(c: Column) -> Column:
    """A non-missing cell that parses as a number.

    Integer literals must fit a signed or an unsigned 64-bit integer, otherwise
    the column is read as text.  Digit strings of equal length compare like
    numbers, so the range test is a plain string comparison.
    """
    t = F.trim(c)
    body = F.regexp_replace(t, r"^[+-]?0*", "")
    digits = F.length(body)
    neg = t.startswith("-")
    int_ok = ((digits < 19)
              | ((digits == 19) & (~neg | (body <= F.lit(_SIGNED_MIN_ABS))))
              | ((digits == 20) & ~neg & (body <= F.lit(_UNSIGNED_MAX))))
    return c.rlike(NUMERIC_PATTERN) & (~c.rlike(_INT_PATTERN) | int_ok)


def sparsity_bucket(x: Column, decimals: int = 1) -> Column:
    """numpy-style round half to even at ``decimals`` places."""
    scale = float(10 ** decimals)
    return F.rint(x * scale) / scale


def decimal_text(tenths: Column) -> Column:
    """Text of a tenths value ``b`` as ``'<b div 10>.<b mod 10>'`` (engine independent)."""
    b = tenths.cast("int")
    return F.concat(F.floor(b / 10).cast("int").cast("string"), F.lit("."), (b % 10).cast("string"))
