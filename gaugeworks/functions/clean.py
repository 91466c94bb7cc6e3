"""Column clean-up: blanks, NaN, and text-to-number casts that never throw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE_NUMBER = r"^[+-]?[0-9]+$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trim spaces (only spaces, as SQL ``trim`` does) and turn '' into NULL."""
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    """Turn '' into NULL without trimming."""
    return F.nullif(as_column(c), F.lit(""))


def nan_to_null(c: Column | str) -> Column:
    """NaN sorts above every number, so it has to go before any max or rank."""
    return F.nanvl(as_column(c), F.lit(None).cast("double"))


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = as_column(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_double(c: Column | str) -> Column:
    """A number, or text holding one; anything else and any non-finite value is NULL."""
    return finite_or_null(as_column(c).try_cast("double"))


def to_int(c: Column | str) -> Column:
    """Text of plain digits (no blanks, no '7.0') as int; anything else is NULL."""
    text = as_column(c).cast("string")
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("int"))


def number_text(c: Column | str) -> Column:
    """A double as plain decimal text, 'None' for NULL.

    Spark switches to scientific notation at 1e7; passages want '12345678.9'.
    """
    c = as_column(c)
    raw = c.cast("string")
    size = F.abs(c)
    in_plain_range = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    digits = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.coalesce(F.when(in_plain_range, plain).otherwise(raw), F.lit("None"))


def value_text(c: Column | str) -> Column:
    """Any non-float value as text, 'None' for NULL."""
    return F.coalesce(as_column(c).cast("string"), F.lit("None"))
