"""Safe numeric parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_FLOAT_LITERAL = (
    r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity)\s*$"
)


def parse_decimal_comma(text: Column, strip_thousands: bool = False) -> Column:
    """``'-12,50'`` to -12.5; what is not a number becomes null.

    Thousands dots (``1.234,56``) give null unless ``strip_thousands`` is set.
    """
    if strip_thousands:
        text = F.when(text.contains(","), F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(_PLAIN_NUMBER), F.trim(dotted).try_cast("double"))


def parse_whole_number(text: Column) -> Column:
    """Digits with an optional sign and an optional zero fraction, as bigint."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def parse_float(text: Column) -> Column:
    """Text as a float literal; null where it is none, and for not-a-number."""
    cleaned = F.replace(F.trim(F.regexp_replace(text, r"\s", "")), F.lit("_"), F.lit(""))
    return F.when(text.rlike(_FLOAT_LITERAL), cleaned.try_cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; null when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest whole number (ties to even), scale back: what array libraries do.

    ``bround`` looks at the decimal text instead and differs for values like 63.349999999999994.
    """
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale
