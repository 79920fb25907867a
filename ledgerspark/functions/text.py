"""Text forms of typed columns, and text clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space plus the four ASCII separators that Java's class leaves out.
_WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at either end."""
    return F.trim(F.regexp_replace(text, _WHITESPACE_RUN, " "))


def join_non_empty(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined with blanks."""
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])


def float_text(value: Column) -> Column:
    """A double as shortest decimal text: ``100.0``, ``12.5``, ``1e+16``, ``5e-05``.

    Money of everyday size takes the first branch, a plain cast; the others only
    work for values that the cast would show with an exponent or stray digits.
    """
    size = F.abs(value)
    shortest = value.cast("string")
    two_decimals = F.rint(value * 100) / 100 == value
    money = value.try_cast("decimal(18,2)").cast("string")
    money = F.when(F.endswith(money, F.lit("0")), F.left(money, F.length(money) - 1)).otherwise(money)
    digits = F.regexp_replace(shortest.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(shortest, "E", 1), r"\.0$", "")
    exponent = F.substring_index(shortest, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(two_decimals & ((size >= 1e-3) & (size < 1e7) | (size == 0)), shortest)
        .when(two_decimals & (size < 1e15), money)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(scientific)
    )


def timestamp_text(value: Column) -> Column:
    """``2025-10-05 00:00:00``, with six fraction digits when there is a fraction."""
    shortest = value.cast("string")
    return F.when(F.length(shortest) <= 19, shortest).otherwise(F.rpad(shortest, 26, "0"))


def text_form(value: Column, data_type: T.DataType) -> Column:
    """What text operators and hashes see of a typed column. Null stays null."""
    if isinstance(data_type, T.StringType):
        return value
    fraction = isinstance(data_type, T.DecimalType) and data_type.scale > 0
    if fraction or isinstance(data_type, (T.DoubleType, T.FloatType)):
        return float_text(value.cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value)
    if isinstance(data_type, T.DateType):
        return timestamp_text(value.cast("timestamp_ntz"))
    if isinstance(data_type, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


def shorten(text: Column, size: int = 15) -> Column:
    """At most ``size`` characters, with ``...`` when something was cut off."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def slug_id(name: Column, *more: Column) -> Column:
    """Lower-case name with underscores, plus eight hex digits of a content hash."""
    digest = F.md5(F.concat_ws("|", name, *more))
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("_"), F.substring(digest, 1, 8))


def split_lines(text: Column) -> Column:
    """The trimmed, non-blank lines of a text."""
    lines = F.transform(F.split(text, "\n"), collapse_ends)
    return F.filter(lines, lambda line: line != "")


def collapse_ends(text: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def literal_pattern(text: str) -> str:
    """A text as a pattern that matches just that text."""
    return re.escape(text)
