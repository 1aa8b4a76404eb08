"""Small text expressions, evaluated inside the JVM but for the spelling of axis labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DIGITS = r"\d+(?:\.\d+)?"
TAGS = "<[^>]+>"


def _number_near(plain: Column, pattern: str) -> Column:
    """The first captured number, and where its match starts; null without a match."""
    place = F.regexp_instr(plain, F.lit(pattern))
    return F.when(place > 0, F.struct(place.alias("place"), F.regexp_extract(plain, pattern, 1).try_cast("double").alias("value")))


def text_stat(column: Column, label: str) -> Column:
    """The number next to ``label`` that comes first in the text, after or before it; tags are ignored, else 0."""
    name = " ".join(re.escape(word) for word in label.split(" "))
    plain = F.regexp_replace(column, TAGS, " ")
    behind = _number_near(plain, rf"(?i){name}\s*\+?\s*({DIGITS})")
    ahead = _number_near(plain, rf"(?i)({DIGITS})\s*{name}")
    first = F.array_min(F.array_compact(F.array(behind, ahead)))
    return F.coalesce(first["value"], F.lit(0.0))


def patch_key(version: Column) -> Column:
    """First two parts of a dotted version; a shorter one is returned whole."""
    return F.substring_index(version, ".", 2)


def three_digits(value: Column) -> Column:
    """The number with three significant digits and no padding, as C's ``%.3g`` spells it.

    C rounds the exact binary value, and to the even digit in the middle; no function of Spark does. For the
    few rows of an axis: it runs in Python.
    """
    return F.udf(lambda number: None if number is None else f"{number:.3g}", "string")(value.cast("double"))
