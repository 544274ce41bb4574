"""Small string helpers with the semantics the analyses need (Unicode strip, guarded truth)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """All Unicode white space off both ends; Spark's trim only takes spaces."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def filled(x: Column | str) -> Column:
    """Not null and not empty."""
    return F.coalesce(F.length(col(x)), F.lit(0)) > 0


def or_else(x: Column | str, default: str) -> Column:
    return F.when(filled(x), col(x)).otherwise(F.lit(default))


def contains_any(x: Column, needles: list[str]) -> Column:
    """True if one of the literals occurs; one regular expression, so the text is walked once."""
    import re

    return x.rlike("|".join(re.escape(n) for n in needles))


def last_part(x: Column | str, separator: str = ".") -> Column:
    return F.substring_index(col(x), separator, -1)


def prefix(x: Column | str, n: int, marker: str = "") -> Column:
    """The first n characters, with a marker where something was cut."""
    return F.when(F.length(col(x)) > n, F.concat(F.substring(col(x), 1, n), F.lit(marker))).otherwise(col(x))
