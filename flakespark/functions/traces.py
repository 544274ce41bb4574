"""Stack traces: exception, frames, depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Classes under these prefixes are no project's own.
STANDARD_PREFIXES = ["java.", "javax.", "sun.", "com.sun.", "jdk.", "org.junit", "junit.", "org.testng", "org.apache.maven", "org.gradle", "org.mockito", "org.easymock", "org.powermock"]
FRAME = r"(?U)at\s+([\w.]+)\.[^(]+\("


def first_line(trace: Column | str) -> Column:
    """The first line of the stripped trace; its own end is stripped by what is made of it."""
    return F.regexp_extract(F.coalesce(col(trace), F.lit("")), r"(?U)^\s*([^\n]*)", 1)


def line_type(line: Column | str) -> Column:
    """What a line has before its first ':'."""
    return strip(F.substring_index(col(line), ":", 1))


def line_message(line: Column | str) -> Column:
    x = col(line)
    return F.when(F.contains(x, F.lit(":")), strip(F.regexp_replace(x, "^[^:]*:", ""))).otherwise("")


def unwrapped(kind: Column | str) -> Column:
    """A type without a leading 'caused by' and its colon."""
    x = col(kind)
    rest = F.regexp_replace(strip(F.substring(x, 10, 1 << 30)), "^:", "")
    return F.when(F.startswith(F.lower(x), F.lit("caused by")), strip(rest)).otherwise(x)


def exception_type(trace: Column | str, unwrap_cause: bool = True) -> Column:
    kind = line_type(first_line(trace))
    return unwrapped(kind) if unwrap_cause else kind


def exception_message(trace: Column | str) -> Column:
    return line_message(first_line(trace))


def key_classes(trace: Column | str, most: int = 5) -> Column:
    """The first distinct classes of frames that are no standard library's."""
    own = F.filter(F.regexp_extract_all(F.coalesce(col(trace), F.lit("")), F.lit(FRAME), F.lit(1)), lambda c: ~_standard(c))
    return F.slice(F.array_distinct(own), 1, most)


def _standard(c: Column) -> Column:
    out = F.startswith(c, F.lit(STANDARD_PREFIXES[0]))
    for p in STANDARD_PREFIXES[1:]:
        out = out | F.startswith(c, F.lit(p))
    return out


def entry_point(trace: Column | str) -> Column:
    return F.coalesce(F.get(key_classes(trace), F.lit(0)), F.lit(""))


def stack_depth(trace: Column | str) -> Column:
    x = F.coalesce(col(trace), F.lit(""))
    return ((F.length(x) - F.length(F.replace(x, F.lit("\n\tat "), F.lit("")))) / 5).cast("long")
