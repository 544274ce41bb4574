"""Parsers of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: The categories of a diagnosis.
DIAGNOSES = ["Networking", "Resource", "Configuration", "External Dependency", "Concurrency", "Timing", "Filesystem", "Other"]


def field(reply: Column | str, key: str) -> Column:
    """What follows `key:` on the last line that begins with it, stripped; null without such a line."""
    lines = F.transform(F.split(F.coalesce(col(reply), F.lit("")), "\n"), strip)
    own = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(key.upper() + ":")))
    return strip(F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1 << 30))


def similarity_score(reply: Column | str) -> Column:
    """1 to 5, 3 if there is no number."""
    n = field(reply, "SIMILARITY_SCORE").try_cast("int")
    return F.when(n.isNull(), 3).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(5)))


def correctness(reply: Column | str) -> Column:
    got = field(reply, "CORRECTNESS")
    return F.when(got.isin("Yes", "No", "Partial"), got).otherwise("Partial")


def diagnosis_category(reply: Column | str) -> Column:
    x = F.lower(F.coalesce(col(reply), F.lit("")))
    out = F.when(F.lit(False), "Other")
    for c in DIAGNOSES:
        out = out.when(F.contains(x, F.lit(c.lower())), c)
    return out.otherwise("Other")


def specificity(reply: Column | str) -> Column:
    """The first character as 1 to 3, 2 if it is no digit."""
    n = F.substring(strip(F.coalesce(col(reply), F.lit(""))), 1, 1).try_cast("int")
    return F.when(n.isNull(), 2).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(3)))


def verdict(reply: Column | str) -> Column:
    """struct(verdict, confidence, root_cause, split, reasoning) with the defaults Yes and Medium."""
    v, c = F.upper(field(reply, "VERDICT")), F.upper(field(reply, "CONFIDENCE"))
    has = lambda x, y: F.coalesce(F.contains(x, F.lit(y)), F.lit(False))
    return F.struct(
        F.when(has(v, "YES"), "Yes").when(has(v, "NO"), "No").when(has(v, "PARTIAL"), "Partial").otherwise("Yes").alias("verdict"),
        F.when(has(c, "HIGH"), "High").when(has(c, "LOW"), "Low").otherwise("Medium").alias("confidence"),
        F.coalesce(field(reply, "ROOT_CAUSE"), F.lit("")).alias("root_cause"),
        split_groups(field(reply, "SPLIT_SUGGESTION")).alias("split"),
        F.coalesce(field(reply, "REASONING"), F.lit("")).alias("reasoning"),
    )


def split_groups(suggestion: Column | str) -> Column:
    """Numbers of each part between ';' or '|'; null for none, n/a, - and for text without numbers."""
    x = col(suggestion)
    groups = F.filter(F.transform(F.split(x, "[;|]"), lambda p: F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0))), lambda g: F.size(g) > 0)
    return F.when((F.lower(x).isin("none", "n/a", "-", "")) | (F.size(groups) == 0), F.lit(None)).otherwise(groups)


def group_lines(reply: Column | str) -> Column:
    """Arrays of 1-based members of the lines that say group, without the group's own number."""
    lines = F.filter(F.split(strip(F.coalesce(col(reply), F.lit(""))), "\n"), lambda x: F.contains(F.lower(x), F.lit("group")))
    numbers = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("int")))
    return F.transform(F.filter(numbers, lambda n: F.size(n) > 0), lambda n: F.slice(n, 2, 1 << 20))


def batch_answers(reply: Column | str) -> Column:
    """array of struct(n, word) from lines like `[n] Word`."""
    found = F.regexp_extract_all(F.coalesce(col(reply), F.lit("")), F.lit(r"\[\d+\]\s*\w+"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\[(\d+)\]", 1).cast("int").alias("n"), F.regexp_extract(x, r"\]\s*(\w+)", 1).alias("word")))


def code_block(reply: Column | str) -> Column:
    """The first java fence's body, else the first bare fence's, else the stripped reply."""
    x = F.coalesce(col(reply), F.lit(""))
    java, bare = r"(?s)```java\s*\n(.*?)```", r"(?s)```\s*\n(.*?)```"
    return F.when(x.rlike(java), strip(F.regexp_extract(x, java, 1))).when(x.rlike(bare), strip(F.regexp_extract(x, bare, 1))).otherwise(strip(x))


def cache_key(model: Column | str, system: Column | str, prompt: Column | str) -> Column:
    """16 hex digits of the SHA-256 of model||system||prompt."""
    part = lambda x: F.coalesce(col(x), F.lit(""))
    return F.substring(F.sha2(F.concat(part(model), F.lit("||"), part(system), F.lit("||"), part(prompt)), 256), 1, 16)
