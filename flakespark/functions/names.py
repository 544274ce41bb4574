"""Test names, project names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, last_part


def _before_last_dot(x: Column) -> Column:
    return F.regexp_replace(x, r"\.[^.]*$", "")


def class_name(name: Column | str) -> Column:
    """Before the first '#', else before the last '.', else the whole name."""
    x = col(name)
    return F.when(F.contains(x, F.lit("#")), F.substring_index(x, "#", 1)).otherwise(_before_last_dot(x))


def method_name(name: Column | str) -> Column:
    """The second '#' part, else after the last '.', else the whole name."""
    x = col(name)
    return F.when(F.contains(x, F.lit("#")), F.get(F.split(x, "#", -1), F.lit(1))).otherwise(last_part(x))


def grouping_class(name: Column | str) -> Column:
    """Before the last '#', else before the last '.', else the whole name."""
    x = col(name)
    return F.when(F.contains(x, F.lit("#")), F.regexp_extract(x, r"(?s)^(.*)#", 1)).otherwise(_before_last_dot(x))


def simple_name(name: Column | str) -> Column:
    return last_part(name)


def source_file_name(name: Column | str) -> Column:
    return F.concat(class_name(name), F.lit("-"), method_name(name), F.lit(".java"))


def project_name(url: Column | str) -> Column:
    """The last two segments of a URL joined by '-'; the URL itself if it has fewer."""
    parts = F.split(F.regexp_replace(col(url), "/+$", ""), "/", -1)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "-")).otherwise(col(url))


def sample_id(source: str, position: Column | str) -> Column:
    return F.format_string(f"{source}_%04d", col(position))


#: Fix states that are told apart.
STATUSES = ["Accepted", "Opened", "Rejected"]


def status(x: Column | str) -> Column:
    return F.when(col(x).isin(*STATUSES), col(x)).otherwise("Unknown")


_PULL = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"


def pull_request(url: Column | str) -> Column:
    """struct(owner, repo, number), null if the URL names no pull request."""
    x = col(url)
    return F.when(x.rlike(_PULL), F.struct(F.regexp_extract(x, _PULL, 1).alias("owner"), F.regexp_extract(x, _PULL, 2).alias("repo"), F.regexp_extract(x, _PULL, 3).cast("long").alias("number")))


def cache_key(owner: Column | str, repo: Column | str, number: Column | str) -> Column:
    return F.concat_ws("_", col(owner), col(repo), col(number).cast("string"))


def relevant_file(path: Column | str, name: Column | str) -> Column:
    """A Java file of the test's class or of a test folder (P10)."""
    simple = simple_name(class_name(name))
    return F.endswith(col(path), F.lit(".java")) & (F.contains(col(path), simple) | F.contains(col(path), F.lit("/test/")) | F.contains(col(path), F.lit("/tests/")))
