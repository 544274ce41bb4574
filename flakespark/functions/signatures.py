"""Grouping signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import last_part, or_else, strip

#: Categories that tell failures of one project apart.
STRONG = ["Networking", "Filesystem", "Timeout", "Concurrency"]


def default_signature(project: Column | str = "project", category: Column | str = "category") -> Column:
    c = or_else(category, "Unknown")
    return F.concat_ws(":", or_else(project, "Unknown"), F.when(c.isin(*STRONG), c).otherwise("Other"))


def strategies() -> dict[str, Column]:
    """The ten signatures over columns project, category, simple_name, message, class_name, entry_point."""
    project, category, kind, cls = (or_else(x, "Unknown") for x in ("project", "category", "simple_name", "class_name"))
    entry = last_part(or_else("entry_point", "Unknown"))
    message = strip(F.lower(F.substring(F.coalesce(F.col("message"), F.lit("")), 1, 50)))
    join = lambda *parts: F.concat_ws(":", *parts)
    return {
        "project": project,
        "project_category": default_signature(),
        "project_category_type": join(project, category, kind),
        "category": category,
        "type": kind,
        "type_message": join(kind, message),
        "class": cls,
        "project_class": join(project, last_part(cls)),
        "type_entry": join(kind, entry),
        "project_type_entry": join(project, kind, entry),
    }


def all_signatures() -> Column:
    """array of struct(strategy, signature): one pass for every strategy."""
    return F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("signature")) for k, v in strategies().items()])
