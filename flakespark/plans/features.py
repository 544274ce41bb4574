"""The feature pipeline: tests with traces to names, exception, category and signatures, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions import cascade, names, traces


def extract(tests: DataFrame, tiers: tuple[int, ...] = (1, 2, 3, 4), unwrap_cause: bool = True, source_rules: dict[str, list[str]] | None = None, frames: bool = False) -> DataFrame:
    """Adds class_name, method_name, exception_type, simple_name, message, key_classes, entry_point, stack_depth, category, tier.

    frames: the frames are used more than once, so find them once a row; otherwise they
    are found where they are used, and not at all where they are not.
    """
    plain = tests.select("*", names.class_name("test_name").alias("class_name"), names.method_name("test_name").alias("method_name"), traces.stack_depth("trace").alias("stack_depth"))
    framed = plain.select("*", once(key_classes=traces.key_classes("trace")) if frames else traces.key_classes("trace").alias("key_classes"))
    lines = framed.select("*", once(__line=traces.first_line("trace")))
    kinds = lines.select("*", once(__kind=traces.line_type("__line"), message=traces.line_message("__line")))
    parsed = kinds.withColumn("exception_type", traces.unwrapped("__kind") if unwrap_cause else F.col("__kind")).drop("__line", "__kind")
    judged = parsed.select("*", once(c=cascade.categorise("exception_type", "message", "trace", "source", tiers, source_rules=source_rules or cascade.SOURCE_WORDS)))
    return judged.select("*", names.simple_name("exception_type").alias("simple_name"), F.coalesce(F.get("key_classes", F.lit(0)), F.lit("")).alias("entry_point"), F.col("c.category").alias("category"), F.col("c.tier").alias("tier")).drop("c")


def once(**columns: Column) -> Column:
    """Columns evaluated once a row: inline() of one struct, which the optimizer does not copy into every later use."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def extract_deduplicated(tests: DataFrame) -> DataFrame:
    """The batch cascade (F10): classify each distinct exception key once, then join back.

    The key is the type and the first 50 characters of the message, as a costly third
    tier would be paid once a key; rows without a trace keep an empty category and tier 0.
    """
    lines = tests.select("*", once(__line=traces.first_line("trace")))
    parsed = lines.select("*", once(exception_type=traces.unwrapped(traces.line_type("__line")), message=traces.line_message("__line"))).drop("__line")
    keyed = parsed.withColumn("key", F.concat("exception_type", F.lit(":"), F.substring("message", 1, 50)))
    traced = F.coalesce(F.length("trace"), F.lit(0)) > 0
    firsts = keyed.where(traced).groupBy("key").agg(F.min_by(F.struct("exception_type", "message"), "ord").alias("f")).select("key", "f.*")
    judged = firsts.withColumn("c", cascade.categorise("exception_type", "message", F.lit("x"), F.lit(None).cast("string"))).select("key", "c.*")
    return keyed.join(judged, "key", "left").withColumn("category", F.when(traced, F.col("category")).otherwise("")).withColumn("tier", F.when(traced, F.col("tier")).otherwise(0))
