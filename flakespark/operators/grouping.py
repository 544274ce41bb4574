"""Grouping operators (C1 to C4, C7 to C10): assignments of tests to clusters.

An assignment has test_name, cluster_id, signature, category and whatever keys the
groupings run over.  Cluster ids follow the first appearance of a group by `ord`,
from 0, as dense ranks within the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flakespark.functions.text import col

#: Ranges that a whole table is cut into to number its rows.
RANGES = 128


def first_seen_groups(rows: DataFrame, signature: Column | str, keys: list[str] | None = None, min_size: int = 1, order: str = "ord", name: str = "test_name") -> DataFrame:
    """Adds signature, cluster_id and representative category.

    Groups of min_size and more come first, in the order of their first rows; the rows
    of smaller ones follow as clusters of one, in their own order, with their signature
    as it is.  The clusters' first places are found by one aggregation and ranked there;
    without keys by dense_positions, so no window holds all rows or all clusters.
    """
    keys = keys or []
    signed = rows.withColumn("signature", col(signature)).withColumn("__alone", F.lit(None).cast("string"))
    if min_size > 1:
        sizes = signed.groupBy(*keys, "signature").agg(F.count("*").alias("__size"))
        signed = signed.join(sizes, [*keys, "signature"]).withColumn("__alone", F.when(F.col("__size") < min_size, F.col(name))).drop("__size")
    groups = signed.groupBy(*keys, "signature", "__alone").agg(F.min(order).alias("__first"), *([F.min_by("category", order).alias("group_category")] if "category" in rows.columns else []))
    ranked = positions(groups, [F.col("__alone").isNotNull(), F.col("__first"), F.col("signature")], keys, "cluster_id").drop("__first")
    same = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in [*keys, "signature"]] + [F.col("s.__alone").eqNullSafe(F.col("r.__alone"))]
    added = [c for c in ranked.columns if c not in (*keys, "signature", "__alone")]
    return signed.alias("s").join(ranked.alias("r"), same).select("s.*", *[f"r.{c}" for c in added]).drop("__alone")


def positions(rows: DataFrame, order: list[Column], keys: list[str], out: str) -> DataFrame:
    """0-based places by order within keys; without keys over the whole table, by ranges of order's first numbers."""
    if keys:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    names = [f"__o{k}" for k in range(len(order))]
    return dense_positions(rows.select("*", *[c.alias(n) for c, n in zip(order, names)]), names, out).drop(*names)


def random_groups(rows: DataFrame, k: int, seed: int = 42, name: str = "test_name") -> DataFrame:
    """k groups by a seeded hash of the name; empty ones leave no gap in the ids."""
    placed = rows.withColumn("__g", F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(k)))
    ids = placed.select("__g").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("__g")).cast("long") - 1)  # at most k rows
    return placed.join(F.broadcast(ids) if k <= 10_000 else ids, "__g").drop("__g")


def singletons(rows: DataFrame, order: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """Every row its own cluster, numbered by order; ranges first, so no task holds all rows."""
    keys = keys or []
    if keys:
        return rows.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    return dense_positions(rows, order, "cluster_id")


def dense_positions(rows: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """0-based positions by `order` over the whole table in two levels: ranges, then places inside one.

    The ranges are cut by percentiles of the first ordering column that is a number (after
    flags, which have ranges of their own); the others break ties.  Only the ranges' sizes,
    RANGES for each flag at most, are summed in one place.
    """
    order = [order] if isinstance(order, str) else order
    kinds = dict(rows.dtypes)
    flags = [c for c in order if kinds[c] == "boolean"][:1]
    first = next(c for c in order if c not in flags)
    cuts = sorted(set(rows.agg(F.percentile_approx(first, [k / RANGES for k in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    for flag in flags:
        bucket = bucket + F.col(flag).cast("int") * (RANGES + 1)
    placed = rows.withColumn("__bucket", bucket)
    sizes = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("__bucket", (F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))  # a row for each range
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)).cast("long") - 1
    return placed.withColumn("__at", inner).join(F.broadcast(before), "__bucket").withColumn(out, F.col("__before") + F.col("__at")).drop("__bucket", "__at", "__before")


def apply_verdicts(assignments: DataFrame, verdicts: DataFrame, name: str = "test_name", order: str = "ord", least: int = 2) -> DataFrame:
    """Clusters of `least` and more that a verdict calls No fall apart, in place; the others stay.

    New ids follow the old ones, and inside a cluster that fell apart the order of its
    rows.  Adds original_cluster_id and verdict: that of the verdicts (a missing one is
    Yes), Skipped for smaller clusters.
    """
    sizes = assignments.groupBy("cluster_id").agg(F.count("*").alias("__size"))
    judged = assignments.join(sizes, "cluster_id").join(verdicts.select("cluster_id", F.col("verdict").alias("__verdict")), "cluster_id", "left")
    verdict = F.when(F.col("__size") < least, "Skipped").otherwise(F.coalesce("__verdict", F.lit("Yes")))
    labelled = judged.withColumn("verdict", verdict).withColumn("__alone", F.when(F.col("verdict") == "No", F.col(order))).drop("__size", "__verdict")
    clusters = positions(labelled.select("cluster_id", "__alone").distinct(), [F.col("cluster_id"), F.col("__alone")], [], "__new")
    same = (F.col("a.cluster_id") == F.col("c.cluster_id")) & F.col("a.__alone").eqNullSafe(F.col("c.__alone"))
    out = labelled.alias("a").join(clusters.alias("c"), same).select("a.*", "c.__new")
    return out.withColumnRenamed("cluster_id", "original_cluster_id").withColumnRenamed("__new", "cluster_id").drop("__alone")


def verification_stats(verified: DataFrame, splits: str | None = None) -> DataFrame:
    """total_clusters, verified_yes, verified_no, verified_partial, skipped_small, splits_performed.

    verified is what apply_verdicts returns; splits names a column with the suggested
    split of a partial verdict, which counts as one if it is there.
    """
    suggested = F.max(splits).alias("split") if splits else F.max(F.lit(None).cast("string")).alias("split")
    clusters = verified.groupBy("original_cluster_id").agg(F.first("verdict").alias("verdict"), suggested)
    of = lambda v: F.count_if(F.col("verdict") == v)
    return clusters.agg(
        F.count("*").alias("total_clusters"), of("Yes").alias("verified_yes"), of("No").alias("verified_no"), of("Partial").alias("verified_partial"), of("Skipped").alias("skipped_small"),
        (of("No") + F.count_if((F.col("verdict") == "Partial") & F.col("split").isNotNull())).alias("splits_performed"),
    )


def batches(rows: DataFrame, size: int, keys: list[str], order: str = "ord") -> DataFrame:
    """Number of the batch of `size` rows that a row falls in, by order within keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def first_n(rows: DataFrame, n: int, keys: list[str], *order: Column | str) -> DataFrame:
    """The first n rows of each key by order (W4, O1); Spark prunes by rank before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def group_reply(batch: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of a batch from a reply's groups.

    batch: keys, member (1-based), test_name; groups: keys, line, members array<int>.
    The first line that names a member has it; members that no line names stand alone.
    """
    named = groups.select(*keys, "line", F.explode("members").alias("member")).groupBy(*keys, "member").agg(F.min("line").alias("line"))
    return batch.join(named, [*keys, "member"], "left").withColumn("group_key", F.when(F.col("line").isNotNull(), F.concat(F.lit("g"), F.lpad(F.col("line").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("s"), F.lpad(F.col("member").cast("string"), 9, "0")))).drop("line")
