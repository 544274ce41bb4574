"""Sampling by quota and by cluster."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows to draw of each fix category, in the order of the result.
QUOTAS = {"ID": 700, "OD-Vic": 120, "OD": 70, "NOD": 24, "NIO": 23, "OD-Brit": 20, "NDOD": 15, "TZD": 15, "UD": 13}


def stratified(rows: DataFrame, category: str, quotas: dict[str, int] | None = None, key: str = "id", seed: int = 42) -> DataFrame:
    """At most the quota of each category, all of a smaller one, none of an unlisted one.

    Members are those with the smallest seeded hashes of the key; the rank limit is
    pushed below the shuffle, so a hot category sends no more than its quota a task.
    """
    plan = [(c, q, k) for k, (c, q) in enumerate((QUOTAS if quotas is None else quotas).items())]
    table = rows.sparkSession.createDataFrame(plan, f"`{category}` string, quota int, quota_order int")
    ranked = rows.join(F.broadcast(table), category).withColumn("__rank", F.row_number().over(Window.partitionBy(category).orderBy(F.xxhash64(key, F.lit(seed)), key)))
    most = max([q for _, q, _ in plan], default=0)
    return ranked.where((F.col("__rank") <= most) & (F.col("__rank") <= F.col("quota"))).drop("__rank", "quota")


def cluster_quota(sizes: list[tuple[int, int]], target: int, least: int, seed: int) -> dict[int, int]:
    """Rows to draw of each cluster: (cluster, size) pairs in their drawing order, walked until fewer than `least` are left of the target."""
    if sum(s for _, s in sizes) <= target:
        return dict(sizes)
    rng, left, out = random.Random(seed), target, {}
    for cluster, size in sizes:
        if left < max(1, least):
            break
        most = min(size, left)
        if most < least:
            continue
        take = rng.randint(least, most)
        out[cluster] = take
        left -= take
    return out


def cluster_sample(rows: DataFrame, target: int, least: int = 2, cluster: str = "cluster_id", key: str = "test_name", seed: int = 42) -> DataFrame:
    """A sample that keeps clusters together.

    Clusters under `least` rows are out; the others are walked in the order of a seeded
    hash and give a random number of rows each until target is reached.  Each draw
    depends on what is left, so the walk is on the driver, over the at most
    target / least clusters that it can reach.
    """
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total <= target:
        return rows.join(sizes.select(cluster), cluster, "left_semi")
    walk = [(r[cluster], r["n"]) for r in sizes.orderBy(F.xxhash64(cluster, F.lit(seed)), cluster).limit(target // max(1, least) + 1).collect()]
    quota = rows.sparkSession.createDataFrame(list(cluster_quota(walk, target, least, seed).items()) or [(None, 0)], f"`{cluster}` long, __quota int")
    ranked = rows.join(F.broadcast(quota), cluster).withColumn("__rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.xxhash64(key, F.lit(seed)), key)))
    return ranked.where(F.col("__rank") <= F.col("__quota")).drop("__rank", "__quota")


def by_availability(rows: DataFrame, keys: list[str], n: int, source: str, trace: str, order: str = "ord") -> DataFrame:
    """The n rows of each key with most to show: source counts two, trace one; ties by order (O1)."""
    has = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0).cast("int")
    score = 2 * has(source) + has(trace)
    ranked = rows.withColumn("availability", score).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("availability"), order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def top_counts(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value (O2)."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
