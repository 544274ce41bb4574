"""Sinks and report formats (K1 to K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_cache(answers: DataFrame, path: str) -> None:
    answers.select("cache_key", "response").write.mode("append").parquet(path)


#: Heads of the comparison table.
HEADS = ["Project", "Cluster", "Method", "Sim", "Cosine", "BERT-F1", "Cat", "Correct"]


def comparison_table(rows: DataFrame) -> DataFrame:
    """place, project, cluster_id, method, line: a fixed-width table with head and rule, by project, cluster and method.

    rows has project, cluster_id, method, similarity, cosine, bert_f1, category_match,
    correctness.  Project names are cut to 15 characters, methods to 4, correctness to
    1.  One aggregation finds the widths; lines are padded where the rows are.
    """
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    cells = [F.substring("project", 1, 15), F.col("cluster_id").cast("string"), F.substring("method", 1, 4), F.col("similarity").cast("string"), two("cosine"), two("bert_f1"), F.when(F.col("category_match"), "✓").otherwise("✗"), F.substring("correctness", 1, 1)]
    shown = rows.select("project", "cluster_id", "method", *[F.coalesce(c, F.lit("")).alias(f"c{k}") for k, c in enumerate(cells)])
    widths = shown.agg(*[F.greatest(F.lit(len(h)), F.coalesce(F.max(F.length(f"c{k}")), F.lit(0))).alias(f"w{k}") for k, h in enumerate(HEADS)])
    pad = lambda c, k: F.rpad(c, F.col(f"w{k}"), F.lit(" "))
    body = shown.join(F.broadcast(widths), F.lit(True))  # one row of widths
    lines = body.select(F.lit(2).alias("place"), "project", "cluster_id", "method", F.concat_ws(" | ", *[pad(F.col(f"c{k}"), k) for k in range(len(HEADS))]).alias("line"))
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.select("project", "cluster_id", "method").dtypes]
    top = widths.select(F.lit(0).alias("place"), *none, F.concat_ws(" | ", *[pad(F.lit(h), k) for k, h in enumerate(HEADS)]).alias("line"))
    rule = widths.select(F.lit(1).alias("place"), *none, F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col(f"w{k}")) for k in range(len(HEADS))]).alias("line"))
    return top.unionByName(rule).unionByName(lines).orderBy("place", "project", "cluster_id", "method")


def markdown_metrics(scores: DataFrame, columns: list[str], by: str = "method") -> DataFrame:
    """One markdown line a method, three decimals."""
    cell = [F.format_string("%.3f", F.col(c)) for c in columns]
    return scores.select(by, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(by), *cell), F.lit(" |")).alias("line")).orderBy(by)


def latex_summary(summary: DataFrame, by: str = "method") -> DataFrame:
    """One LaTeX line a method: mean, std, median."""
    cell = [F.format_string("%.2f", F.col(c)) for c in ("mean", "std", "median")]
    return summary.select(by, F.concat(F.concat_ws(" & ", F.col(by), *cell), F.lit(" \\\\")).alias("line")).orderBy(by)


def report_lines(costs: DataFrame) -> DataFrame:
    """Text lines of a cost summary: the total, then models and components by cost."""
    label = F.when(F.col("model").isNotNull(), F.concat(F.lit("model "), "model")).when(F.col("component").isNotNull(), F.concat(F.lit("component "), "component")).otherwise("total")
    line = F.format_string("%s: %d calls, %d in, %d out, $%.4f", label, F.col("calls").cast("long"), F.col("tokens_in").cast("long"), F.col("tokens_out").cast("long"), F.col("cost"))
    rank = F.when(F.col("model").isNotNull(), 1).when(F.col("component").isNotNull(), 2).otherwise(0)
    return costs.select(rank.alias("part"), F.row_number().over(Window.partitionBy(rank).orderBy(F.desc("cost"), label)).alias("place"), line.alias("line")).orderBy("part", "place")
