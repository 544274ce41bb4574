"""BLEU, simplified CodeBLEU and the evaluation of repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions import code as C
from flakespark.functions.text import col, filled


def bleu4(pairs: DataFrame, key: str, generated: str, truth: str) -> DataFrame:
    """key, bleu: clipped precisions of orders 1 to 4, uniform weights, brevity penalty; any zero gives 0.

    All orders of both sides explode once, with the order in the key; one partial
    aggregation of (key, n, gram) counts both sides, so nothing is joined.
    """
    sides = pairs.select(key, C.tokenize(generated).alias("g"), C.tokenize(truth).alias("t"))
    def tagged(side: str, tag: int, n: int):
        return F.transform(C.ngrams(F.col(side), n), lambda x: F.struct(F.lit(n).alias("n"), x.alias("gram"), F.lit(tag).alias("side")))

    gram = lambda side, tag: F.flatten(F.array(*[tagged(side, tag, n) for n in (1, 2, 3, 4)]))
    grams = sides.select(key, F.explode(F.concat(gram("g", 0), gram("t", 1))).alias("x")).select(key, "x.*")
    counts = grams.groupBy(key, "n", "gram").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("t"))
    by_order = counts.groupBy(key, "n").agg(F.sum(F.least("g", "t")).alias("hit"), F.sum("g").alias("all"))
    logs = by_order.groupBy(key).agg(F.count_if(F.col("hit") > 0).alias("orders"), F.sum(F.when(F.col("hit") > 0, F.log(F.col("hit") / F.nullif(F.col("all"), F.lit(0))))).alias("logs"))
    sizes = sides.select(key, F.size("g").alias("c"), F.size("t").alias("r"))
    brevity = F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.nullif(F.col("c"), F.lit(0)))).otherwise(1.0)
    score = F.when(F.col("orders") == 4, F.least(F.lit(1.0), brevity * F.exp(F.col("logs") / 4))).otherwise(0.0)
    return sizes.join(logs, key, "left").select(key, F.coalesce(score, F.lit(0.0)).alias("bleu"))


def codebleu(pairs: DataFrame, key: str, generated: str, truth: str) -> DataFrame:
    """key, bleu, keyword, structure, codebleu = 0.5, 0.25 and 0.25 of them."""
    parts = pairs.select(key, C.keyword_match(generated, truth).alias("keyword"), C.structure_similarity(generated, truth).alias("structure"))
    scored = parts.join(bleu4(pairs, key, generated, truth), key)
    return scored.withColumn("codebleu", 0.5 * F.col("bleu") + 0.25 * F.col("keyword") + 0.25 * F.col("structure"))


def _scored(pairs: DataFrame, key: str, generated: Column, truth: Column) -> DataFrame:
    shown = pairs.select(key, generated.alias("g"), truth.alias("t"))
    edit = shown.select(key, C.edit_similarity("g", "t").alias("edit"), C.exact_match("g", "t").alias("exact"), filled("t").alias("has_truth"))
    return codebleu(shown, key, "g", "t").select(key, "bleu", "codebleu").join(edit, key)


def evaluate_repairs(pairs: DataFrame, key: str, generated: str, truth: str, truth_is_code: bool | None = None) -> DataFrame:
    """key, bleu, codebleu, edit, exact, has_truth of each repair.

    Of a side that is a diff only the added lines are compared; a side that is code is
    left alone.  truth_is_code says what the truth is (None: its beginning tells).
    Null texts are empty; empty truth is scored too and flagged.
    """
    t, g = F.coalesce(col(truth), F.lit("")), F.coalesce(col(generated), F.lit(""))
    as_diff = C.truth_is_diff(t) if truth_is_code is None else F.lit(not truth_is_code)
    return _scored(pairs, key, F.when(C.generated_is_diff(g), C.added_lines(g)).otherwise(g), F.when(as_diff, C.added_lines(t)).otherwise(t))


def evaluate_added_lines(pairs: DataFrame, key: str, generated: str, truth: str) -> DataFrame:
    """As evaluate_repairs where the truth is always a diff, of which the added lines count."""
    return evaluate_repairs(pairs, key, generated, truth, truth_is_code=False)


def evaluate_diffs(pairs: DataFrame, key: str, generated: str, truth: str) -> DataFrame:
    """As evaluate_repairs, of two diffs by their added and removed lines with their signs."""
    return _scored(pairs, key, C.normalise_diff(generated), C.normalise_diff(truth))


def average_repairs(evals: DataFrame, by: list[str]) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return evals.groupBy(*by).agg(mean("bleu"), mean("codebleu"), mean("edit"), F.count("*").alias("n"))
