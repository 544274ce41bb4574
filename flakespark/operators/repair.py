"""Repair generation by three methods and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakespark.functions.replies import code_block
from flakespark.operators import model, textmetrics
from flakespark.operators.grouping import first_n

TASK = "Repair this test so that it no longer fails now and then. Answer with the method alone.\n"


def _sample_prompt(*more):
    head = F.concat(F.lit(TASK), F.lit("Test: "), "test_name", F.lit("\nCategory: "), F.coalesce("category", F.lit("unknown")), F.lit("\nCode:\n"), F.coalesce("code", F.lit("")))
    return F.concat(head, *more) if more else head


def _repairs(asked: DataFrame, method: str, client) -> DataFrame:
    return model.generate(asked, client).select(F.lit(method).alias("method"), "sample_id", code_block("response").alias("generated"))


def zero_shot(samples: DataFrame, client=model.offline_client) -> DataFrame:
    """method, sample_id, generated from sample_id, test_name, category, code."""
    return _repairs(samples.withColumn("prompt", _sample_prompt()), "zero_shot", client)


def individual(samples: DataFrame, client=model.offline_client) -> DataFrame:
    """Diagnoses each sample by itself, then asks for a repair with the diagnosis."""
    asked = samples.withColumn("prompt", model.individual_prompt("test_name", F.lit(None).cast("string"), "code"))
    told = model.generate(asked, client).withColumnRenamed("response", "diagnosis").drop("prompt", "cache_key")
    return _repairs(told.withColumn("prompt", _sample_prompt(F.lit("\nDiagnosis:\n"), F.col("diagnosis"))), "individual", client)


def collective(samples: DataFrame, members: DataFrame, client=model.offline_client, most: int = 5) -> DataFrame:
    """One diagnosis a cluster from its first samples, shared by the repairs of all its members.

    members: cluster, sample_id; samples that no cluster holds are not repaired here.
    """
    placed = samples.join(members, "sample_id")
    prompts = model.collective_prompts(placed.withColumn("trace", F.col("code")), "cluster", "test_name", "trace", "sample_id", most)
    told = model.generate(prompts, client).select("cluster", F.col("response").alias("diagnosis"))
    return _repairs(placed.join(told, "cluster").withColumn("prompt", _sample_prompt(F.lit("\nShared cause:\n"), F.col("diagnosis"))), "collective", client)


def compare_methods(samples: DataFrame, members: DataFrame, client=model.offline_client) -> DataFrame:
    """method, bleu, codebleu, edit, n, all methods in one evaluation; a sample without ground_truth is scored against an empty one."""
    made = zero_shot(samples, client).unionByName(individual(samples, client)).unionByName(collective(samples, members, client))
    truth = samples.select("sample_id", "ground_truth")
    pairs = made.join(truth, "sample_id").withColumn("key", F.concat_ws("|", "method", "sample_id"))
    scored = textmetrics.evaluate_repairs(pairs, "key", "generated", "ground_truth")
    return textmetrics.average_repairs(scored.withColumn("method", F.substring_index("key", "|", 1)), ["method"])


def members_of(clusters: DataFrame, chosen: DataFrame, least: int = 2) -> DataFrame:
    """Cluster members restricted to chosen samples, clusters under `least` dropped."""
    kept = clusters.join(chosen.select("sample_id"), "sample_id", "left_semi")
    sizes = kept.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return kept.join(sizes.select("cluster"), "cluster", "left_semi")


def other_tests(members: DataFrame, most: int = 5) -> DataFrame:
    """Each sample with the first other members of its cluster (U6), bounded before they are gathered."""
    few = first_n(members, most + 1, ["cluster"], "sample_id").groupBy("cluster").agg(F.sort_array(F.collect_list("sample_id")).alias("some"))
    return members.join(few, "cluster").select("cluster", "sample_id", F.slice(F.array_remove("some", F.col("sample_id")), 1, most).alias("others"))
