"""All groupings of one set of tests in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakespark.functions import names, replies, signatures
from flakespark.operators import grouping, model

#: Tests in one question to the model.
BATCH = 20


def model_groups(tests: DataFrame, client: model.Client = model.offline_client, size: int = BATCH, order: str = "ord", name: str = "test_name", trace: str = "trace") -> DataFrame:
    """test_name, cluster_id: batches of tests by order, each grouped by one reply of the model.

    A test that a batch's reply does not name stands alone, and so does every test of a
    batch without an answer.  Ids follow the first test of a group.
    """
    placed = grouping.positions(tests, [F.col(order)], [], "__place")
    batch = placed.select(F.floor(F.col("__place") / size).cast("long").alias("batch"), (F.col("__place") % size + 1).cast("int").alias("member"), F.col(name).alias("test_name"), F.col(order).alias("ord"), F.col(trace).alias("trace"))
    line = F.concat(F.col("member").cast("string"), F.lit(". "), "test_name", F.lit(": "), F.substring(F.coalesce("trace", F.lit("no trace")), 1, 200))
    listed = batch.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("member", line.alias("line")))).alias("lines"))
    prompts = listed.select("batch", F.concat(F.lit("Which of these failures share a cause? Answer with lines such as 'Group 1: 1, 3'.\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))
    answers = model.generate(prompts, client)
    groups = answers.select("batch", F.posexplode(replies.group_lines(F.coalesce("response", F.lit("")))).alias("line", "members"))
    named = grouping.group_reply(batch.select("batch", "member", "test_name", "ord"), groups, ["batch"])
    key = F.concat_ws("|", F.col("batch").cast("string"), "group_key")
    return grouping.first_seen_groups(named, key).select("test_name", "cluster_id")


def run_all(tests: DataFrame, k: int, client: model.Client | None = None, linked: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """method, test_name, cluster_id of every baseline and of the signature.

    tests: features with test_name, ord, simple_name, project, category (and trace for the
    model).  k is the number of random groups.  The model's groups are left out without a
    client, those by vectors without linked (test_name, cluster_id as vectors.linkage_groups gives them).
    """
    kind = F.when(F.col("simple_name") != "", F.col("simple_name")).otherwise("Unknown")
    made = {
        "random": grouping.random_groups(tests, k, seed),
        "test_class": grouping.first_seen_groups(tests, names.grouping_class("test_name")),
        "exception_type": grouping.first_seen_groups(tests, kind),
    }
    if linked is not None:
        made["embedding"] = linked
    if client is not None:
        made["model"] = model_groups(tests, client)
    made["signature"] = grouping.first_seen_groups(tests, signatures.default_signature())
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("method"), "test_name", "cluster_id") for m, df in made.items()])

