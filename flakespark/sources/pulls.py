"""Pull requests as landed tables: files, contents, repair pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions import names
from flakespark.functions.text import col

KEY = ["owner", "repo", "number"]


def decoded(content: Column | str) -> Column:
    """Text of base64 content as an API lands it, line breaks and all."""
    return F.decode(F.unbase64(F.regexp_replace(col(content), r"\s", "")), "UTF-8")


def first_test_file(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Of each sample's pull request the first relevant file by its place.

    samples: sample_id, test_name, pr_link; files: owner, repo, number, ord, filename, patch.
    """
    parsed = samples.withColumn("pr", names.pull_request("pr_link")).where("pr is not null").select("sample_id", "test_name", "pr.*")
    joined = parsed.join(files, KEY).where(names.relevant_file("filename", "test_name"))
    return joined.groupBy("sample_id").agg(F.min_by(F.struct("filename", "patch", *KEY), "ord").alias("f")).select("sample_id", "f.*")


def repair_pairs(samples: DataFrame, files: DataFrame, metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """sample_id, path, before, after, diff with base and head revisions.

    metadata: key, base_sha, head_sha; contents: owner, repo, sha, filename, content.
    """
    chosen = first_test_file(samples, files).join(metadata, KEY)
    text = contents.select("owner", "repo", "sha", "filename", decoded("content").alias("code"))
    at = lambda sha, out: text.select("owner", "repo", F.col("sha").alias(sha), "filename", F.col("code").alias(out))
    paired = chosen.join(at("base_sha", "before"), ["owner", "repo", "base_sha", "filename"], "left").join(at("head_sha", "after"), ["owner", "repo", "head_sha", "filename"], "left")
    return paired.select("sample_id", F.col("filename").alias("path"), "before", "after", F.col("patch").alias("diff"), *KEY, "base_sha", "head_sha")


def missing_pulls(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """Pull requests that the cache table (owner, repo, number, ...) does not hold."""
    wanted = samples.select(names.pull_request("pr_link").alias("pr")).where("pr is not null").select("pr.*").distinct()
    return wanted.join(cache.select(*KEY), KEY, "left_anti")
