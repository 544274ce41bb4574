"""The model seam: prompts in, replies out, with cache, throttle and retry.

A client is any picklable callable (prompt, system) -> text.  Nothing here reaches a
network: the default client is deterministic and answers from the prompt's own words.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions.replies import cache_key
from flakespark.functions.text import col

Client = Callable[[str, str], str]


class RateLimited(Exception):
    """A provider asks to wait."""


def offline_client(prompt: str, system: str = "") -> str:
    """A stand-in whose reply follows from the prompt: verdict, score and category lines."""
    words = prompt.lower().split()
    names = [("Networking", "connection"), ("Filesystem", "file"), ("Concurrency", "thread"), ("Timing", "timeout"), ("Resource", "memory")]
    category = next((c for c, w in names if any(w in x for x in words)), "Other")
    return f"CATEGORY: {category}\nVERDICT: {'YES' if len(words) % 3 else 'NO'}\nCONFIDENCE: {'HIGH' if len(words) % 2 else 'LOW'}\nSIMILARITY_SCORE: {1 + len(words) % 5}\nCORRECTNESS: {('Yes', 'No', 'Partial')[len(words) % 3]}\nROOT_CAUSE: {category.lower()}\nSPLIT_SUGGESTION: none\nREASONING: {len(words)} words"


#: Clients by provider name; real ones are registered by the user.
PROVIDERS: dict[str, Client] = {"offline": offline_client}


def with_retry(client: Client, attempts: int = 3, base: float = 1.0, interval: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Client:
    """Waits base * 2^k after a rate limit and 2^k after another error; the last error is raised, a last rate limit gives ''."""

    def call(prompt: str, system: str = "") -> str:
        for k in range(attempts):
            try:
                if interval:
                    sleep(interval)
                return client(prompt, system)
            except RateLimited:
                if k == attempts - 1:
                    return ""
                sleep(base * 2**k)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(2.0**k)
        return ""

    return call


def generate(requests: DataFrame, client: Client = offline_client, cache: DataFrame | None = None, model: str = "offline", system: str = "", prompt: str = "prompt", parallelism: int | None = None) -> DataFrame:
    """Adds cache_key and response.  Equal prompts are asked once; the cache's answers are not asked again.

    parallelism bounds the calls in flight.  Replies are persisted on disk.  Row order and repeats do not matter.
    """
    keyed = requests.withColumn("cache_key", cache_key(F.lit(model), F.lit(system), prompt))
    asked = keyed.select("cache_key", F.col(prompt).alias("__prompt")).dropDuplicates(["cache_key"])
    known = None
    if cache is not None:
        known = cache.select("cache_key", "response")
        asked = asked.join(known, "cache_key", "left_anti")
    if parallelism:
        asked = asked.coalesce(parallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "response": [client(p or "", system) for p in pdf["__prompt"]]})

    # kept, so that later steps reuse the replies and do not call again
    answers = asked.mapInPandas(run, "cache_key string, response string").persist(StorageLevel.DISK_ONLY)
    if known is not None:
        answers = answers.unionByName(known)
    return keyed.join(answers, "cache_key", "left")


def numbered(items: Column | str, most: int = 10) -> Column:
    """'1. a\\n2. b': the first items of an array as a list."""
    return F.array_join(F.transform(F.slice(col(items), 1, most), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")


def individual_prompt(name: Column | str, trace: Column | str, source: Column | str) -> Column:
    part = lambda head, x, n: F.when(F.coalesce(F.length(col(x)), F.lit(0)) > 0, F.concat(F.lit(head), F.substring(col(x), 1, n))).otherwise("")
    return F.concat(F.lit("Why does this test fail now and then?\nTest: "), col(name), part("\nTrace:\n", trace, 800), part("\nSource:\n", source, 600))


def collective_prompts(tests: DataFrame, cluster: str = "cluster_id", name: str = "test_name", trace: str = "trace", order: str = "ord", most: int = 10) -> DataFrame:
    """One prompt a cluster from its first tests by order (L6, L8); the rank limit bounds what is gathered."""
    from .grouping import first_n

    few = first_n(tests, most, [cluster], order)
    row = F.struct(F.col(order).alias("o"), F.concat(F.col(name), F.lit(": "), F.substring(F.coalesce(F.col(trace), F.lit("no trace")), 1, 200)).alias("t"))
    listed = few.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]).alias("items"))
    return listed.select(cluster, F.concat(F.lit("Do these failures share one cause?\n"), numbered("items", most)).alias("prompt"))


def diagnose(tests: DataFrame, client: Client = offline_client, cluster: str = "cluster_id", order: str = "ord", most: int = 10) -> DataFrame:
    """Individual then aggregate diagnosis of each cluster (L5): a call a test, and one on their answers unless there is one alone."""
    from .grouping import first_n

    few = first_n(tests, most, [cluster], order).withColumn("prompt", individual_prompt("test_name", "trace", "source"))
    single = generate(few, client)
    gathered = single.groupBy(cluster).agg(F.count("*").alias("n_tests"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "response"))), lambda x: x["response"]).alias("parts"))
    many = gathered.where("n_tests > 1").withColumn("prompt", F.concat(F.lit("Summarise these diagnoses:\n"), numbered("parts", most)))
    asked = generate(many, client).select(cluster, "n_tests", "parts", F.col("response").alias("diagnosis"))
    return asked.unionByName(gathered.where("n_tests = 1").select(cluster, "n_tests", "parts", F.get("parts", F.lit(0)).alias("diagnosis")))
