"""Input views over the supplied tables, built from expressions that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Exception types and message words of the failures view, by order key.
TYPES = ["java.net.UnknownHostException", "java.net.SocketTimeoutException", "java.io.IOException", "java.io.FileNotFoundException", "java.util.concurrent.TimeoutException", "java.lang.InterruptedException", "java.lang.NoClassDefFoundError", "java.lang.OutOfMemoryError", "java.lang.AssertionError", "org.custom.MyException", "Caused by", "java.lang.RuntimeException"]
MESSAGES = ["Connection refused", "no such file or directory", "thread died", "value was null", "deadline passed", "class not found", "heap exhausted"]
SOURCES = ["Socket s = new Socket(host);", "File f = new File(name);", "executor.submit(task);", "Thread.sleep(10);", "verify(mock);", "int y = 2;"]
LABELS = ["Networking", "Filesystem", "Timeout", "Concurrency", "Configuration", "Resource", "Assertion", "Other", "Unknown"]


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {whens} END"


_FRAME = "chr(10), chr(9), 'at org.app.mod', CAST(o_orderkey % 4 AS {s}), '.Svc', CAST(o_orderkey % 9 AS {s}), '.run(Svc.java:', CAST(o_orderkey % 97 AS {s}), ')'"
_STANDARD = "chr(10), chr(9), 'at java.util.Queue.poll(Queue.java:7)', chr(10), chr(9), 'at org.junit.Runner.run(Runner.java:9)'"


def failures_sql(s: str) -> str:
    """The failures view; s is the engine's name of the string type."""
    return f"""
SELECT o_orderkey AS ord, concat('org.app.C', CAST(o_custkey % 50 AS {s}), '#t', CAST(o_orderkey AS {s})) AS test_name,
  c_mktsegment AS project, c_nationkey AS true_label,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat({_case('o_orderkey', TYPES)}, ': ', {_case('o_orderkey', MESSAGES)}, ' ', o_orderpriority, {_FRAME.format(s=s)}, {_STANDARD}) END AS trace,
  CASE WHEN o_orderkey % 6 = 0 THEN {_case('CAST(floor(o_orderkey / 6) AS BIGINT)', SOURCES)} END AS source
FROM orders JOIN customer ON o_custkey = c_custkey"""


SCORED = """
SELECT d.doc_id, d.source AS method, d.lang AS project,
  CASE l.quality WHEN 1 THEN 'Yes' ELSE 'No' END AS actual,
  CASE WHEN l.toxic = 1 THEN 'No' WHEN d.n_chars > 400 THEN 'Yes' ELSE 'Partial' END AS predicted,
  CAST(d.n_chars % 5 + 1 AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

RUNS = """
SELECT CAST(l_linenumber AS BIGINT) AS run, l_suppkey AS cluster_id, l_returnflag AS method, l_quantity AS score, l_discount AS cosine, l_tax AS bleu
FROM lineitem"""

CALLS = """
SELECT event_id, ts, event_type AS component,
  CASE user_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'deepseek-chat' WHEN 3 THEN 'llama-3.1-8b-instant' ELSE 'unlisted' END AS model,
  event_id % 1000 AS tokens_in, CAST(floor(abs(value)) AS BIGINT) AS tokens_out
FROM events"""

RATERS = """
SELECT l_orderkey * 10 + l_linenumber AS item, CAST(l_partkey % 5 + 1 AS INT) AS r1,
  CAST((CASE WHEN l_suppkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END) % 5 + 1 AS INT) AS r2,
  CAST((CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey ELSE l_partkey END) % 5 + 1 AS INT) AS r3
FROM lineitem"""

#: p_name is ASCII, so both engines count the same edit distances.
PAIRS = """
SELECT a.p_partkey AS id, concat('void t() { return ', a.p_name, ' + ', a.p_brand, '; }') AS generated, concat('void t() { return ', b.p_name, ' + ', b.p_brand, '; }') AS truth
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""

VIEWS = {"scored": SCORED, "runs": RUNS, "calls": CALLS, "raters": RATERS, "pairs": PAIRS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are bound to the folder, not to the catalog's names."""
    sql = failures_sql("STRING") if name == "failures" else VIEWS[name]
    used = [t for t in ("orders", "customer", "documents", "labels", "lineitem", "events", "part") if f" {t}" in sql]
    return spark.sql(_bound(sql, used), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _bound(sql: str, tables: list[str]) -> str:
    import re

    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def duck(name: str) -> str:
    """The same view as a DuckDB common table expression."""
    return f"{name} AS ({failures_sql('VARCHAR') if name == 'failures' else VIEWS[name]})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
