"""File sources on generated trees, sinks, the model seam and the stream."""

import base64
import json

from pyspark.sql import functions as F

from flakespark.operators import ledger, model, stats
from flakespark.sources import files, pulls, sinks
from flakespark.streaming import ledger as streaming


def tree(root):
    def put(path, text):
        path = root / path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("manual_analysis/p1/cluster2/info.txt", "test_names:\n a.A#x \n\na.B#y\nrun_ids:\n7\nnope\n8\n")
    put("manual_analysis/p1/cluster2/cluster_form.txt", "Q1. What?\n...\nQ3. Why? this is dropped\n dns \nmore\nQ1. What?\nagain\n")
    put("manual_analysis/p1/cluster10/info.txt", "test_names:\na.C#z\nrun_ids:\n")
    put("manual_analysis/p1/clusterX/info.txt", "test_names:\nno\n")
    put("manual_analysis/p1/cluster2/traces0/sample2.txt", "no marker ")
    put("manual_analysis/p1/cluster2/traces0/sample1.txt", "head\ntrace_text: java.E: m\n\tat x.y.Z.q(Z.java)\ntrace_text: again")
    put("sources/p1/flakyMethods/a.A-x.java", "class A {}")
    return str(root)


def test_tree(spark, tmp_path):
    clusters, tests = files.read_clusters(spark, tree(tmp_path))
    got = {r.cluster_id: r for r in clusters.collect()}
    assert sorted(got) == [2, 10] and got[2].names == ["a.A#x", "a.B#y"] and got[2].run_ids == [7, 8]
    assert (got[2].q1, got[2].q3, got[2].q2, got[10].q3) == ("again", "dns\nmore", None, None)
    rows = {r.test_name: r for r in tests.collect()}
    assert rows["a.A#x"].source_code == "class A {}" and rows["a.A#x"].stack_traces[0].startswith("java.E: m") and rows["a.A#x"].stack_traces[1] == "no marker"
    assert rows["a.B#y"].stack_traces is None
    assert files.read_clusters(spark, str(tmp_path), need_cause=True)[0].count() == 1
    assert files.flatten_tests(tests).where("test_name = 'a.A#x'").first().trace.startswith("java.E")


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(f'"{c}"' for c in files.CSV_COLUMNS) + '\nhttps://github.com/o/r,abc,m,x.T#t,ID,Accepted,,"two\nlines"\nhttps://github.com/o/q/,d,m,x.U#u,OD,Weird,,\n')
    fixes = files.read_fix_list(spark, str(tmp_path / "a.csv")).withColumn("ord", F.when(F.col("Category") == "ID", 0).otherwise(1))
    got = {r.sample_id: r for r in files.fix_samples(fixes).collect()}
    assert got["idoft_0000"].project_name == "o-r" and got["idoft_0000"].test_method == "t" and got["idoft_0001"].status == "Unknown"
    sample = {"sample_id": "s1", "project_name": "p", "test_name": "x.T#t", "test_code_after": "class T { void t() { a(); } }"}
    (tmp_path / "s.json").write_text(json.dumps({"samples": [sample, {"sample_id": "s2", "project_name": "q", "ground_truth_diff": "+a"}, {"sample_id": "s3", "project_name": "p"}]}))
    samples = files.read_samples(spark, str(tmp_path / "s.json"))
    truth = {r.sample_id: r.ground_truth for r in samples.collect()}
    assert truth["s1"].endswith("void t() { a(); }") or "void t()" in truth["s1"]
    assert (truth["s2"], truth["s3"]) == ("+a", "")
    (tmp_path / "c.json").write_text(json.dumps({"clusters": {"c1": ["s1", "gone"], "c2": ["gone"]}}))
    assert [tuple(r) for r in files.read_cluster_map(spark, str(tmp_path / "c.json"), samples).select("cluster", "sample_id").collect()] == [("c1", "s1")]
    assert {r.cluster for r in files.project_clusters(samples).collect()} == {"project_0_p", "project_1_q"}


def test_pulls(spark):
    samples = spark.createDataFrame([("s", "o.T#t", "https://github.com/a/b/pull/3")], "sample_id string, test_name string, pr_link string")
    landed = spark.createDataFrame([("a", "b", 3, 0, "README.md", ""), ("a", "b", 3, 1, "src/test/T.java", "+x")], "owner string, repo string, number long, ord int, filename string, patch string")
    meta = spark.createDataFrame([("a", "b", 3, "s0", "s1")], "owner string, repo string, number long, base_sha string, head_sha string")
    body = spark.createDataFrame([("a", "b", "s1", "src/test/T.java", base64.encodebytes("é".encode()).decode())], "owner string, repo string, sha string, filename string, content string")
    got = pulls.repair_pairs(samples, landed, meta, body).first()
    assert (got.path, got.before, got.after, got.diff) == ("src/test/T.java", None, "é", "+x")
    assert pulls.missing_pulls(samples, meta).count() == 0


def test_model_seam(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a file"), (2, "a file"), (3, None)], "id int, prompt string")
    answered = model.generate(rows)
    assert answered.count() == 3 and answered.where("response is null").count() == 0
    sinks.append_cache(answered.dropDuplicates(["cache_key"]), str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    calls = []

    def refuse(prompt, system):
        raise AssertionError("the cache has every answer")

    assert model.generate(rows, refuse, cache).where("response is null").count() == 0
    waits = []

    def flaky(prompt, system):
        calls.append(prompt)
        if len(calls) < 3:
            raise model.RateLimited
        return "ok"

    assert model.with_retry(flaky, base=2.0, sleep=waits.append)("p") == "ok" and waits == [2.0, 4.0]


def test_reports(spark):
    rows = spark.createDataFrame([("project-with-a-long-name", 1, "individual", 4, 0.5, None, True, "Yes", 0.5), ("a", 2, "collective", 3, 0.256, 0.1, False, "Partial", 0.25)], "project string, cluster_id int, method string, similarity int, cosine double, bert_f1 double, category_match boolean, correctness string, score double")
    lines = [r.line for r in sinks.comparison_table(rows).collect()]
    assert len(set(map(len, lines))) == 1 and len(lines) == 4 and lines[0].startswith("Project         | Cluster | Method | Sim | Cosine | BERT-F1 | Cat | Correct")
    assert lines[1].startswith("----------------+-") and lines[2].startswith("a               | 2       | coll   | 3   | 0.26   | 0.10    | ✗   | P") and lines[3].startswith("project-with-a- | 1 ")
    summary = stats.method_summary(rows, ["method"], "score")
    assert sinks.latex_summary(summary).first().line == "collective & 0.25 & 0.00 & 0.25 \\\\"
    assert sinks.markdown_metrics(summary, ["mean"]).first().line == "| collective | 0.250 |"


def test_stream_equals_batch(spark, tmp_path):
    spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("gpt-4o").alias("model"), (F.col("id") % 3).cast("string").alias("component"), F.col("id").alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_costs(stream).writeStream.format("memory").queryName("costs").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.component, r.calls, round(r.cost, 9)) for r in df.collect())
    assert key(spark.table("costs")) == key(streaming.windowed_costs(spark.read.parquet(str(tmp_path / "in"))))
    assert ledger.cache_stats(spark.createDataFrame([], "hit boolean")).first().hit_rate == 0
