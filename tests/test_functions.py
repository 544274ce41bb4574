"""Unit pairs of the scalar functions and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from flakespark.functions import cascade, code, names, replies, traces
from flakespark.operators import agreement, classify, grouping, ledger, partition_metrics, sampling, stats, textmetrics
from flakespark.operators.javacode import method_of, profile


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    "kind, message, category, tier",
    [
        ("java.net.UnknownHostException", "Temporary failure in name resolution", "Networking", 1),
        ("java.io.FileNotFoundException", "/tmp/test.txt (No such file or directory)", "Filesystem", 1),
        ("java.lang.NoClassDefFoundError", "Could not initialize class X", "Configuration", 1),
        ("java.io.IOException", "Connection refused", "Networking", 2),
        ("org.custom.MyException", "Something went wrong", "Other", 3),
        ("java.net.SocketTimeoutException", "any", "Timeout", 1),
        ("x.FooException", "thread died", "Filesystem", 2),
    ],
)
def test_cascade(spark, kind, message, category, tier):
    got = one(spark, c=cascade.categorise(F.lit(kind), F.lit(message), F.lit("trace"), F.lit(None).cast("string")))
    assert tuple(got.c) == (category, tier)


def test_cascade_without_trace(spark):
    got = one(spark, a=cascade.categorise(F.lit(""), F.lit(""), F.lit(""), F.lit("Thread.sleep(1)")), b=cascade.categorise(F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit("")), c=cascade.categorise(F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit("zzz")))
    assert tuple(got.a) == ("Concurrency", 4) and tuple(got.b) == ("Unknown", 0) and tuple(got.c) == ("Unknown", 4)


def test_traces(spark):
    t = " \ncom.a.B: x: y \n\tat com.foo.Bar$Inner.run(B.java:1)\n\tat org.junit.X.y(X.java)\n\tat com.zed.Q.r(Q.java:2)"
    got = one(spark, kind=traces.exception_type(F.lit(t)), message=traces.exception_message(F.lit(t)), keys=traces.key_classes(F.lit(t)), depth=traces.stack_depth(F.lit(t)), cause=traces.exception_type(F.lit("Caused by: a.B: m")), plain=traces.exception_type(F.lit("Caused by: a.B: m"), False), none=traces.exception_type(F.lit(None).cast("string")), said=traces.exception_message(F.lit("Caused by: a.B: m")))
    assert (got.kind, got.message, got.keys, got.depth) == ("com.a.B", "x: y", ["com.foo", "com.zed.Q"], 3)
    assert (got.cause, got.said, got.plain, got.none) == ("", "a.B: m", "Caused by", "")


def test_names(spark):
    rows = spark.createDataFrame([("org.e.A#t",), ("org.e.A.t",), ("t",), ("a#b#c",)], "n string")
    got = rows.select(names.class_name("n"), names.method_name("n"), names.grouping_class("n")).collect()
    assert [tuple(r) for r in got] == [("org.e.A", "t", "org.e.A"), ("org.e.A", "t", "org.e.A"), ("t", "t", "t"), ("a", "b", "a#b")]
    got = one(spark, a=names.project_name(F.lit("https://github.com/apache/hbase/")), b=names.project_name(F.lit("x")), c=names.pull_request(F.lit("https://github.com/apache/hbase/pull/123/")), d=names.pull_request(F.lit("https://github.com/apache/hbase")), e=names.status(F.lit("")), f=names.status(F.lit("Opened")), g=names.cache_key(F.lit("apache"), F.lit("hbase"), F.lit(123)))
    assert (got.a, got.b, tuple(got.c), got.d, got.e, got.f, got.g) == ("apache-hbase", "x", ("apache", "hbase", 123), None, "Unknown", "Opened", "apache_hbase_123")
    files = spark.createDataFrame([("src/test/java/org/example/TestClass.java",), ("README.md",), ("src/main/java/org/example/Other.java",)], "p string")
    assert [r.p for r in files.where(names.relevant_file("p", F.lit("org.example.TestClass#m"))).collect()] == ["src/test/java/org/example/TestClass.java"]


def test_replies(spark):
    reply = "x\n verdict: no, not YES?\nCONFIDENCE: High\nROOT_CAUSE: dns\nSPLIT_SUGGESTION: Tests 1,2; 3 | none\nREASONING: r"
    got = one(spark, v=replies.verdict(F.lit(reply)), d=replies.verdict(F.lit("")), s=replies.similarity_score(F.lit("SIMILARITY_SCORE: 9\nSIMILARITY_SCORE: 0")), t=replies.similarity_score(F.lit("")), g=replies.group_lines(F.lit("Group 1: [1, 2]\nrest\nGroup 2: 5")), b=replies.batch_answers(F.lit("[1] Networking\n[2] Other")), c=replies.code_block(F.lit("a\n```java\nint x;\n```\nb")), f=replies.code_block(F.lit("```\ny\n```")), n=replies.code_block(F.lit(" z ")), k=replies.split_groups(F.lit("n/a")), m=replies.diagnosis_category(F.lit("an external dependency")), p=replies.specificity(F.lit("7")), q=replies.specificity(F.lit("x")))
    assert tuple(got.v) == ("Yes", "High", "dns", [["1", "2"], ["3"]], "r") and tuple(got.d)[:2] == ("Yes", "Medium")
    assert (got.s, got.t, got.g, [tuple(x) for x in got.b]) == (1, 3, [[1, 2], [5]], [(1, "Networking"), (2, "Other")])
    assert (got.c, got.f, got.n, got.k, got.m, got.p, got.q) == ("int x;", "y", "z", None, "External Dependency", 3, 2)


def test_code(spark):
    got = one(spark, n=code.normalise_code(F.lit("  @Test\r\n\n  void t() {\r}")), e=code.exact_match(F.lit(" a\n"), F.lit("a")), t=code.tokenize(F.lit("public void test() { return x + 1; }")), s=F.array(*[code.valid_syntax(F.lit(x)) for x in ("void t() { x(); }", "void t(int a) {}", "void t() { x(; }", "void t() {", "text", "void t() {)}")]), i=F.array(*[code.edit_similarity(F.lit(a), F.lit(b)) for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "xyz"), ("", ""))]))
    assert (got.n, got.e) == ("@Test\nvoid t() {\n}", True) and {"public", "void", "test", "(", ")", "{", "return", "+"} <= set(got.t)
    assert got.s == [True, True, False, False, False, False] and got.i[0] == 1 and 0.6 < got.i[1] < 0.7 and got.i[2] == 0 and got.i[3] == 1


def test_bleu(spark):
    pairs = spark.createDataFrame([(1, "public void methodA() { return 1; }", "public void methodA() { return 1; }"), (2, "", "a b c d"), (3, "public void testA() { assertEquals(1, x); }", "public void testB() { assertEquals(2, x); }"), (4, "a b", "a b")], "id int, g string, t string")
    got = {r.id: r for r in textmetrics.codebleu(pairs, "id", "g", "t").collect()}
    assert got[1].bleu > 0.99 and got[1].codebleu > 0.95 and got[2].bleu == 0 and got[4].bleu == 0 and 0.5 < got[3].codebleu < 1


def test_partition_scores(spark):
    truth = [0, 0, 0, 1, 1, 2, 2, 2]
    other = [0, 1, 2, 0, 1, 2, 0, 1]
    rows = [("same", a, a) for a in truth] + [("other", b, a) for a, b in zip(truth, other)] + [("null", None, 1), ("one", 1, 1)]
    got = {r.m: r for r in partition_metrics.partition_scores(spark.createDataFrame(rows, "m string, predicted int, actual int"), ["m"]).collect()}
    assert all(abs(x - 1) < 1e-12 for x in (got["same"].ari, got["same"].nmi, got["same"].purity, got["same"].v_measure))
    assert abs(got["other"].ari + 1 / 3) < 1e-9 and abs(got["other"].nmi - 0.078497) < 1e-6 and got["other"].purity == 0.375
    assert "null" not in got and (got["one"].ari, got["one"].nmi, got["one"].v_measure) == (0, 0, 1)


RATERS = [
    "51545255544344545335542243525543323314515554555455555554",
    "51535145443232545445321143525544431112515554545455544354",
    "31535155332222544445421144415433331113515555555355444442",
]


def test_agreement(spark):
    rows = [(k, *(int(r[k]) for r in RATERS)) for k in range(56)]
    df = spark.createDataFrame(rows, "item int, r1 int, r2 int, r3 int")
    long = df.select("item", F.explode(F.array("r1", "r2", "r3")).alias("s"))
    assert abs(agreement.fleiss_kappa(long, "item", "s").first().fleiss - 0.3599390418135061) < 1e-12
    got = [agreement.pair_agreement(df, a, b, [1, 2, 3, 4, 5]).first() for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3"))]
    mean = lambda k: sum(g[k] for g in got) / 3
    assert abs(mean("kappa_linear") - 0.6085683228461323) < 1e-12 and abs(mean("exact") - 0.5238095238095238) < 1e-12
    assert abs(mean("adjacent") - 0.8928571428571429) < 1e-12 and abs(mean("spearman") - 0.8169766220852038) < 1e-12


def test_cost(spark):
    calls = spark.createDataFrame([("gpt-4o", "x", 70440, 7759), ("nobody", "x", 5, 5)], "model string, component string, tokens_in long, tokens_out long")
    total = ledger.costs(calls).where("model is null and component is null").first()
    assert total.cost == 0.2537 and total.calls == 2


def test_sampling(spark):
    rows = spark.createDataFrame([(k, "ID" if k < 100 else "OD" if k < 150 else "NOD" if k < 180 else "X") for k in range(190)], "id int, c string")
    got = {r.c: r["count"] for r in sampling.stratified(rows, "c", {"ID": 20, "OD": 10, "NOD": 5, "UD": 3}).groupBy("c").count().collect()}
    assert got == {"ID": 20, "OD": 10, "NOD": 5}
    tests = spark.createDataFrame([(k % 10, f"t{k}") for k in range(200)] + [(99, "alone")], "cluster_id long, test_name string")
    sizes = [r["count"] for r in sampling.cluster_sample(tests, 50).groupBy("cluster_id").count().collect()]
    assert sum(sizes) <= 50 and min(sizes) >= 1
    assert sampling.cluster_sample(tests, 500).count() == 200


def test_statistics(spark):
    assert abs(stats.t_p_value(2.0, 10) - 0.07338803) < 1e-7 and abs(stats.t_p_value(0.0, 5) - 1) < 1e-9 and abs(stats.t_p_value(12.706204736, 1) - 0.05) < 1e-8
    assert abs(stats.normal_p_value(1.959964) - 0.05) < 1e-6
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in ((5, 3), (4, 4), (6, 2), (7, 5), (3, 6))], "a double, b double")
    got = stats.paired_tests(pairs, "a", "b", []).first()
    assert got.n == 5 and got.w == 3.0 and abs(got.t - 1.0 / (math.sqrt(7.0) / math.sqrt(5))) < 1e-9


def test_groups(spark):
    rows = spark.createDataFrame([(0, "org.example.TestA#test1"), (1, "org.example.TestB#test1"), (2, "org.example.TestA#test2")], "ord int, test_name string")
    got = {r.test_name: r.cluster_id for r in grouping.first_seen_groups(rows, names.grouping_class("test_name")).collect()}
    assert list(got.values()).count(0) == 2 and got["org.example.TestB#test1"] == 1
    alone = grouping.first_seen_groups(rows, names.grouping_class("test_name"), min_size=3)
    assert sorted(r.cluster_id for r in alone.collect()) == [0, 1, 2]
    empty = rows.where("ord < 0")
    assert grouping.first_seen_groups(empty, "test_name").count() == 0
    assert classify.macro_scores(spark.createDataFrame([("a", "a"), ("a", "b")], "actual string, predicted string")).first().macro_f1 == pytest.approx(2 / 3)


def test_java():
    source = "class T {\n  // sends\n  @Test\n  public void a() throws Exception {\n    String s = \"}\";\n    HttpClient c = new HttpClient();\n    assertEquals(1, c.get());\n  }\n  void b() { for (;;) {} }\n}"
    got = method_of(source, "x.T#a")
    assert got.startswith("  // sends\n  @Test") and got.endswith("  }") and "void b" not in got
    assert method_of(None, "x#y").startswith("//") and method_of("z" * 4000, "q#nope").endswith("(code truncated)")
    p = profile(source)
    assert p["n_assertions"] == 1 and p["uses_network"] and p["n_loops"] == 1 and p["annotations"] == ["Test"] and not p["uses_files"]


def test_cluster_quota_never_draws_less_than_the_least():
    from flakespark.operators.sampling import cluster_quota

    for seed in range(50):
        got = cluster_quota([(1, 2), (2, 2), (3, 5)], 5, 2, seed)
        assert min(got.values()) >= 2 and 4 <= sum(got.values()) <= 5
    assert cluster_quota([(1, 2), (2, 3)], 9, 2, 1) == {1: 2, 2: 3}


def test_small_groups_follow_the_kept_ones(spark):
    from flakespark.operators import grouping

    rows = spark.createDataFrame([(0, "a", "S1"), (1, "b", "S2"), (2, "c", "S3"), (3, "d", "S2")], "ord long, test_name string, sig string")
    got = {r.test_name: (r.cluster_id, r.signature) for r in grouping.first_seen_groups(rows, "sig", min_size=2).collect()}
    assert got == {"a": (1, "S1"), "b": (0, "S2"), "c": (2, "S3"), "d": (0, "S2")}
    verdicts = spark.createDataFrame([(0, "No"), (1, "No")], "cluster_id long, verdict string")
    grouped = grouping.first_seen_groups(rows, "sig", min_size=2)
    apart = {r.test_name: (r.cluster_id, r.verdict) for r in grouping.apply_verdicts(grouped, verdicts).collect()}
    assert apart == {"b": (0, "No"), "d": (1, "No"), "a": (2, "Skipped"), "c": (3, "Skipped")}


def test_model_names_groups(spark):
    from flakespark.operators import baselines

    rows = spark.createDataFrame([(k, f"t{k}", None) for k in range(5)], "ord long, test_name string, trace string")
    reply = lambda prompt, system="": "Group 1: 2, 3" if "3. " in prompt else "no"
    got = {r.test_name: r.cluster_id for r in baselines.model_groups(rows, reply, size=3).collect()}
    assert got == {"t0": 0, "t1": 1, "t2": 1, "t3": 2, "t4": 3}


def test_long_sources_take_linear_time():
    import time

    began = time.time()
    for body in ("foo(1); bar(2); ", "nope(", " nope ", "void nope( ", "void nope() throws A, ", " \n\t"):
        method_of("class X {" + body * (1_000_000 // len(body)), "X#nope")
    assert time.time() - began < 5


def test_p_values(spark):
    from flakespark.operators import stats

    rows = spark.createDataFrame([(10, 2.262157, -1.959964), (2, 12.7062, None), (1, None, 0.0)], "n long, t double, z_w double")
    got = {r.n: r for r in stats.with_p_values(rows).collect()}
    assert abs(got[10].p_t - 0.05) < 1e-5 and abs(got[10].p_w - 0.05) < 1e-5 and abs(got[2].p_t - 0.05) < 1e-4
    assert got[2].p_w is None and got[1].p_t is None and got[1].p_w == 1 and not got[1].significant_w
