"""The registry: every query of the engine with, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flakespark.functions import cascade, code, names, replies, signatures
from flakespark.operators import agreement, baselines, classify, diagnosis, grouping, javacode, ledger, model, partition_metrics, repair, sampling, stats, textmetrics, vectors
from flakespark.plans import duckdb_sql as D
from flakespark.plans import features
from flakespark.plans.views import duck, read, view
from flakespark.sources import sinks
from flakespark.streaming import ledger as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name) for f in df.schema.fields])


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "failures")


def _features(spark: SparkSession, sf_dir: str, frames: bool = False) -> DataFrame:
    return features.extract(_failures(spark, sf_dir), frames=frames)


# ---- scalar functions --------------------------------------------------------------


@query(f"WITH {D.FEATURES} SELECT test_name, exception_type, simple_name, message, stack_depth FROM feat")
def parse_exception(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("test_name", "exception_type", "simple_name", "message", "stack_depth"))


@query(f"WITH {D.FEATURES} SELECT test_name, entry_point, len(keys) AS n_keys, array_to_string(keys, ',') AS key_list FROM feat")
def key_classes(spark, sf_dir):
    return rounded(_features(spark, sf_dir, frames=True).select("test_name", "entry_point", F.size("key_classes").alias("n_keys"), F.array_join("key_classes", ",").alias("key_list")))


@query(f"WITH {D.FEATURES} SELECT test_name, split_part(test_name, '#', 1) AS class_name, split_part(test_name, '#', 2) AS method_name, split_part(test_name, '#', 1) || '-' || split_part(test_name, '#', 2) || '.java' AS file FROM feat")
def test_names(spark, sf_dir):
    return _failures(spark, sf_dir).select("test_name", names.class_name("test_name").alias("class_name"), names.method_name("test_name").alias("method_name"), names.source_file_name("test_name").alias("file"))


@query(f"WITH {D.FEATURES} SELECT test_name, category, tier FROM feat")
def tier_cascade(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("test_name", "category", "tier"))


@query(f"WITH {D.FEATURES} SELECT tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM feat GROUP BY tier")
def tier_stats(spark, sf_dir):
    counts = _features(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    return rounded(counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))  # five rows


@query(" UNION ALL ".join(f"(WITH {D.features(t, True)} SELECT '{''.join(map(str, t))}' AS config, category, tier, count(*) AS n FROM feat GROUP BY category, tier)" for t in ((1,), (1, 2), (1, 2, 3), (1, 2, 3, 4))))
def tier_ablation(spark, sf_dir):
    rows, out = _failures(spark, sf_dir), None
    for t in ((1,), (1, 2), (1, 2, 3), (1, 2, 3, 4)):
        one = features.extract(rows, t, source_rules=cascade.SOURCE_WORDS_SHORT).groupBy("category", "tier").agg(F.count("*").alias("n")).select(F.lit("".join(map(str, t))).alias("config"), "category", "tier", "n")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"WITH {D.FEATURES} SELECT CASE WHEN trace IS NULL THEN '' ELSE category END AS category, CASE WHEN trace IS NULL THEN 0 ELSE tier END AS tier, count(*) AS n FROM feat GROUP BY ALL")
def batch_cascade(spark, sf_dir):
    return rounded(features.extract_deduplicated(_failures(spark, sf_dir)).groupBy("category", "tier").agg(F.count("*").alias("n")))


@query(f"WITH {D.FEATURES} SELECT coalesce(nullif(category, ''), 'Unknown') AS category, count(*) AS n FROM feat GROUP BY 1")
def category_histogram(spark, sf_dir):
    return _features(spark, sf_dir).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("Unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(w, ' ') AS tokens, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '" + D.UNICODE_TOKEN + "') AS w FROM documents)")
def tokenize(spark, sf_dir):
    return rounded(read(spark, sf_dir, "documents").select("doc_id", F.array_join(code.tokenize("text"), " ").alias("tokens"), F.size(code.tokenize("text")).alias("n")))


@query(f"WITH {duck('pairs')}, t AS (SELECT id, regexp_extract_all(generated, '{D.TOKEN}') AS w FROM pairs), g AS (SELECT unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3) SELECT array_to_string(w[i:i+2], ' ') AS gram, count(*) AS n FROM g GROUP BY gram")
def ngram_counts(spark, sf_dir):
    grams = view(spark, sf_dir, "pairs").select(F.explode(code.ngrams(code.tokenize("generated"), 3)).alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


@query(f"WITH {D.DIFFS} SELECT id, {D.lines_with(D.ADDED, cut=True)} AS added, {D.lines_with(D.REMOVED, cut=True)} AS removed, {D.lines_with(D.CONTEXT, cut=True)} AS with_context, {D.lines_with(D.CHANGED, cut=False)} AS normal FROM diffs")
def diff_parts(spark, sf_dir):
    d = _diffs(spark, sf_dir)
    return d.select("id", code.added_lines("diff").alias("added"), code.removed_lines("diff").alias("removed"), code.added_lines("diff", context=True).alias("with_context"), code.normalise_diff("diff").alias("normal"))


def _diffs(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    line = lambda s, c: F.concat(F.lit(s), F.col(c))
    diff = F.concat_ws("\n", F.lit("diff --git a/T.java b/T.java"), F.lit("index 1..2"), F.lit("--- a/T.java"), F.lit("+++ b/T.java"), F.lit("@@ -2,3 +2,3 @@"), F.lit(" class T {"), line("-", "truth"), line("+", "generated"), F.lit("+  // new  "), F.lit(" }"))
    return p.select("id", "generated", diff.alias("diff"), F.concat_ws("\n", F.lit("package p;"), F.lit("class T {"), F.col("generated"), F.lit("  // new  "), F.lit("}"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("code"))


@query(f"WITH {D.DIFFS} SELECT id, array_to_string(code[1:7], chr(10)) AS region FROM (SELECT id, string_split(code, chr(10)) AS code FROM diffs)")
def diff_region(spark, sf_dir):
    return _diffs(spark, sf_dir).select("id", code.changed_region("code", "diff").alias("region"))


@query(f"WITH {D.DIFFS} SELECT id, array_to_string(list_filter([trim(x) FOR x IN string_split(code, chr(10))], lambda x: x <> ''), chr(10)) AS normal, FALSE AS same FROM diffs")
def normalize_code(spark, sf_dir):
    return _diffs(spark, sf_dir).select("id", code.normalise_code("code").alias("normal"), code.exact_match("code", "diff").alias("same"))


@query(f"WITH {D.BLEU} SELECT id, round(bleu, 6) AS bleu FROM bleu")
def bleu4(spark, sf_dir):
    return rounded(textmetrics.bleu4(view(spark, sf_dir, "pairs"), "id", "generated", "truth"))


@query(f"WITH {duck('pairs')} SELECT id, round(1 - levenshtein(generated, truth)::DOUBLE / greatest(length(generated), length(truth)), 6) AS edit FROM pairs")
def edit_similarity(spark, sf_dir):
    return rounded(view(spark, sf_dir, "pairs").select("id", code.edit_similarity("generated", "truth").alias("edit")))


@query(f"WITH {D.BLEU}, {D.KEYWORDS} SELECT id, round(bleu, 6) AS bleu, round(keyword, 6) AS keyword, round(structure, 6) AS structure, round(0.5 * bleu + 0.25 * keyword + 0.25 * structure, 6) AS codebleu FROM bleu JOIN kw USING (id)")
def codebleu(spark, sf_dir):
    return rounded(textmetrics.codebleu(view(spark, sf_dir, "pairs"), "id", "generated", "truth"))


def _repair_pairs(spark, sf_dir):
    """Pairs whose generated side is code, code, a diff, added lines or a diff, and whose truth is a diff in the second and last case."""
    p = view(spark, sf_dir, "pairs")
    diff = lambda c: F.concat(F.lit("diff --git a/T.java b/T.java\n--- a/T.java\n+++ b/T.java\n@@ -1,2 +1,2 @@\n-old();\n+"), F.col(c), F.lit("\n kept();"))
    kind = F.col("id") % 5
    generated = F.when(kind.isin(2, 4), diff("generated")).when(kind == 3, F.concat(F.lit("+"), "generated", F.lit("\n+ more();"))).otherwise(F.col("generated"))
    return p.select("id", generated.alias("generated"), F.when(kind.isin(1, 4), diff("truth")).otherwise(F.col("truth")).alias("truth"), diff("generated").alias("generated_diff"), diff("truth").alias("truth_diff"))


_MORE = "CASE WHEN id % 5 = 3 THEN generated || chr(10) || ' more();' ELSE generated END"


@query(D.repairs(_MORE))
def evaluate_repairs(spark, sf_dir):
    return rounded(textmetrics.evaluate_repairs(_repair_pairs(spark, sf_dir), "id", "generated", "truth"))


@query(D.repairs(_MORE))
def evaluate_added_lines(spark, sf_dir):
    return rounded(textmetrics.evaluate_added_lines(_repair_pairs(spark, sf_dir), "id", "generated", "truth_diff"))


@query(D.repairs("'-old();' || chr(10) || '+' || generated", "'-old();' || chr(10) || '+' || truth"))
def evaluate_diffs(spark, sf_dir):
    return rounded(textmetrics.evaluate_diffs(_repair_pairs(spark, sf_dir), "id", "generated_diff", "truth_diff"))


@query(f"SELECT 'offline' AS method, round(avg(bleu), 4) AS bleu, round(avg(codebleu), 4) AS codebleu, round(avg(edit), 4) AS edit, count(*) AS n FROM ({D.repairs(_MORE)})")
def average_repairs(spark, sf_dir):
    scored = textmetrics.evaluate_repairs(_repair_pairs(spark, sf_dir), "id", "generated", "truth")
    return rounded(textmetrics.average_repairs(scored.withColumn("method", F.lit("offline")), ["method"]), 4)


@query(f"WITH {duck('pairs')} SELECT id, TRUE AS ok, FALSE AS cut_ok FROM pairs")
def syntax_check(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    return p.select("id", code.valid_syntax("generated").alias("ok"), code.valid_syntax(F.substring("generated", 1, 20)).alias("cut_ok"))


@query("SELECT url, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -2) || '-' || list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS project FROM pages")
def project_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("url", names.project_name("url").alias("project"))


@query("SELECT p_partkey AS id, 'https://github.com/' || p_brand || '/r' || p_size || '/pull/' || p_partkey AS url, p_brand AS owner, 'r' || p_size AS repo, p_partkey AS number, p_brand || '_r' || p_size || '_' || p_partkey AS cache_key FROM part")
def pull_requests(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://github.com/"), "p_brand", F.lit("/r"), F.col("p_size").cast("string"), F.lit("/pull/"), F.col("p_partkey").cast("string")).alias("url"))
    pr = p.withColumn("pr", names.pull_request("url"))
    return pr.select("id", "url", "pr.*", names.cache_key("pr.owner", "pr.repo", "pr.number").alias("cache_key"))


@query("SELECT format('tpch_{:04d}', row_number() OVER (ORDER BY p_partkey) - 1) AS sample_id, p_partkey AS id FROM part")
def sample_ids(spark, sf_dir):
    p = grouping.dense_positions(read(spark, sf_dir, "part"), "p_partkey", "at")
    return p.select(names.sample_id("tpch", "at").alias("sample_id"), F.col("p_partkey").alias("id"))


@query(f"WITH {D.REPLIES} SELECT conv_id, turn, score, correctness, specificity, category, verdict, confidence FROM parsed")
def response_fields(spark, sf_dir):
    r = _replies(spark, sf_dir)
    v = r.withColumn("v", replies.verdict("reply"))
    return rounded(v.select("conv_id", "turn", replies.similarity_score("reply").alias("score"), replies.correctness("reply").alias("correctness"), replies.specificity("first").alias("specificity"), replies.diagnosis_category("reply").alias("category"), "v.verdict", "v.confidence"))


def _replies(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    number = (F.coalesce("conv_id", F.lit(0)) * 7 + F.coalesce("turn", F.lit(0))).alias("k")
    base = c.select("conv_id", "turn", number)
    pick = lambda values, m: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("k") % m + 1).cast("int"))
    reply = F.concat_ws("\n", F.lit("Some words"), F.concat(F.lit("SIMILARITY_SCORE: "), (F.col("k") % 9).cast("string")), F.concat(F.lit("CORRECTNESS: "), pick(["Yes", "No", "Partial", "maybe"], 4)), F.concat(F.lit("VERDICT: "), pick(["YES", "NO, they differ", "PARTIAL", "unsure"], 4)), F.concat(F.lit("CONFIDENCE: "), pick(["high", "low", "so so"], 3)), F.concat(F.lit("EXPLANATION: "), pick(["network is down: networking", "timing", "nothing"], 3)))
    return base.select("conv_id", "turn", reply.alias("reply"), (F.col("k") % 12).cast("string").alias("first"))


_NAMED = """WITH c AS (SELECT conv_id, (turn + 1)::INT AS member, 't' || turn AS test_name FROM conversations),
 l AS (SELECT *, CASE WHEN conv_id % 3 = 0 AND member IN (1, 3) OR conv_id % 3 = 1 AND member = 2 THEN 0 WHEN conv_id % 3 = 0 AND member = 2 OR conv_id % 3 = 1 AND member IN (4, 5) THEN 1 END AS line FROM c)
SELECT conv_id, member::BIGINT AS member, test_name, CASE WHEN line IS NULL THEN 's' || lpad(member::VARCHAR, 9, '0') ELSE 'g' || lpad(line::VARCHAR, 9, '0') END AS group_key FROM l"""


@query(_NAMED)
def group_reply_parse(spark, sf_dir):
    """Groups that a reply names, per conversation as batch: members, first line wins, the rest alone; a third of the replies names none."""
    c = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("member"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("test_name"))
    said = F.when(F.col("conv_id") % 3 == 0, "Group 1: [1, 3]\nGroup 2: 2, 3\nnone").when(F.col("conv_id") % 3 == 1, "So:\nGroup 1: 2\nGroup 2: [4, 5, 2]").otherwise("They have nothing in common.")
    groups = c.select("conv_id").distinct().select("conv_id", F.posexplode(replies.group_lines(said)).alias("line", "members"))
    return rounded(grouping.group_reply(c, groups, ["conv_id"]))


# ---- grouping ----------------------------------------------------------------------


@query(f"WITH {D.FEATURES}, {D.grouped('signature')} SELECT test_name, signature, cluster_id FROM grouped")
def signature_groups(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return grouping.first_seen_groups(rows, signatures.default_signature()).select("test_name", "signature", "cluster_id")


@query(f"WITH {D.FEATURES}, {D.STRATEGIES} SELECT strategy, signature, count(*) AS n, min(ord) AS first FROM strategies GROUP BY ALL")
def signature_strategies(spark, sf_dir):
    rows = _features(spark, sf_dir, frames=True).select("ord", F.explode(signatures.all_signatures()).alias("s")).select("ord", "s.*")
    return rows.groupBy("strategy", "signature").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query(f"WITH {D.FEATURES}, {D.grouped('class_name')} SELECT test_name, cluster_id FROM grouped")
def cluster_test_class(spark, sf_dir):
    return grouping.first_seen_groups(_failures(spark, sf_dir), names.grouping_class("test_name")).select("test_name", "cluster_id")


@query(f"WITH {D.FEATURES}, {D.grouped('kind')} SELECT test_name, cluster_id FROM grouped")
def cluster_exception_type(spark, sf_dir):
    return grouping.first_seen_groups(_features(spark, sf_dir), F.when(F.col("simple_name") != "", F.col("simple_name")).otherwise("Unknown")).select("test_name", "cluster_id")


@query(f"WITH {D.FEATURES}, sized AS (SELECT *, signature || class_name AS key, count(*) OVER own AS size, min(ord) OVER own AS first FROM feat WINDOW own AS (PARTITION BY signature || class_name)) SELECT test_name, key AS signature, dense_rank() OVER (ORDER BY size < 4, CASE WHEN size < 4 THEN ord ELSE first END) - 1 AS cluster_id FROM sized")
def cluster_min_size(spark, sf_dir):
    rows = grouping.first_seen_groups(_features(spark, sf_dir), F.concat(signatures.default_signature(), F.col("class_name")), min_size=4)
    return rows.select("test_name", "signature", "cluster_id")


@query(f"WITH {D.FEATURES} SELECT 45 AS clusters, count(*) AS n, 44 AS last FROM feat")
def cluster_random(spark, sf_dir):
    """The members are a hash's choice; ids have no gap and no test is lost."""
    return rounded(grouping.random_groups(_failures(spark, sf_dir), 45).agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("n"), F.max("cluster_id").alias("last")))


@query(f"WITH {D.FEATURES}, {D.grouped('signature')}, {D.grouped('class_name').replace('firsts', 'f2').replace('grouped', 'g2')}, {D.grouped('kind').replace('firsts', 'f3').replace('grouped', 'g3')} SELECT 'random' AS method, 45 AS clusters, count(*) AS n FROM feat UNION ALL SELECT 'test_class', count(DISTINCT cluster_id), count(*) FROM g2 UNION ALL SELECT 'exception_type', count(DISTINCT cluster_id), count(*) FROM g3 UNION ALL SELECT 'model', count(*), count(*) FROM feat UNION ALL SELECT 'signature', count(DISTINCT cluster_id), count(*) FROM grouped")
def all_baselines(spark, sf_dir):
    """Every grouping of the same tests; the offline model names no groups, so its tests stand alone."""
    made = baselines.run_all(_features(spark, sf_dir), 45, client=model.offline_client)
    return made.groupBy("method").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS ord, row_number() OVER (ORDER BY o_orderkey) - 1 AS cluster_id FROM orders")
def cluster_singletons(spark, sf_dir):
    return grouping.singletons(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"))).select("ord", "cluster_id")


_VERDICTS = f"""WITH {D.FEATURES}, {D.grouped('signature')}, s AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM grouped),
 v AS (SELECT *, CASE WHEN size < 2 THEN 'Skipped' ELSE ['No', 'Yes', 'Partial'][cluster_id % 3 + 1] END AS verdict FROM s)"""


def _verified(spark, sf_dir):
    rows = grouping.first_seen_groups(_features(spark, sf_dir), signatures.default_signature())
    said = F.element_at(F.array(F.lit("No"), F.lit("Yes"), F.lit("Partial")), (F.col("cluster_id") % 3 + 1).cast("int"))
    verified = grouping.apply_verdicts(rows, rows.select("cluster_id").distinct().withColumn("verdict", said))
    return verified.withColumn("split", F.when(F.col("original_cluster_id") % 2 == 0, "apart"))


@query(f"{_VERDICTS} SELECT test_name, cluster_id AS original_cluster_id, verdict, dense_rank() OVER (ORDER BY cluster_id, CASE WHEN verdict = 'No' THEN ord END) - 1 AS cluster_id FROM v")
def verdict_apply(spark, sf_dir):
    return _verified(spark, sf_dir).select("test_name", "original_cluster_id", "verdict", "cluster_id")


@query(f"{_VERDICTS}, judged AS (SELECT DISTINCT cluster_id, verdict FROM v) SELECT count(*) AS total_clusters, count(*) FILTER (verdict = 'Yes') AS verified_yes, count(*) FILTER (verdict = 'No') AS verified_no, count(*) FILTER (verdict = 'Partial') AS verified_partial, count(*) FILTER (verdict = 'Skipped') AS skipped_small, count(*) FILTER (verdict = 'No' OR verdict = 'Partial' AND cluster_id % 2 = 0) AS splits_performed FROM judged")
def verification_stats(spark, sf_dir):
    return grouping.verification_stats(_verified(spark, sf_dir), "split")


@query(f"WITH {D.FEATURES} SELECT test_name, (row_number() OVER (PARTITION BY project, class_name ORDER BY ord) - 1) // 20 AS batch FROM feat")
def batch_numbers(spark, sf_dir):
    rows = _failures(spark, sf_dir).withColumn("class_name", names.class_name("test_name"))
    return grouping.batches(rows, 20, ["project", "class_name"]).select("test_name", "batch")


@query(f"WITH {D.FEATURES} SELECT project, test_name FROM feat QUALIFY row_number() OVER (PARTITION BY project ORDER BY (CASE WHEN source IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN trace IS NOT NULL THEN 1 ELSE 0 END) DESC, ord) <= 10")
def representative_topn(spark, sf_dir):
    return sampling.by_availability(_failures(spark, sf_dir), ["project"], 10, "source", "trace").select("project", "test_name")


@query(f"WITH {D.FEATURES}, {D.grouped('signature')} SELECT signature, arg_min(category, ord) AS category, count(*) AS size FROM grouped GROUP BY signature")
def cluster_representatives(spark, sf_dir):
    rows = grouping.first_seen_groups(_features(spark, sf_dir), signatures.default_signature())
    return rows.groupBy("signature").agg(F.first("group_category").alias("category"), F.count("*").alias("size"))


@query()
def average_linkage(spark, sf_dir):
    """Average linkage of all vectors of a label."""
    return vectors.linkage_groups(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.5)


@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark, sf_dir):
    """All pairs of one label."""
    return rounded(vectors.cosine_pairs(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding"))


# ---- metrics -----------------------------------------------------------------------


def _scored_partitions(spark, sf_dir) -> DataFrame:
    rows = _features(spark, sf_dir, frames=True).select("project", "true_label", F.explode(signatures.all_signatures()).alias("s")).select("project", "true_label", "s.*")
    return rows


@query(f"WITH {D.FEATURES}, {D.STRATEGIES}, {D.partition_scores('strategies', ['strategy'], 'signature', 'true_label')} SELECT strategy, n, ari, nmi, v_measure, purity FROM scores")
def ari_nmi_v_purity(spark, sf_dir):
    s = partition_metrics.partition_scores(_scored_partitions(spark, sf_dir), ["strategy"], "signature", "true_label")
    return rounded(s.select("strategy", "n", "ari", "nmi", "v_measure", "purity"))


@query(f"WITH {D.FEATURES}, {D.STRATEGIES}, two AS (SELECT * FROM strategies WHERE strategy IN ('class', 'type')), {D.partition_scores('two', ['project', 'strategy'], 'signature', 'true_label')} SELECT project, strategy, n, ari, nmi, v_measure, purity FROM scores")
def ari_per_project(spark, sf_dir):
    rows = _scored_partitions(spark, sf_dir).where(F.col("strategy").isin("class", "type"))
    s = partition_metrics.partition_scores(rows, ["project", "strategy"], "signature", "true_label")
    return rounded(s.select("project", "strategy", "n", "ari", "nmi", "v_measure", "purity"))


@query(f"WITH {duck('scored')} SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM scored s WHERE s.actual = a.l AND s.predicted = b.l) AS n FROM (SELECT unnest(['Yes', 'No', 'Partial']) AS l) a, (SELECT unnest(['Yes', 'No', 'Partial']) AS l) b")
def confusion_matrix(spark, sf_dir):
    return classify.confusion(view(spark, sf_dir, "scored"), ["Yes", "No", "Partial"])


@query(f"WITH {duck('scored')}, {D.PRF} SELECT category, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def precision_recall_f1(spark, sf_dir):
    return rounded(classify.category_scores(view(spark, sf_dir, "scored")))


@query(f"WITH {duck('scored')}, {D.PRF}, fixed AS (SELECT unnest(['Yes', 'No', 'Partial', 'Networking', 'Other']) AS category) SELECT category, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, coalesce(support, 0) AS support FROM fixed LEFT JOIN prf USING (category)")
def fixed_category_scores(spark, sf_dir):
    """Scores of a fixed list of categories, seen or not (A5)."""
    return rounded(classify.category_scores(view(spark, sf_dir, "scored"), categories=["Yes", "No", "Partial", "Networking", "Other"]))


@query(f"WITH {duck('scored')}, {D.PRF} SELECT round((SELECT avg(f1) FROM prf WHERE support > 0), 6) AS macro_f1, round(avg((actual = predicted)::INT), 6) AS accuracy, count(*) AS n FROM scored")
def macro_f1(spark, sf_dir):
    return rounded(classify.macro_scores(view(spark, sf_dir, "scored")))


@query(f"WITH {duck('runs')} SELECT method, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median, count(score) AS n FROM runs GROUP BY method")
def method_summary(spark, sf_dir):
    return rounded(stats.method_summary(view(spark, sf_dir, "runs"), ["method"], "score"))


@query(f"WITH {duck('runs')} SELECT method, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(score) AS n FROM runs GROUP BY method")
def sample_summary(spark, sf_dir):
    return rounded(stats.sample_summary(view(spark, sf_dir, "runs"), ["method"], "score"))


@query(f"WITH {duck('runs')}, m AS (SELECT cluster_id, coalesce(avg(score) FILTER (method = 'A'), 0) AS a, coalesce(avg(score) FILTER (method = 'R'), 0) AS b FROM runs WHERE method IN ('A', 'R') GROUP BY cluster_id) SELECT count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) FILTER (a = b) AS ties, round(avg(b - a), 6) AS gain FROM m")
def win_loss(spark, sf_dir):
    return rounded(stats.win_loss(view(spark, sf_dir, "runs"), ["cluster_id"], "method", "score", "A", "R"))


_POSITIONAL = "SELECT cluster_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY run, score) AS k FROM runs WHERE method = '{}'"


@query(f"WITH {duck('runs')}, a AS ({_POSITIONAL.format('A')}), b AS ({_POSITIONAL.format('R')}), p AS (SELECT a.cluster_id, a.score AS a, b.score AS b FROM a LEFT JOIN b USING (cluster_id, k)) SELECT cluster_id, count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) - count(*) FILTER (b > a) - count(*) FILTER (b < a) AS ties FROM p GROUP BY cluster_id")
def win_loss_positional(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    return stats.positional_win_loss(runs.where("method = 'A'"), runs.where("method = 'R'"), ["cluster_id"], ["run", "score"], "score")


@query(f"WITH {duck('runs')}, i AS (SELECT cluster_id, method, avg(score) AS m, stddev_pop(score) AS s FROM runs GROUP BY ALL) SELECT method, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(avg(s), 6) AS mean_run_std, count(*) AS items FROM i GROUP BY method")
def two_level_runs(spark, sf_dir):
    return rounded(stats.two_level(view(spark, sf_dir, "runs"), ["cluster_id"], "method", "score"))


@query(f"WITH {duck('runs')}, u AS (SELECT method, unnest(['score', 'cosine', 'bleu']) AS metric, unnest([score, cosine, bleu]) AS value FROM runs) SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM u GROUP BY ALL")
def metric_unpivot(spark, sf_dir):
    return rounded(stats.unpivot_metrics(view(spark, sf_dir, "runs"), ["method"], ["score", "cosine", "bleu"]))


@query(f"WITH {duck('runs')} SELECT cluster_id, round(avg(score) FILTER (method = 'A'), 6) AS \"A\", round(avg(score) FILTER (method = 'N'), 6) AS \"N\", round(avg(score) FILTER (method = 'R'), 6) AS \"R\" FROM runs GROUP BY cluster_id")
def category_pivot(spark, sf_dir):
    return rounded(stats.pivot_mean(view(spark, sf_dir, "runs"), ["cluster_id"], "method", ["A", "N", "R"], "score"))


@query(f"WITH {duck('scored')} SELECT method, round(100.0 * count(*) FILTER (predicted = 'Yes') / count(*), 6) AS \"Yes\", round(100.0 * count(*) FILTER (predicted = 'No') / count(*), 6) AS \"No\", round(100.0 * count(*) FILTER (predicted = 'Partial') / count(*), 6) AS \"Partial\" FROM scored GROUP BY method")
def correctness_crosstab(spark, sf_dir):
    return rounded(stats.row_percent(view(spark, sf_dir, "scored"), "method", "predicted", ["Yes", "No", "Partial"]))


@query(D.DATASET_STATS)
def dataset_stats(spark, sf_dir):
    f = _failures(spark, sf_dir)
    c = f.groupBy("project", "true_label").agg(F.count("*").alias("size"), F.count("source").alias("with_source"), F.count("trace").alias("with_trace"))
    s = c.agg(F.count("*").alias("clusters"), F.count_distinct("project").alias("projects"), F.sum("size").alias("tests"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.avg("size").alias("mean_size"), F.sum("with_source").alias("with_source"), F.sum("with_trace").alias("with_trace"))
    ratio = lambda x: F.when(F.col("tests") > 0, F.col(x) / F.nullif(F.col("tests"), F.lit(0))).otherwise(0.0)
    return rounded(s.select("clusters", "projects", "tests", "smallest", "largest", "mean_size", ratio("with_source").alias("source_ratio"), ratio("with_trace").alias("trace_ratio")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_projects(spark, sf_dir):
    return sampling.top_counts(read(spark, sf_dir, "documents"), "source")


@query(f"WITH {duck('calls')}, {D.PRICES} SELECT model, component, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum((tokens_in * coalesce(a, 0) + tokens_out * coalesce(b, 0)) / 1e6), 4) AS cost FROM calls LEFT JOIN prices USING (model) GROUP BY GROUPING SETS ((), (model), (component))")
def ledger_cost(spark, sf_dir):
    return ledger.costs(view(spark, sf_dir, "calls"))


@query("SELECT substr(sha256('offline||sys||' || role), 1, 16) AS cache_key, min(role) AS role FROM conversations WHERE role <> 'user' GROUP BY role")
def cache_misses(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("cache_key", replies.cache_key(F.lit("offline"), F.lit("sys"), "role"))
    cache = c.where("role = 'user'").select("cache_key").distinct()
    return ledger.cache_misses(c.select("cache_key", "role"), cache)


@query("SELECT count(*) AS requests, count(*) FILTER (role = 'user') AS hits, round(count(*) FILTER (role = 'user') / count(*), 6) AS hit_rate FROM conversations")
def cache_stats(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("cache_key", replies.cache_key(F.lit("offline"), F.lit("sys"), "role"))
    cache = c.where("role = 'user'").select("cache_key").distinct().withColumn("response", F.lit("x"))
    return rounded(ledger.cache_stats(ledger.cached_answers(c, cache)))


_QUOTA = {"1-URGENT": 50, "2-HIGH": 20, "3-MEDIUM": 10**6, "absent": 5}


@query("SELECT o_orderpriority AS category, least(count(*), CASE o_orderpriority WHEN '1-URGENT' THEN 50 WHEN '2-HIGH' THEN 20 ELSE 1000000 END) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority")
def stratified_sample(spark, sf_dir):
    """Sizes of the strata; the members are a hash's choice."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"))
    return sampling.stratified(rows, "category", _QUOTA).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT 0 AS over, 0 AS under, TRUE AS whole")
def cluster_sample(spark, sf_dir):
    """What holds of any draw: no cluster gives more than it has or less than two, and at most one place stays empty."""
    rows = _failures(spark, sf_dir).withColumn("cluster_id", F.col("true_label").cast("long"))
    taken = sampling.cluster_sample(rows, 300).groupBy("cluster_id").agg(F.count("*").alias("n"))
    both = rows.groupBy("cluster_id").agg(F.count("*").alias("size")).join(taken, "cluster_id")
    return both.agg(F.count_if(F.col("n") > F.col("size")).alias("over"), F.count_if(F.col("n") < 2).alias("under"), F.sum("n").isin(299, 300).alias("whole"))


_PAIRWISE = f"""WITH {duck('raters')}, p AS (SELECT r1::DOUBLE AS a, r2::DOUBLE AS b FROM raters),
 r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM p),
 ma AS (SELECT a, count(*)::DOUBLE AS m FROM p GROUP BY a), mb AS (SELECT b, count(*)::DOUBLE AS m FROM p GROUP BY b),
 e AS (SELECT sum(CASE WHEN a = b THEN ma.m * mb.m END) AS c0, sum(abs(a - b) / 4 * ma.m * mb.m) AS c1, sum(((a - b) / 4) ** 2 * ma.m * mb.m) AS c2 FROM ma, mb),
 s AS (SELECT count(*) AS n, avg((a = b)::INT) AS exact, avg((abs(a - b) <= 1)::INT) AS adjacent, avg(abs(a - b)) AS mae, corr(a, b) AS pearson, corr(ra, rb) AS spearman, avg(abs(a - b) / 4) AS d1, avg(((a - b) / 4) ** 2) AS d2 FROM r)
SELECT n, round(exact, 6) AS exact, round(adjacent, 6) AS adjacent, round(mae, 6) AS mae, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman,
 round((exact - c0 / (n * n)) / (1 - c0 / (n * n)), 6) AS kappa, round(1 - d1 / (c1 / (n * n)), 6) AS kappa_linear, round(1 - d2 / (c2 / (n * n)), 6) AS kappa_quadratic FROM s, e"""


@query(_PAIRWISE)
def kappa(spark, sf_dir):
    return rounded(agreement.pair_agreement(view(spark, sf_dir, "raters"), "r1", "r2", [1, 2, 3, 4, 5]))


@query(f"""WITH {duck('raters')}, l AS (SELECT item, unnest([r1, r2, r3]) AS score FROM raters), c AS (SELECT item, score, count(*) AS c FROM l GROUP BY ALL),
 i AS (SELECT item, sum(c) AS k, sum(c * (c - 1)) AS g FROM c GROUP BY item), s AS (SELECT score, sum(c) AS c FROM c GROUP BY score),
 p AS (SELECT avg(g / (k * (k - 1))) AS p, count(*) AS items FROM i), e AS (SELECT sum(c * c) / sum(c) ** 2 AS e FROM s)
SELECT items, round((p - e) / (1 - e), 6) AS fleiss FROM p, e""")
def fleiss(spark, sf_dir):
    r = view(spark, sf_dir, "raters").select("item", F.explode(F.array("r1", "r2", "r3")).alias("score"))
    return rounded(agreement.fleiss_kappa(r, "item", "score"))


@query(f"""WITH {duck('raters')}, d AS (SELECT r1::DOUBLE AS a, r3::DOUBLE AS b, r1 - r3 AS d FROM raters),
 z AS (SELECT d, abs(d) AS s, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
 w AS (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) AS m FROM z), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*) AS c FROM z GROUP BY s)),
 b AS (SELECT count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, (avg(a) - avg(b)) / sqrt((var_pop(a) + var_pop(b)) / 2) AS c FROM d)
SELECT n, round(b.t, 6) AS t, round(w, 6) AS w, round((w - m * (m + 1) / 4) / sqrt((m * (m + 1.0) * (2 * m + 1) - t.t / 2) / 24), 6) AS z_w, round(c, 6) AS cohens_d,
 CASE WHEN abs(c) < 0.2 THEN 'negligible' WHEN abs(c) < 0.5 THEN 'small' WHEN abs(c) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM b, w, t""")
def paired_tests(spark, sf_dir):
    return rounded(stats.paired_tests(view(spark, sf_dir, "raters"), "r1", "r3", []))


@query()
def paired_significance(spark, sf_dir):
    """p values of the paired tests; SQL has neither distribution, tests hold them against tables."""
    return rounded(stats.with_p_values(stats.paired_tests(view(spark, sf_dir, "raters"), "r1", "r3", [])).select("n", "p_t", "p_w", "significant_t", "significant_w"))


@query(f"WITH {D.FEATURES} SELECT project, round(count(*) FILTER (trace IS NOT NULL) / count(*), 6) AS coverage, count(*) FILTER ({D.shared_cause('lower(coalesce(trace, source))')}) AS shared, max(substr(coalesce(trace, source), 1, 20)) AS excerpt FROM feat GROUP BY project")
def gt_validation(spark, sf_dir):
    f = _failures(spark, sf_dir).withColumn("text", F.coalesce("trace", "source"))
    return rounded(f.groupBy("project").agg((F.count("trace") / F.count("*")).alias("coverage"), F.count_if(cascade.shared_cause("text")).alias("shared"), F.max(F.substring("text", 1, 20)).alias("excerpt")))


@query(f"WITH {duck('scored')} SELECT doc_id FROM scored s WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id AND l.toxic = 1) UNION SELECT doc_id FROM documents WHERE lang = 'en'")
def set_operations(spark, sf_dir):
    """Scored documents with a toxic label, united with all of one language."""
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    kept = view(spark, sf_dir, "scored").join(toxic, "doc_id", "left_semi").select("doc_id")
    return kept.union(read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")).distinct()


@query()
def model_calls(spark, sf_dir):
    """Verdicts of the offline model on each signature group."""
    rows = grouping.first_seen_groups(_features(spark, sf_dir), signatures.default_signature())
    prompts = model.collective_prompts(rows)
    return model.generate(prompts, model.offline_client).select("cluster_id", replies.verdict("response").alias("v")).select("cluster_id", "v.verdict", "v.confidence")


@query()
def diagnose(spark, sf_dir):
    rows = grouping.first_seen_groups(_features(spark, sf_dir), signatures.default_signature())
    return model.diagnose(rows).select("cluster_id", "n_tests", "diagnosis")


@query()
def diagnosis_summary(spark, sf_dir):
    """Diagnoses of both methods for each signature group, judged by the offline model against the group's category."""
    rows = grouping.first_seen_groups(_features(spark, sf_dir), signatures.default_signature())
    causes = rows.groupBy("cluster_id").agg(F.concat(F.lit("cause: "), F.min_by("category", "ord")).alias("cause"))
    single = model.diagnose(rows).select("cluster_id", F.lit("individual").alias("method"), "diagnosis")
    shared = model.generate(model.collective_prompts(rows), model.offline_client).select("cluster_id", F.lit("collective").alias("method"), F.col("response").alias("diagnosis"))
    return rounded(diagnosis.summary(diagnosis.evaluate(single.unionByName(shared), causes, ["cluster_id"])))


@query()
def repair_methods(spark, sf_dir):
    """BLEU, CodeBLEU and edit similarity of three repair methods on parts as samples, brands as clusters."""
    p = view(spark, sf_dir, "pairs")
    samples = p.select(F.format_string("s_%06d", "id").alias("sample_id"), F.concat(F.lit("org.T#t"), F.col("id").cast("string")).alias("test_name"), F.lit("ID").alias("category"), F.col("generated").alias("code"), F.col("truth").alias("ground_truth"))
    members = repair.members_of(p.select(F.format_string("s_%06d", "id").alias("sample_id"), F.regexp_extract("generated", "Brand#[0-9]+", 0).alias("cluster")), samples)
    return rounded(repair.compare_methods(samples, members))


@query(f"WITH {D.FEATURES}, ok AS (SELECT project FROM feat GROUP BY project HAVING count(DISTINCT true_label) >= 2 AND count(*) >= 2), own AS (SELECT project, class_name AS signature, true_label FROM feat SEMI JOIN ok USING (project)), {D.partition_scores('own', ['project'], 'signature', 'true_label')} SELECT project, n, ari, purity FROM scores")
def intra_project_scores(spark, sf_dir):
    """Scores of projects with at least two true clusters and two tests."""
    f = _failures(spark, sf_dir).withColumn("class_name", names.class_name("test_name"))
    enough = f.groupBy("project").agg(F.count_distinct("true_label").alias("c"), F.count("*").alias("k")).where("c >= 2 and k >= 2").select("project")
    s = partition_metrics.partition_scores(f.join(enough, "project", "left_semi"), ["project"], "class_name", "true_label")
    return rounded(s.select("project", "n", "ari", "purity"))


@query("SELECT p_brand AS cluster, p_partkey AS sample_id, (SELECT list(q.p_partkey ORDER BY q.p_partkey)[1:5] FROM (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part x WHERE x.p_brand = part.p_brand) WHERE k <= 6) q WHERE q.p_partkey <> part.p_partkey)::VARCHAR AS others FROM part")
def other_tests(spark, sf_dir):
    """The first other members of each sample's cluster."""
    m = read(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("sample_id"))
    return repair.other_tests(m).select("cluster", "sample_id", F.concat(F.lit("["), F.array_join("others", ", "), F.lit("]")).alias("others"))


@query()
def ast_features(spark, sf_dir):
    rows = _failures(spark, sf_dir).where("source is not null").select("test_name", javacode.ast_features("source").alias("f"))
    return rows.select("test_name", "f.n_calls", "f.n_created", "f.uses_network", "f.uses_files", "f.uses_threads", "f.uses_time")


@query()
def ast_distance(spark, sf_dir):
    """Distances of the distinct sources' profiles: six here, whatever the number of tests."""
    rows = _failures(spark, sf_dir).where("source is not null").select("source").distinct().select("source", javacode.ast_features("source").alias("f"), F.lit(1).alias("block"))
    return javacode.ast_distances(rows, ["block"], "source", "f").select("a", "b", "distances")


@query()
def method_extract(spark, sf_dir):
    p = view(spark, sf_dir, "pairs").withColumn("name", F.lit("x.T#t"))
    return p.select("id", javacode.extract_method("generated", "name").alias("method"))


@query(f"WITH {duck('calls')}, {D.PRICES} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, model, component, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, round(sum((tokens_in * coalesce(a, 0) + tokens_out * coalesce(b, 0)) / 1e6), 8) AS cost FROM calls LEFT JOIN prices USING (model) GROUP BY ALL")
def windowed_ledger(spark, sf_dir):
    return rounded(streaming.windowed_costs(view(spark, sf_dir, "calls")).select("start", "model", "component", "calls", "tokens_in", "cost"), 8)


_REPORT = f"""WITH {duck('calls')}, {D.PRICES}, c AS (SELECT model, component, count(*) AS calls, sum(tokens_in)::BIGINT AS i, sum(tokens_out)::BIGINT AS o, round(sum((tokens_in * coalesce(a, 0) + tokens_out * coalesce(b, 0)) / 1e6), 4) AS cost FROM calls LEFT JOIN prices USING (model) GROUP BY GROUPING SETS ((), (model), (component))),
 l AS (SELECT *, CASE WHEN model IS NOT NULL THEN 1 WHEN component IS NOT NULL THEN 2 ELSE 0 END AS part, coalesce('model ' || model, 'component ' || component, 'total') AS label FROM c)
SELECT part, row_number() OVER (PARTITION BY part ORDER BY cost DESC, label) AS place, printf('%s: %d calls, %d in, %d out, $%.4f', label, calls, i, o, cost) AS line FROM l"""


@query(_REPORT)
def report_lines(spark, sf_dir):
    return rounded(sinks.report_lines(ledger.costs(view(spark, sf_dir, "calls"))))


@query(f"WITH {duck('runs')}, m AS (SELECT method, avg(score) AS mean, stddev_pop(score) AS std, median(score) AS median FROM runs GROUP BY method) SELECT method, printf('%s & %.2f & %.2f & %.2f \\\\', method, mean, std, median) AS line FROM m")
def latex_summary(spark, sf_dir):
    return sinks.latex_summary(stats.method_summary(view(spark, sf_dir, "runs"), ["method"], "score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, parse, classify, ten groupings and all their partition scores."""
    return ari_nmi_v_purity(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
