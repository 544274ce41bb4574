"""File sources (S1 to S12, S15): text forms, traces, sources, CSV and JSON, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flakespark.functions import names
from flakespark.functions.text import filled, strip

CSV_COLUMNS = ["Project URL", "SHA Detected", "Module Path", "Fully-Qualified Test Name (packageName.ClassName.methodName)", "Category", "Status", "PR Link", "Notes"]
SAMPLE = "struct<sample_id:string,project_url:string,project_name:string,test_name:string,sha_detected:string,category:string,pr_link:string,test_code_before:string,test_code_after:string,ground_truth_diff:string>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file of a glob."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"))).withColumnRenamed("col", "line")


def _place(path: Column) -> tuple[Column, Column]:
    return F.regexp_extract(path, r"([^/]+)/cluster\d+/", 1), F.regexp_extract(path, r"/cluster(\d+)/", 1).try_cast("long")


def _running(lines: DataFrame, header: Column) -> DataFrame:
    """Adds the last header at or before each line of its file."""
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(before))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """project, cluster_id, names array, run_ids array of info.txt files; lines that are no integers are no run ids."""
    lines = lines_of(whole_files(spark, path)).withColumn("line", strip("line"))
    body = _running(lines, F.when(F.col("line").isin("test_names:", "run_ids:"), F.col("line"))).where("header is null and line <> ''")
    project, cluster = _place(F.col("path"))
    own = lambda s, x: F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == s) & x.isNotNull(), F.struct("pos", x.alias("v"))))), lambda r: r["v"])
    return body.groupBy("path").agg(own("test_names:", F.col("line")).alias("names"), own("run_ids:", F.col("line").try_cast("long")).alias("run_ids")).select(project.alias("project"), cluster.alias("cluster_id"), "names", "run_ids").where("cluster_id is not null")


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """project, cluster_id, q1 to q6: answers are the stripped lines under a question; '...' and nothing are null."""
    lines = lines_of(whole_files(spark, path)).withColumn("line", strip("line"))
    marked = _running(lines, F.when(F.col("line").rlike(r"^Q\d+\."), F.concat_ws("|", F.lpad(F.col("pos").cast("string"), 9, "0"), F.regexp_extract("line", r"^Q(\d+)\.", 1))))
    body = marked.where("section is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("header").isNull() & (F.col("line") != ""), F.struct("pos", "line")))), lambda r: r["line"]), "\n")
    answers = body.groupBy("path", "section").agg(text.alias("answer"))
    # a repeated question: the last one holds
    last = answers.groupBy("path", F.concat(F.lit("q"), F.substring_index("section", "|", -1)).alias("q")).agg(F.max_by("answer", "section").alias("answer"))
    clean = last.withColumn("answer", F.when(~F.col("answer").isin("", "..."), F.col("answer")))
    project, cluster = _place(F.col("path"))
    return clean.groupBy("path").pivot("q", [f"q{k}" for k in range(1, 7)]).agg(F.first("answer")).select(project.alias("project"), cluster.alias("cluster_id"), *[f"q{k}" for k in range(1, 7)])


def read_traces(spark: SparkSession, path: str, most: int = 3) -> DataFrame:
    """project, cluster_id, test_idx, stack_traces: the first files by name, after their first 'trace_text:'."""
    files = whole_files(spark, path)
    marker = "trace_text:"
    text = strip(F.when(F.contains("text", F.lit(marker)), F.substring(F.col("text"), F.instr("text", marker) + len(marker), 1 << 30)).otherwise(F.col("text")))
    project, cluster = _place(F.col("path"))
    rows = files.select(project.alias("project"), cluster.alias("cluster_id"), F.regexp_extract("path", r"/traces(\d+)/", 1).try_cast("long").alias("test_idx"), F.substring_index("path", "/", -1).alias("file"), text.alias("trace"))
    by = Window.partitionBy("project", "cluster_id", "test_idx").orderBy("file")
    first = rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    return first.groupBy("project", "cluster_id", "test_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "trace"))), lambda r: r["trace"]).alias("stack_traces"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """project, file, source_code of Java files under {project}/flakyMethods."""
    return whole_files(spark, path).select(F.regexp_extract("path", r"([^/]+)/flakyMethods/", 1).alias("project"), F.substring_index("path", "/", -1).alias("file"), F.col("text").alias("source_code"))


def read_clusters(spark: SparkSession, root: str, need_cause: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clusters, tests) of a tree of manual analyses and sources.

    A cluster without info is absent; forms, traces and sources may be.  need_cause
    keeps clusters whose third answer has text.
    """
    info = read_info(spark, f"{root}/manual_analysis/*/cluster*/info.txt")
    forms = read_forms(spark, f"{root}/manual_analysis/*/cluster*/cluster_form.txt")
    clusters = info.join(forms, ["project", "cluster_id"], "left").withColumn("size", F.size("names"))
    if need_cause:
        clusters = clusters.where(filled("q3"))
    tests = clusters.select("project", "cluster_id", F.posexplode("names").alias("test_idx", "test_name")).withColumn("test_idx", F.col("test_idx").cast("long"))
    tests = tests.withColumn("file", names.source_file_name("test_name"))
    traces = read_traces(spark, f"{root}/manual_analysis/*/cluster*/traces*/sample*.txt")
    code = read_sources(spark, f"{root}/sources/*/flakyMethods/*.java")
    return clusters, tests.join(traces, ["project", "cluster_id", "test_idx"], "left").join(code, ["project", "file"], "left")


def flatten_tests(tests: DataFrame) -> DataFrame:
    """test_name, trace (the first), source_code; a later row of a name replaces an earlier one."""
    order = F.struct("project", "cluster_id", "test_idx")
    keep = lambda c, out: F.max_by(c, order).alias(out)
    first = tests.withColumn("trace", F.try_element_at("stack_traces", F.lit(1)))
    return first.groupBy("test_name").agg(keep("trace", "trace"), keep("source_code", "source_code"), keep("project", "project"), keep("cluster_id", "cluster_id"))


def read_fix_list(spark: SparkSession, path: str) -> DataFrame:
    """The CSV list of fixes, every value a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def fix_samples(fixes: DataFrame, source: str = "idoft", order: str = "ord") -> DataFrame:
    """Typed samples of a fix list that has an order column."""
    from flakespark.operators.grouping import dense_positions

    placed = dense_positions(fixes, order, "__place")
    test = F.col(f"`{CSV_COLUMNS[3]}`")
    return placed.select(
        names.sample_id(source, "__place").alias("sample_id"), F.col("`Project URL`").alias("project_url"), names.project_name("Project URL").alias("project_name"), test.alias("test_name"),
        names.class_name(test).alias("test_class"), names.method_name(test).alias("test_method"), F.col("`SHA Detected`").alias("sha_detected"), F.col("Category").alias("category"), names.status("Status").alias("status"), F.col("`PR Link`").alias("pr_link"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Repair samples of a JSON document {samples: [...]}; ground_truth is the fixed method, else the diff, else ''."""
    from flakespark.operators.javacode import extract_method

    rows = spark.read.schema(f"samples array<{SAMPLE}>").json(path, multiLine=True).select(F.inline("samples"))
    method = F.when(filled("test_code_after"), extract_method("test_code_after", "test_name"))
    return rows.withColumn("ground_truth", F.coalesce(method, F.when(filled("ground_truth_diff"), F.col("ground_truth_diff")), F.lit("")))


def read_cluster_map(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """cluster, sample_id of a JSON document {clusters: {id: [sample ids]}}; unknown samples drop out."""
    rows = spark.read.schema("clusters map<string,array<string>>").json(path, multiLine=True)
    pairs = rows.select(F.explode("clusters").alias("cluster", "ids")).select("cluster", F.explode("ids").alias("sample_id"))
    return pairs.join(samples.select("sample_id"), "sample_id", "left_semi")


def project_clusters(samples: DataFrame) -> DataFrame:
    """The fallback clusters: one a project, named project_{i}_{name} by first appearance of the sample id."""
    first = samples.groupBy("project_name").agg(F.min("sample_id").alias("first"))
    by = Window.orderBy("first")  # one row a project
    ids = first.withColumn("cluster", F.concat(F.lit("project_"), (F.row_number().over(by) - 1).cast("string"), F.lit("_"), F.col("project_name")))
    return samples.join(ids.select("project_name", "cluster"), "project_name").select("cluster", "sample_id")


def read_results(spark: SparkSession, path: str, column: str = "detailed_results") -> DataFrame:
    """Rows of a results document."""
    return spark.read.json(path, multiLine=True).select(F.inline(column))
