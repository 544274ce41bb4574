"""The training-corpus pipeline: five stages over documents, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flakespark.llm import jaccard, mixing, nearest, packing, suffix
from flakespark.llm.common import ensure_checkpoint_dir, table
from flakespark.llm.queries import tokenizer_path

#: Shares of expected tokens after the toxicity stage.
MIXTURE = {"prose": 0.92, "junk": 0.08, "toxic": 0.0}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours do not mark them as toxic (op 9).

    Each row is judged by its text; null and empty texts by the rate among examples
    without words.  Repeated rows fare alike, and an empty table stays empty.
    """
    scored = nearest.score(docs, nearest.fit(docs, table(spark, sf_dir, "labels")), columns=docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (op 10).

    Null and empty texts have no copies.  Of rows that repeat an id with its text one
    stays; rows without an id all stay.
    """
    joined = jaccard.jaccard_join(docs)
    dropped = joined.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated.select("__row.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that earlier documents hold (op 2).

    A text that is empty then goes; a null or empty text that lost nothing stays, as do
    rows without an id.  n_chars follows the text.  Rows that repeat an id share its text.
    """
    cleaned = suffix.suffix_dedup(docs, with_text=True).where("n_removed > 0").select("doc_id", F.coalesce("kept_text", F.lit("")).alias("__kept")).dropDuplicates(["doc_id"])
    out = docs.join(cleaned, "doc_id", "left")
    changed = F.col("__kept").isNotNull()
    out = out.where(~changed | (F.btrim("__kept") != ""))
    return out.withColumn("n_chars", F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.coalesce("__kept", "text")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken as often as their rates say, most once (op 1).

    Texts without words are drawn by the prior's rate; rows that repeat an id are
    drawn alike, by the largest of their draws; rows without an id are taken once.
    """
    rated = mixing.mix(docs, mixing.fit_domains(docs, table(spark, sf_dir, "labels")), MIXTURE)
    drawn = rated.where("doc_id is not null").groupBy("doc_id").agg(F.max(mixing.draw(F.col("rate"), F.col("doc_id"))).alias("__copies"))
    taken = docs.join(drawn, "doc_id", "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return taken.withColumn("__copy", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies"))).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces with their ids (op 4); null and empty texts are the end id alone."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokens, neighbours and suffix arrays have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one returns is written as Parquet in the shared folder and read as the next one's docs, and goes when that is written."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        with nearest.passing():
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
