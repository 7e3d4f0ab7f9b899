"""Corpus cleaning: quality, near duplicates, repeated passages, benchmark leaks, then pieces.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``documents``; the last returns the encoded texts.  Stages are
written as Parquet in the folder of ``spark.checkpoint.dir`` and read again, so a lost
executor costs no more than the running stage.

Each stage decides on rows, not on ids.  Rows without a doc_id and rows that repeat one
are documents of their own: where a stage compares documents each row has a key, in the
order of the ids, rows without an id last.  So of two near duplicates with one id one
stays, a passage that such rows share is cut from the later one, and a rejected row
takes no other row with it.  A row without an id goes only for its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlens.llm import decontam, exchange, jaccard, quality, substring, unigram

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a row's own key inside a stage
KEY = "row_key"


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``COLUMNS`` and ``KEY``: distinct numbers in the order of the ids, null ids last.

    Where no id is null or occurs twice the id is the key; else the rows are sorted by
    id over all partitions, numbered and checkpointed.
    """
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("bigint"))
    by = [F.col("doc_id").asc_nulls_last(), F.col(KEY)]
    placed = docs.withColumn(KEY, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(exchange.shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    return exchange.cut(placed.withColumn(KEY, F.monotonically_increasing_id()))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts the quality classifier accepts; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = keyed(spark, docs)
    bad = quality.score(rows, labels, keep=(KEY,)).where(F.col("score") < quality.ACCEPT).select(KEY)
    return rows.join(bad, KEY, "left_anti").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id, and of that the first row, of each group of near duplicates."""
    rows = keyed(spark, docs)
    later = jaccard.near_duplicates(rows, id_col=KEY).where("doc_id <> component_id").select(F.col("doc_id").alias(KEY))
    return rows.join(later, KEY, "left_anti").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id, or an earlier row of the same, has too."""
    rows = keyed(spark, docs).withColumnRenamed("doc_id", "own_id")
    kept = substring.remove_repeats(rows, keep=("own_id", "lang", "source", "n_chars"), id_col=KEY)
    return kept.select(F.col("own_id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source",
                       F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    return unigram.encoded(docs, keep=("lang", "source"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("leaks", without_leaks),
    ("pieces", as_pieces),
]

#: classifier, connected components and Viterbi paths are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = exchange.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
