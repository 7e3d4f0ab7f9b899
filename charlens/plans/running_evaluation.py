"""K3 / D9 in increments: confusion counts kept per run and batch, summed when asked.

A batch of aligned rows is reduced to its labels and its per-label counts; the report of
a run is the sum over its batches, so new prediction files cost their own rows and not
the run's.  Keep-first (E1) holds over batches: a row whose key an earlier batch has
counted is left out.  A batch is its number within the run; counting it again, after a
crash or by mistake, replaces what it left, so nothing counts twice.

State under ``path``: ``rows`` (keys, gold and predicted label, null ones too) and ``counts`` (label,
support, predicted, tp), both by ``run_id`` and ``batch``.

Defined cases: rows without a key do not count; a row without one of the labels does not
count (as in the report) and still stands for its key; repeated keys within a batch count once, the least row by ``order``; a run
without counted rows has no report rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlens.operators import metrics as M
from charlens.operators.relational import dedup_first


def _stored(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """Rows of a run, or null before its table's first batch."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.where(F.col("run_id") == run_id)


def _put(df: DataFrame, path: str, run_id: str, batch: int) -> None:
    """The rows of a batch, in the place of any it had."""
    (df.withColumn("run_id", F.lit(run_id)).withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(path))


def count_batch(aligned: DataFrame, path: str, run_id: str, batch: int, keys: Sequence[str], gold: str = "gold",
                pred: str = "pred", kind: str = "string", order: Sequence[str] | None = None) -> None:
    """Adds batch ``batch`` of aligned rows to the state of a run.

    The batch is joined with the keys of earlier batches (one shuffle of both), written
    once, and counted from what was written."""
    spark = aligned.sparkSession
    keys = list(keys)
    rows = dedup_first(aligned.dropna(subset=keys), keys, order)
    rows = M.labelled(rows, gold, pred, kind, keep=keys)
    before = _stored(spark, f"{path}/rows", run_id)
    if before is not None:
        rows = rows.join(before.where(F.col("batch") < batch).select(*keys), keys, "left_anti")
    _put(rows, f"{path}/rows", run_id, batch)
    mine = _stored(spark, f"{path}/rows", run_id)
    if mine is not None:
        _put(M.pair_counts(mine.where(F.col("batch") == batch)), f"{path}/counts", run_id, batch)


def running_counts(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(label, support, predicted, tp) of all batches of a run."""
    counts = _stored(spark, f"{path}/counts", run_id)
    if counts is None:
        return spark.createDataFrame([], "label string, support bigint, predicted bigint, tp bigint")
    return counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def running_report(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The classification report (D9) of all batches of a run."""
    return M.report_of(running_counts(spark, path, run_id))
