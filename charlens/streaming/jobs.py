"""Structured Streaming forms of the repair (I1) and deduplication (I2) jobs.

Both are ordinary DataFrame plans on a file stream: the repair is stateless,
so each micro-batch is the batch job on new files; the dedup (first or best of what
was re-sent) keeps per-key state bounded by a watermark.  Sinks are Parquet with a checkpoint, so a
restarted query resumes exactly where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from charlens.operators.repair import repair_outputs
from charlens.sources.io import append_predictions


def file_stream(spark: SparkSession, in_dir: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(in_dir)


def _timed(src: DataFrame, event_time: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not _NTZ)."""
    return src.withColumn(event_time, src[event_time].cast("timestamp"))


def run_available(df: DataFrame, out_dir: str, ckpt_dir: str) -> None:
    """Process everything available now, commit, stop."""
    q = (df.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", ckpt_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_repair(spark: SparkSession, in_dir: str, out_dir: str, ckpt_dir: str, schema: StructType,
                  attrs: Mapping[str, str], to_raw: Callable[[DataFrame], DataFrame] | None = None,
                  glob: str | None = None, output_col: str = "output") -> None:
    """Raw outputs arriving as files -> repair (H1-H10) -> appended
    Parquet.  ``to_raw`` maps the arriving rows to the raw-output shape."""
    src = file_stream(spark, in_dir, schema, glob)
    raw = to_raw(src) if to_raw else src
    rep = repair_outputs(raw, attrs, output_col=output_col).drop("parsed")
    run_available(rep, out_dir, ckpt_dir)


def stream_dedup(spark: SparkSession, in_dir: str, out_dir: str, ckpt_dir: str, schema: StructType,
                 keys: list[str], event_time: str, delay: str = "1 hour", glob: str | None = None,
                 max_files: int | None = None) -> None:
    """Drop re-sent rows with the same key within the watermark delay
    (state per key is dropped once the watermark passes it).  ``keys`` is the identity
    of a re-sent row; rows later than the watermark are dropped too."""
    src = _timed(file_stream(spark, in_dir, schema, glob, max_files), event_time)
    d = src.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    run_available(d, out_dir, ckpt_dir)


def stream_latest(spark: SparkSession, in_dir: str, out_dir: str, ckpt_dir: str, schema: StructType,
                  keys: list[str], event_time: str, version: str, gap: str = "1 hour", delay: str = "1 hour",
                  glob: str | None = None, max_files: int | None = None) -> None:
    """I2, best of what was re-sent: of the rows of a key, each at most ``gap`` after the one
    before, the row of the highest ``version`` with the number of its copies.

    The rows form a session of the key, which closes and is written once the watermark
    passes its end; only open sessions are kept, one row each, so the state is bounded by
    what arrives within ``gap`` and ``delay``.  Order of arrival does not matter.  Equal
    versions: the later, then the larger row.  A row whose own session the watermark has
    passed is dropped; a session still open at the end stays in the checkpoint and is
    written by a later run.  Rows without an event time are left out; null keys are a key.
    """
    src = _timed(file_stream(spark, in_dir, schema, glob, max_files), event_time)
    rest = [c for c in src.columns if c not in (*keys, version, event_time)]
    best = (src.withWatermark(event_time, delay)
            .groupBy(F.session_window(event_time, gap).alias("session"), *keys)
            .agg(F.max(F.struct(version, event_time, *rest)).alias("best"), F.count("*").alias("copies")))
    run_available(best.select(*keys, "best.*", "copies"), out_dir, ckpt_dir)


def stream_predictions(df: DataFrame, path: str, ckpt_dir: str, run_id: str, model: str | None = None,
                       strategy: str | None = None, attributes: list[str] | None = None) -> None:
    """A9 as a stream: each micro-batch is one chunk of the run, appended exactly once.

    After a crash the engine hands out the unfinished batch again under the same number,
    and it replaces what the first attempt may have left."""
    def append(batch: DataFrame, number: int) -> None:
        append_predictions(batch, path, run_id, model, strategy, attributes, batch=number)

    q = df.writeStream.foreachBatch(append).option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start()
    q.awaitTermination()
