"""Registered streaming queries (I1, I2) and a CSV round trip.

Each query runs its stream to completion (``availableNow``) into a fresh
folder under the shared checkpoint directory and returns the sink as a batch
DataFrame, so the check compares the streamed result with the batch oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from charlens.plans.q_repair import _REPAIR_SQL, ATTRS
from charlens.plans.registry import register
from charlens.session import scratch_path
from charlens.sources.fixtures import VIEWS, table, with_clause
from charlens.sources.io import read_predictions, write_csv
from charlens.streaming.jobs import stream_dedup, stream_latest, stream_repair


#: rounds in which rows arrive, whatever the time they span
ROUNDS = 4


def _sent(rows, arrives, later=0):
    return rows.withColumn("arrives", arrives).withColumn("later", F.lit(later))


def _arriving(spark, sent, name, run):
    """What ``run`` (input, output, checkpoint) has written after its input came in ``ROUNDS``
    rounds, equal spans of ``arrives``, ``later`` rounds late; null for no rows.

    Each round is a new run of the stream from its checkpoint, as after a restart."""
    base = scratch_path(spark, name)
    src, out, ckpt = (os.path.join(base, x) for x in ("sent", "out", "ckpt"))
    at = F.unix_micros("arrives")
    low, high = sent.agg(F.min(at), F.max(at)).first()
    if low is None:
        return None
    span = (high - low) // ROUNDS + 1
    sent = sent.withColumn("round", F.floor((at - low) / span) + F.col("later")).drop("arrives", "later")
    for n in range(ROUNDS):
        sent.where(F.col("round") == n).drop("round").write.mode("append").parquet(src)
        run(src, out, ckpt)
    return spark.read.parquet(out)


def _raw_from_documents(spark):
    sql = VIEWS["raw_outputs"].replace("from documents", "from documents_stream")

    def to_raw(stream_df):
        stream_df.createOrReplaceTempView("documents_stream")
        return spark.sql(sql).withColumnRenamed("raw", "output")

    return to_raw


@register(
    "stream_repair",
    _REPAIR_SQL + "select doc_id, status, lang, tags, is_human, character_type from rep",
)
def q_stream_repair(spark, sf):
    """Documents arrive as a file stream; each micro-batch derives the raw
    outputs and repairs them; the appended sink equals the batch repair."""
    schema = table(spark, sf, "documents").schema
    base = scratch_path(spark, "stream-repair")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    # the table itself, one file or a folder of files: a filter on names sees only the files' own,
    # and a stream takes a single file only by a pattern
    stream_repair(spark, f"{sf}/documents.parque[t]", out, ckpt, schema, ATTRS, to_raw=_raw_from_documents(spark))
    r = spark.read.parquet(out)
    return r.select("doc_id", "status", "lang", F.array_join("tags", "|").alias("tags"),
                    F.col("type.is_human").alias("is_human"),
                    F.col("type.character_type").alias("character_type"))


@register(
    "stream_dedup",
    "select event_id, user_id, event_type from events",
)
def q_stream_dedup(spark, sf):
    """Every event is sent twice, the copy up to half an hour later; copies inside
    the watermark's hour are dropped, over several micro-batches.

    The re-sent identity is the event id; the copies of a round's last half hour arrive
    with the next round.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    again = F.expr("ts + interval 30 minutes")
    sent = _sent(events, F.col("ts")).unionByName(_sent(events, again))
    out = _arriving(spark, sent, "stream-dedup", lambda src, out, ckpt: stream_dedup(
        spark, src, out, ckpt, events.schema, ["event_id"], "ts", "1 hour"))
    return (events if out is None else out).select("event_id", "user_id", "event_type")


@register(
    "stream_latest",
    """select event_id, user_id, upper(event_type) event_type, value * 2 "value", cast(1 as bigint) version, cast(2 as bigint) copies
from events where ts + interval 2 hour <= date_trunc('milliseconds', (select max(ts) from events))""",
)
def q_stream_latest(spark, sf):
    """I2, best of what was re-sent: each event comes as a draft and as a revised row a
    quarter of an hour apart, the revised one first for half of the users; the revised row
    is kept.  A third row of yet higher version comes two rounds late, behind the
    watermark, and changes nothing.  Sessions of the last hours are still open.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    soon = F.expr("ts + interval 15 minutes")
    early = F.coalesce(F.col("user_id") % 2 == 1, F.lit(False))
    row = lambda version, ts, kind, value: events.select(
        "event_id", "user_id", F.lit(version).cast("bigint").alias("version"), ts.alias("ts"), kind.alias("event_type"), value.alias("value"))
    draft = row(0, F.when(early, soon).otherwise(F.col("ts")), F.col("event_type"), F.col("value"))
    revised = row(1, F.when(early, F.col("ts")).otherwise(soon), F.upper("event_type"), F.col("value") * 2)
    late = row(2, soon, F.lit("late"), F.lit(-1.0))
    sent = _sent(draft, F.col("ts")).unionByName(_sent(revised, F.col("ts"))).unionByName(_sent(late, F.col("ts"), later=2))
    out = _arriving(spark, sent, "stream-latest", lambda src, out, ckpt: stream_latest(
        spark, src, out, ckpt, draft.schema, ["event_id"], "ts", "version"))
    found = draft.withColumn("copies", F.lit(0).cast("bigint")).limit(0) if out is None else out
    return found.select("event_id", "user_id", "event_type", "value", "version", "copies")


@register(
    "predictions_csv_roundtrip",
    with_clause("raw_outputs") + """select concat('doc/', cast(doc_id as varchar)) book, 'c' || cast(doc_id as varchar) character,
  raw output, cast(doc_id % 7 as bigint) mentions_counter, 'I don''t know|p;2' passages from raw_outputs""",
)
def q_predictions_csv(spark, sf):
    """A7 + A2: predictions with newlines, quotes and ';' in the output are
    written as ';' CSV and read back unchanged (one row per prediction)."""
    from charlens.sources.fixtures import view

    raw = view(spark, sf, "raw_outputs")
    pred = raw.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("Book"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("Character"),
        F.col("raw").alias("Output"),
        (F.col("doc_id") % 7).cast("bigint").alias("Mentions_counter"),
        F.array(F.lit("I don't know"), F.lit("p;2")).alias("Selected_passages"),
    )
    path = scratch_path(spark, "pred-csv")
    write_csv(pred, path, sep=";")
    back = read_predictions(spark, path)
    return back.select("book", "character", "output", "mentions_counter",
                       F.array_join("selected_passages", "|").alias("passages"))
