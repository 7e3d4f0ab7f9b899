"""Stream result equals batch result."""

import datetime

import __spark_entry__ as E
from charlens.streaming.jobs import stream_latest

SF = "/root/testdata/sf0.001"


def test_stream_repair_equals_batch(spark):
    q = E.queries()
    s = sorted(tuple(r) for r in q["stream_repair"](spark, SF).collect())
    b = sorted(tuple(r) for r in q["repair_outputs"](spark, SF).collect())
    assert s == b


def test_stream_repair_reads_a_table_of_several_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()["stream_repair"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in rows.collect())


def test_stream_dedup_one_row_per_key(spark):
    df = E.queries()["stream_dedup"](spark, SF)
    ids = [r[0] for r in df.select("event_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_stream_latest_over_batches(spark, tmp_path):
    """The best version stands whatever the order of arrival; late rows and open sessions do not show."""
    schema = "id string, at timestamp, version int, text string"
    rounds = [
        [("a", "10:00", 2, "a2"), ("b", "10:00", 1, "b1"), ("b", "10:05", 1, "b1 later"), (None, "10:01", 1, "none"), ("x", None, 1, "no time")],
        [("a", "10:20", 1, "a1"), ("c", "10:10", 1, "c1"), ("z", "20:00", 1, "z1")],
        [("a", "10:30", 9, "too late"), ("c", "22:00", 1, "c again"), ("z", "20:30", 2, "z2")],
        [("end", "23:55", 1, "open")],
    ]
    seen = []
    for n, rows in enumerate(rounds):
        rows = [(i, t and datetime.datetime(2024, 1, 1, int(t[:2]), int(t[3:])), v, x) for i, t, v, x in rows]
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream_latest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt", df.schema, ["id"], "at", "version")
        seen.append({(r["id"], r["version"], r["text"], r["copies"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    first = {("a", 2, "a2", 2), ("b", 1, "b1 later", 2), (None, 1, "none", 1), ("c", 1, "c1", 1)}
    assert seen[0] == set() and seen[1] == first and seen[2] == first
    assert seen[3] == first | {("z", 2, "z2", 2)}
