"""Inputs that used to break an operator."""

from pyspark.sql import functions as F

from charlens.operators import graph as G
from charlens.operators import repair as RP
from charlens.operators.inference import infer
from charlens.operators.relational import dedup_first
from charlens.sources import io

LABELS = "id string, label string, lang string"


def test_long_origin_list_is_collapsed(spark):
    pairs = ", ".join(f'"k{i}": "v{i}"' for i in range(5000))
    text = '{"origin": [' + pairs + '], "age": "adult"}'
    out = spark.createDataFrame([(text,)], "j string").select(RP.collapse_origin(F.col("j"))).first()[0]
    assert out.startswith('{"origin": ["v0", "v1"') and out.endswith('"v4999"], "age": "adult"}')


def test_unreadable_date_is_no_match(spark):
    st = spark.createDataFrame(
        [(b, p, o) for b, d in (("b1", "1900-01-01"), ("b2", "unknown"), ("b3", "2001-01-01"))
         for p, o in (("genre", "novel"), ("date", d), ("author", "a"), ("character", "c"), ("catalog_id", "1"))], "s string, p string, o string")
    labels = spark.createDataFrame([("b1", "T", "en"), ("a", "A", "en")], LABELS)
    assert [r["book"] for r in G.match_books(st, labels, "1950-01-01", "novel").collect()] == ["b1"]


def test_apostrophes_in_passages(spark, tmp_path):
    path = str(tmp_path / "p")
    values = [('["I don\'t know", "p2"]',), ("['a', 'b']",), (None,)]
    df = spark.createDataFrame(values, "selected_passages string").select(
        *[F.col(c.name) if c.name.lower() == "selected_passages" else F.lit("1").alias(c.name) for c in io.PRED_SCHEMA])
    io.write_csv(df.coalesce(1), path, sep=";")
    got = [r["selected_passages"] for r in io.read_predictions(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [["I don't know", "p2"], ["a", "b"], None]))


def test_keep_first_prefers_values_and_takes_variants(spark):
    df = spark.createDataFrame([("k", None, "{}"), ("k", "en", '{"a":1}')], "key string, lang string, j string")
    rows = dedup_first(df.select("key", "lang", F.parse_json("j").alias("v")), ["key"]).select("lang").collect()
    assert [r["lang"] for r in rows] == ["en"]


def test_one_bad_prompt_fails_alone(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(f"p{i}" if i != 7 else "bad",) for i in range(20)], "prompt string").coalesce(1)
    status = [r["status"] for r in infer(df, model).collect()]
    assert status.count("error") == 1 and status.count("ok") == 19
