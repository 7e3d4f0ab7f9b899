"""K3 rules: string types are an error, text-form sets, repeated keys, statement pruning."""

import pytest

from charlens.operators.repair import repair_outputs
from charlens.plans.evaluation_job import evaluate
from charlens.session import scratch_path
from charlens.sources import io


def test_text_type_is_an_error(spark):
    al = spark.createDataFrame([(1, "human", "human")], "k int, type_gold string, type_pred string")
    with pytest.raises(TypeError):
        evaluate(spark, al, "k", {"type": "type"})


def test_text_sets_and_counts(spark):
    al = spark.createDataFrame(
        [(1, "en, fr", "['en', 'de']"), (2, None, "en"), (None, "de", "de")],
        "k int, langs_gold string, langs_pred string")
    rep, scores = evaluate(spark, al, "k", {"langs": "set"})
    assert {r["k"]: r["score_langs"] for r in scores.collect()} == {1: 0.5, 2: None}
    lines = {r["metric"]: r for r in rep.collect()}
    assert lines["gold_count"]["value"] == 2 and lines["gold_count"]["support"] == 3
    # 2 hits; 1 + 0 wrong, 1 + 0 missed
    assert lines["micro_f1"]["value"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))


def test_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"age": "child", "age": "adult"}',)], "output string")
    r = repair_outputs(df, ["age"]).first()
    assert (r["status"], r["age"]) == ("ok", "adult")


def test_statement_filter_prunes_folders(spark):
    path = scratch_path(spark, "st")
    io.write_statements(spark.createDataFrame([("a", "p1", "x"), ("b", "p2", "y")], "s string, p string, o string"), path)
    st = io.read_statements(spark, path).where("p = 'p1'")
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    assert [tuple(r) for r in st.select("s", "o").collect()] == [("a", "x")]
