"""Metric hand cases (FIXTURES.md section 4) and properties."""

import pytest
from pyspark.sql import functions as F

from charlens.operators import metrics as M


def test_classification_report(spark):
    al = spark.createDataFrame([("m", "m"), ("f", "m"), ("f", "f")], "gold string, pred string")
    rep = {r["label"]: r for r in M.classification_report(al).collect()}
    assert rep["m"]["precision"] == 0.5 and rep["m"]["recall"] == 1.0 and rep["m"]["f1"] == pytest.approx(2 / 3)
    assert rep["m"]["support"] == 1
    assert rep["f"]["precision"] == 1.0 and rep["f"]["recall"] == 0.5 and rep["f"]["support"] == 2
    assert rep["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rep["macro avg"]["f1"] == pytest.approx(2 / 3)


def test_report_empty_gives_no_rows(spark):
    al = spark.createDataFrame([(None, "m")], "gold string, pred string")
    assert M.classification_report(al).count() == 0


def test_soft_f1_age(spark):
    al = spark.createDataFrame(
        [("adult", "adult"), ("child", "teenager"), ("senior", "child"), ("teenager", "adult")],
        "gold string, pred string")
    s = M.soft_scores(al)
    assert sorted(r["soft_score"] for r in s.collect()) == [0.0, 0.8, 0.8, 1.0]
    assert M.soft_f1(s).collect()[0]["soft_f1"] == pytest.approx(0.65)


def test_soft_f1_identity_weights_equal_accuracy(spark):
    al = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b"), ("c", "b")], "gold string, pred string")
    ident = {k: {k: 1.0} for k in "abc"}
    f = M.soft_f1(M.soft_scores(al, weights=ident)).collect()[0]["soft_f1"]
    acc = [r for r in M.classification_report(al).collect() if r["label"] == "accuracy"][0]["f1"]
    assert f == acc


def test_sets(spark):
    df = spark.createDataFrame([(["en", "fr"], ["en"]), ([], ["en"]), (["de"], [])],
                               "gold array<string>, pred array<string>")
    rows = [r[0] for r in df.select(M.set_f1()).collect()]
    assert rows == [pytest.approx(2 / 3), None, 0.0]
    assert M.micro_set_f1(df).collect()[0]["micro_f1"] == 0.5


def test_set_f1_symmetric(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "gold array<string>, pred array<string>")
    a = df.select(M.set_f1("gold", "pred")).first()[0]
    b = df.select(M.set_f1("pred", "gold")).first()[0]
    assert a == b


def test_mean_cosine_counts_missing_prediction_as_zero(spark):
    df = spark.createDataFrame([(1.0, True), (None, True), (None, False)], "cos_sim double, has_gold boolean")
    assert M.mean_similarity(df, F.col("has_gold"), "cos_sim").first()["mean_cos"] == 0.5


def test_agreement(spark):
    df = spark.createDataFrame([("Human", "human"), ("elf", "orc"), ("human", "elf"), (None, "human")],
                               "gold string, pred string")
    assert [r[0] for r in df.select(M.agreement(value="human")).collect()] == [1, 1, 0, None]


def test_non_human_subset_keeps_null_gold(spark):
    df = spark.createDataFrame([("elf", False), (None, False), ("human", False)], "g string, h boolean")
    keep = ~F.lower("g").eqNullSafe("human") & (F.col("h") == F.lit(False))
    assert sorted(str(r[0]) for r in df.where(keep).select("g").collect()) == ["None", "elf"]


def test_consolidate_first_non_null(spark):
    t1 = spark.createDataFrame([("k", None, 1.0)], "key string, x double, y double")
    t2 = spark.createDataFrame([("k", 2.0, 3.0)], "key string, x double, y double")
    r = M.consolidate([t1, t2], ["key"]).first()
    assert (r["x"], r["y"]) == (2.0, 1.0)


def test_alignment_f1_identical_texts(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [1.0, 0.0]])],
                               "g array<array<float>>, p array<array<float>>")
    r = df.select(M.alignment_f1(F.col("g"), F.col("p")).alias("m")).first()["m"]
    assert r["f"] == pytest.approx(1.0)


def test_align_dedups_keys(spark):
    g = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, gold string")
    p = spark.createDataFrame([("a", "z")], "pk string, pred string")
    assert M.align(g, p, [("k", "pk")]).count() == 1
