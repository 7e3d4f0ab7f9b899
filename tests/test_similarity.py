"""K0 from texts through the embedder plug-in, and the evaluation job's open kind."""

import pytest

from charlens.operators import metrics as M
from charlens.operators.inference import hashing_embed
from charlens.plans.evaluation_job import evaluate


def test_similarity_text_path(spark):
    df = spark.createDataFrame(
        [(1, "Paris, Lyon", ["Paris", "Lyon"]), (2, "Paris", None), (3, None, ["x"]), (4, "Rome", ["Oslo"])],
        "k int, gold string, pred array<string>")
    s = {r["k"]: r["cos_sim"] for r in M.similarity(df, "Identify the residence.", hashing_embed(64)).collect()}
    assert s[1] == pytest.approx(1.0, abs=1e-6)   # same values -> same text -> cosine 1
    assert s[2] == 0.0 and s[3] == 0.0            # missing prediction / gold -> 0
    assert -1.0 <= s[4] < 1.0


def test_evaluate_open_and_closed_kinds(spark):
    al = spark.createDataFrame(
        [(1, "m", "m", "Paris", ["Paris"]), (2, "f", "m", "Rome", ["Oslo"]), (3, "f", "f", None, None)],
        "k int, gender_gold string, gender_pred string, residence_gold string, residence_pred array<string>")
    rep, scores = evaluate(spark, al, "k", {"gender": "closed", "residence": "open"}, embed=hashing_embed(64))
    r = {(x["attribute"], x["metric"], x["label"]): x for x in rep.collect()}
    assert r[("gender", "f1", "accuracy")]["value"] == pytest.approx(0.666667)
    # mean cosine over rows with gold: (1 + cos(Rome, Oslo)) / 2
    assert r[("residence", "mean_cos", None)]["support"] == 2
    sc = {x["k"]: x for x in scores.collect()}
    assert sc[1]["score_gender"] == 1.0 and sc[1]["cos_sim_residence"] == pytest.approx(1.0, abs=1e-6)
    assert sc[3]["cos_sim_residence"] == 0.0


def test_unknown_kind_is_an_error(spark):
    al = spark.createDataFrame([(1, "x", "y")], "k int, native_language_gold string, native_language_pred string")
    with pytest.raises(ValueError):
        evaluate(spark, al, "k", {"native_language": "other"})
