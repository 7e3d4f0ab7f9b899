"""K3 / D9 in increments: after n batches the state gives the report of all rows."""


from charlens.operators import metrics as M
from charlens.plans import running_evaluation as R

SCHEMA = "doc string, gold string, pred string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_equal_the_batch_report(spark, tmp_path):
    batches = [
        [("a", "x", "x"), ("b", "X", "y"), ("c", None, "x"), (None, "x", "x"), ("a", "x", "x")],
        [("a", "x", "y"), ("c", "x", "x"), ("d", "y", "Y")],  # a and c stand from before
        [],
        [("e", "z", None), ("f", "z", "x"), ("d", "y", "x")],
    ]
    first = {}
    for n, rows in enumerate(batches):
        R.count_batch(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "r1", n, ["doc"])
        for r in rows:
            if r[0] is not None:
                first.setdefault(r[0], r)
        whole = M.classification_report(spark.createDataFrame(list(first.values()), SCHEMA))
        assert rows_of(R.running_report(spark, str(tmp_path), "r1")) == rows_of(whole)
    before = rows_of(R.running_counts(spark, str(tmp_path), "r1"))
    R.count_batch(spark.createDataFrame(batches[1], SCHEMA), str(tmp_path), "r1", 1, ["doc"])
    assert rows_of(R.running_counts(spark, str(tmp_path), "r1")) == before
    assert before == [("x", 2, 2, 1), ("y", 1, 2, 1), ("z", 1, 0, 0)]


def test_runs_are_apart_and_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "state")
    assert R.running_report(spark, path, "none").count() == 0
    R.count_batch(spark.createDataFrame([], SCHEMA), path, "empty", 0, ["doc"])
    assert R.running_report(spark, path, "empty").count() == 0
    R.count_batch(spark.createDataFrame([("a", "true", "True")], SCHEMA), path, "one", 0, ["doc"], kind="bool")
    R.count_batch(spark.createDataFrame([("a", "true", "false")], SCHEMA), path, "two", 0, ["doc"], kind="bool")
    assert rows_of(R.running_counts(spark, path, "one")) == [("true", 1, 1, 1)]
    assert rows_of(R.running_counts(spark, path, "two")) == [("false", 0, 1, 0), ("true", 1, 0, 0)]
