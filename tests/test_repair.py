"""Hand cases for the bulk repair job (FIXTURES.md section 4, repair table)."""

import pytest
from pyspark.sql import functions as F

from charlens.operators.repair import repair_outputs

CASES = [
    ('<think>x\ny</think>```json\n{"age": "adult"}\n```', {"age": "string"}, "age", "adult", "ok"),
    ('{"residence": None}', {"residence": "array<string>"}, "residence", None, "ok"),
    ('{"occupation": ["a, b", c]}', {"occupation": "array<string>"}, "occupation", ["a", "b", "c"], "ok"),
    ('{"spoken_languages": []}', {"spoken_languages": "array<string>"}, "spoken_languages", [""], "ok"),
    ('{"origin": ["country": "France", "city": "Paris"]}', {"origin": "array<string>"}, "origin",
     ["France", "Paris"], "ok"),
    ('{"origin": ["Europe"]: ["France"]}', {"origin": "array<string>"}, "origin", ["France"], "ok"),
    ('{"residence": ["country: France", "city: Paris"]}', {"residence": "array<string>"}, "residence",
     ["France", "Paris"], "ok"),
    ('{"residence": ["country": "France", "city": None]}', {"residence": "array<string>"}, "residence",
     ["France", "null"], "ok"),
    ('Answer: {"age": "adult"}', {"age": "string"}, "age", "adult", "ok"),
    ('{"age": "adult"} done', {"age": "string"}, "age", None, "unparsable"),
    ('{"a": 1} {"b": 2}', {"a": "string"}, "a", None, "unparsable"),
    (None, {"age": "string"}, "age", None, "missing"),
]


@pytest.mark.parametrize("raw,attrs,col,expected,status", CASES)
def test_repair_hand_cases(spark, raw, attrs, col, expected, status):
    df = spark.createDataFrame([(raw,)], "output string")
    r = repair_outputs(df, attrs).collect()[0]
    assert r["status"] == status
    assert r[col] == expected


def test_nested_type(spark):
    df = spark.createDataFrame([('{"type": {"is_human": true, "character_type": ""}}',)], "output string")
    r = repair_outputs(df, {"type": "struct<is_human:boolean,character_type:string>"}).collect()[0]
    assert r["type"]["is_human"] is True and r["type"]["character_type"] == ""


def test_fallback_that_cannot_repair_gives_all_null(spark):
    # traced by hand: the nested list breaks the first parse; the residence
    # fallback finds no key/value items, rebuilds [] and the text after the
    # list still does not parse -> every attribute null, row kept
    raw = '{"residence": ["country": ["France", "Italy"], "city": "Paris"],\n"age": "adult"}'
    df = spark.createDataFrame([(raw,)], "output string")
    r = repair_outputs(df, {"residence": "array<string>", "age": "string"}).collect()[0]
    assert (r["status"], r["residence"], r["age"]) == ("unparsable", None, None)


def test_load_and_clean_baseline_passthrough(spark):
    from charlens.plans.evaluation_job import load_and_clean

    df = spark.createDataFrame([('{"age": "adult"}',)], "output string")
    assert load_and_clean(df, "baseline", {"age": "string"}).columns == ["output"]
    assert load_and_clean(df, "raw", {"age": "string"}).first()["age"] == "adult"


def test_row_count_kept(spark):
    rows = [(c[0],) for c in CASES] * 3
    df = spark.createDataFrame(rows, "output string")
    assert repair_outputs(df, ["age"]).count() == len(rows)


def test_repair_stable_on_valid_json_without_lists(spark):
    raw = '{"age": "adult", "gender": "female"}'
    df = spark.createDataFrame([(raw,)], "output string")
    r = repair_outputs(df, ["age", "gender"]).collect()[0]
    assert (r["age"], r["gender"], r["status"]) == ("adult", "female", "ok")


def test_repeated_keys_without_a_session_setting(spark):
    """The last of repeated keys counts, kinds stay, and the session is left as it was."""
    from charlens.operators.repair import with_object

    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    rows = ['{"x": 1, "y": "5", "x": 2}', '{"x": [1, "a"], "x": {"k": null}, "z": "q\\"r"}', '{"a": {"b": 1, "b": 3}, "c": "t"}', '{"x": 1, "x": 2} tail',
            "{'x': 1, 'x': 2}", '{"x": 1', '{"x": 1, "x": null}', "{}", None]
    df = with_object(spark.createDataFrame(list(enumerate(rows)), "i int, j string"), "j", "v").withColumn("v", F.to_json("v"))
    want = ['{"x":2,"y":"5"}', '{"x":{"k":null},"z":"q\\"r"}', '{"a":{"b":3},"c":"t"}', None, None, None, '{"x":null}', "{}", None]
    assert [r["v"] for r in df.orderBy("i").collect()] == want
    # copies of the plan, as in a self join, give the same
    twice = df.join(df.select("i", F.col("v").alias("w")), "i").collect()
    assert all(r["v"] == r["w"] for r in twice)
    assert spark.conf.get(setting) == before
    assert spark.sql("""select try_parse_json('{"x":1,"x":2}') is null as refused""").first()["refused"] == (before == "false")
