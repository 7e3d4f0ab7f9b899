"""Plan properties: no nested-loop/cartesian joins in the theta-like joins,
scans pruned, fold UDF evaluated once."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_match_has_no_nested_loop(spark):
    p = plan(E.queries()["catalog_flags"](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_mentions_have_no_nested_loop_and_one_python_fold(spark):
    df = E.queries()["mention_candidates"](spark, SF)
    p = plan(df)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    evals = [ln for ln in p.splitlines() if "ArrowEvalPython" in ln and "_find_batch" in ln]
    assert len(evals) == 1


def test_scan_prunes_columns(spark):
    df = E.queries()["closed_report"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p or "doc_id" in p
    assert "text:string" not in p


def test_pattern_filter_pushed_to_scan(spark):
    p = plan(E.queries()["books_with_id"](spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_mentions_ship_no_token_array(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = E.queries()["mention_candidates"](spark, SF)._jdf.queryExecution().toString()
        lines = p[p.index("== Physical Plan =="):].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    for i, line in enumerate(lines):
        if "Exchange" in line and "REPARTITION_BY_COL" in line:
            assert "toks#" not in lines[i + 1], lines[i + 1]


def test_mentions_shuffle_the_text_once(spark):
    """Both readers of the blocks share one exchange; nothing else moves text."""
    df = E.queries()["mentions"](spark, SF)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    final = p[p.index("== Final Plan =="):p.index("== Initial Plan ==")] if "== Final Plan ==" in p else p
    moved = [ln for ln in final.splitlines() if "hashpartitioning(url" in ln and "REPARTITION_BY_COL" in ln and "ReusedExchange" not in ln]
    assert len(moved) == 1 and "ReusedExchange" in final


def test_star_pattern_shuffles_the_statements_once(spark):
    """One aggregation by subject; the other joins are with labels."""
    from charlens.operators.graph import star_books
    from charlens.sources.fixtures import view

    st = view(spark, SF, "triples")
    df = star_books(st, spark.createDataFrame([], "id string, label string, lang string"), "1999-01-01", "1-URGENT")
    p = plan(df)
    assert sum("hashpartitioning(s#" in ln for ln in p.splitlines()) == 1
    # each of the five kinds of statement is read once, and folded before it moves
    assert p.count("FileScan") == 5 and "partial_collect_set" in p
