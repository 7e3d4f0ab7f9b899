"""Tool-call linking, in DataFrame functions only.

Calls and results are joined by identifier, calls are put in topological order of what
they wait for, their JSON arguments are validated against argument schemas, and each
linked call is written as canonical JSON: keys sorted, no white space, one line.

Inputs: ``calls`` (call_id, position, tool, arguments, after: list of call ids),
``results`` (call_id, content), ``schemas`` (tool, argument, kind, required), kinds being
string, integer, number, boolean, array, object.

Order: ``level`` 0 waits for nothing, any other call's level is one above the highest it
waits for; sort by (level, position, call_id).  Rounds peel one level each.

Defined cases.  Calls that repeat an id: the least (position, tool, arguments) stands,
``copies`` counts them, all their ``after`` entries count.  Results that repeat an id:
the least content.  Results without a call are rows of status ``orphan``; calls or
results without an id are rows of status ``no_id`` and are not linked.  An ``after`` id
without a call is ``dangling`` and waits for nothing.  Calls on a cycle, or behind one,
are ``cyclic`` and have no level.  Arguments that are not one JSON object without repeated
keys are the error ``malformed``; null arguments are the empty object.  A null
content is a result that is null.  A tool without schema rows takes any arguments.
Empty tables give what follows from the above; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    body = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(body, F.lit(2), F.length(body) - 2))


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text; null if it does not parse or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, level) of ids and edges (call_id waits for parent); cyclic ids are missing."""
    left = X.cut(calls.select("call_id").distinct())
    waits = X.cut(edges.join(left.select(F.col("call_id").alias("parent")), "parent").select("call_id", "parent").distinct())
    out, level = None, 0
    while True:
        ready = left if waits.isEmpty() else left.join(waits.select("call_id").distinct(), "call_id", "left_anti")
        ready = X.cut(ready)
        if ready.isEmpty():
            break
        done = ready.select("call_id", F.lit(level).alias("level"))
        out = done if out is None else out.unionByName(done)
        if waits.isEmpty():
            break
        left = X.cut(left.join(ready, "call_id", "left_anti"))
        waits = X.cut(waits.join(ready.select(F.col("call_id").alias("parent")), "parent", "left_anti"))
        level += 1
    return out if out is not None else left.select("call_id", F.lit(0).alias("level")).limit(0)


def kind_of(value: str) -> Column:
    """Schema kind of a variant column."""
    t = F.schema_of_variant(value)
    return (F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t.startswith("ARRAY"), "array")
            .when(t.startswith("OBJECT"), "object").otherwise("null"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors): sorted errors of each call with any; ids are distinct."""
    spark = calls.sparkSession
    parsed = calls.withColumn("v", F.try_parse_json(F.coalesce("arguments", F.lit("{}"))))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = parsed.where(~good).select("call_id", F.lit("malformed").alias("error"))
    fine = parsed.where(good).select("call_id", "tool", "v")
    given = (fine.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "argument", "value"))
             .select("call_id", "tool", "argument", kind_of("value").alias("got")))
    rules = schemas.groupBy("tool", "argument").agg(F.min("kind").alias("kind"), F.max("required").alias("required"))
    known = rules.select(F.col("tool").alias("t")).distinct()
    joined = given.join(rules, ["tool", "argument"], "left").join(known, F.col("tool") == F.col("t"))
    wrong = (F.when(F.col("kind").isNull(), F.concat(F.lit("unknown "), "argument"))
             .when((F.col("kind") != F.col("got")) & ~((F.col("kind") == "number") & (F.col("got") == "integer")),
                   F.concat(F.lit("type "), "argument")))
    typed = joined.select("call_id", wrong.alias("error")).where("error is not null")
    needed = fine.select("call_id", "tool").join(rules.where("required"), "tool").select("call_id", "argument")
    missing = (needed.join(given.select("call_id", "argument"), ["call_id", "argument"], "left_anti")
               .select("call_id", F.concat(F.lit("missing "), "argument").alias("error")))
    return (bad.unionByName(typed).unionByName(missing).groupBy("call_id")
            .agg(F.array_sort(F.collect_set("error")).alias("errors")))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, position, tool, status, level, copies, dangling, errors, message) of each call and each loose result.

    ``status``: ok, invalid (errors), no_result, cyclic, orphan or no_id; of several
    the last in the order ok, no_result, invalid, cyclic.
    """
    named = calls.where("call_id is not null")
    first = named.groupBy("call_id").agg(F.min(F.struct("position", "tool", "arguments")).alias("c"), F.count("*").alias("copies"))
    stand = X.cut(first.select("call_id", "c.*", "copies"))
    edges = named.select("call_id", F.explode("after").alias("parent")).where("parent is not null").distinct()
    order = levels(stand, edges)
    loose = (edges.join(stand.select(F.col("call_id").alias("parent")), "parent", "left_anti")
             .groupBy("call_id").agg(F.count("*").alias("dangling")))
    wrong = validated(stand, schemas)
    answer = (results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"))
              .withColumn("answered", F.lit(True)))
    whole = (stand.withColumn("called", F.lit(True)).join(answer, "call_id", "full").join(order, "call_id", "left")
             .join(loose, "call_id", "left").join(wrong, "call_id", "left"))
    whole = whole.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    status = (F.when(F.col("called").isNull(), "orphan").when(F.col("level").isNull(), "cyclic")
              .when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "no_result").otherwise("ok"))
    arguments = F.coalesce(canonical(F.coalesce("arguments", F.lit("{}"))), quoted(F.col("arguments")))
    message = F.concat(F.lit('{"arguments":'), F.when(F.col("called").isNull(), F.lit("null")).otherwise(arguments),
                       F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("tool")),
                       F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    done = whole.select("call_id", "position", "tool", status.alias("status"), "level", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
                        F.coalesce("dangling", F.lit(0)).cast("bigint").alias("dangling"), "errors", message.alias("message"))
    blank = lambda rows, position, tool: rows.where("call_id is null").select(
        F.lit(None).cast("string").alias("call_id"), position.cast("bigint").alias("position"), tool.cast("string").alias("tool"),
        F.lit("no_id").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(0).cast("bigint").alias("dangling"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("message"))
    return done.unionByName(blank(calls, F.col("position"), F.col("tool"))).unionByName(blank(results, F.lit(None), F.lit(None)))
