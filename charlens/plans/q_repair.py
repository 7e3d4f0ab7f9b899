"""Registered repair queries (H1-H10, B9, B10, B12, D6, D7) on ``raw_outputs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.functions.text import WS_CLASS
from charlens.operators import metrics as M
from charlens.operators.repair import repair_outputs, repair_summary
from charlens.plans.registry import register, rounded
from charlens.plans.sql_oracle import report_sql
from charlens.sources.fixtures import VIEWS, view, with_clause

ATTRS = {
    "lang": "string",
    "tags": "array<string>",
    "type": "struct<is_human:boolean,character_type:string>",
}


def repaired_raw(spark, sf):
    raw = view(spark, sf, "raw_outputs").withColumnRenamed("raw", "output")
    return repair_outputs(raw, ATTRS)


# ---- DuckDB twin of the repair chain (RE2 syntax, staged as CTEs) --------------
W = WS_CLASS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _brackets(src: str, col: str, dotall: bool, item: str) -> str:
    """SQL for one bracket pass over column ``col`` of CTE ``src``; ``item`` is
    a lambda body over ``x``."""
    body = r"[\s\S]*?" if dotall else r"[^\n]*?"
    return f"""(select *, case when len(cs)=0 then {col} else array_to_string(
   list_transform(range(1, len(gs)+1), lambda i: gs[i] || coalesce(fx[i], '')), '') end nj
 from (select *, list_transform(cs, lambda c: '[' || array_to_string(list_transform(string_split(c, ','),
        lambda x: {item}), ', ') || ']') fx
   from (select *, regexp_extract_all({col}, '\\[({body})\\]', 1) cs,
                string_split_regex({col}, '\\[{body}\\]') gs from {src}) a) b)"""


_QUOTE_ITEM = (
    f"case when regexp_matches({_strip('x')}, '^\"[^\"]*\"$') then {_strip('x')} "
    f"else '\"' || {_strip('x')} || '\"' end"
)
_SX = _strip("x")
_SAN_ITEM = (
    f"case when length({_SX}) - length(replace({_SX}, '\"', '')) > 2 "
    f"then '\"' || {_strip(f'replace({_SX}, ' + chr(39) + chr(34) + chr(39) + ', ' + chr(39) * 2 + ')')} || '\"' "
    f"when not starts_with({_SX}, '\"') then '\"' || {_SX} || '\"' else {_SX} end"
)

_P1 = f'"origin"{W}*:{W}*\\[{W}*((?:"[^"]+"{W}*:{W}*"[^"]+",?{W}*)+)\\]'
_P2 = f'(?s)"origin"{W}*:{W}*\\[[^\\[\\]]+\\]{W}*:{W}*(\\[[^\\[\\]]+\\])'

_REPAIR_SQL = with_clause("raw_outputs") + f""",
s1 AS (select doc_id, raw, {_strip(f"regexp_replace(replace(regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '```json{W}*', '', 'g'), '```', ''), ':{W}*None\\b', ': null', 'g')")} c from raw_outputs),
s2 AS (select doc_id, raw, regexp_extract(c, '(\\{{[\\s\\S]*\\}}){W}*$', 1) obj from s1),
s3 AS (select doc_id, raw, obj, case when regexp_extract(obj, '{_P1}', 0) <> '' then
   replace(obj, regexp_extract(obj, '{_P1}', 0), '"origin": [' || array_to_string(list_transform(
     regexp_extract_all(regexp_extract(obj, '{_P1}', 1), ':{W}*"([^"]+)"', 1), lambda v: '"' || v || '"'), ', ') || ']')
   else obj end j0 from s2),
s4 AS (select doc_id, raw, obj, regexp_replace(j0, '{_P2}', '"origin": \\1', 'g') j from s3),
s5 AS (select doc_id, raw, obj, nj j from {_brackets("s4", "j", False, _QUOTE_ITEM)} q),
s6 AS (select doc_id, raw, obj, nj j from {_brackets("s5", "j", True, _SAN_ITEM)} q),
s7 AS (select doc_id, raw, obj,
  replace(regexp_replace(regexp_replace(replace(replace(replace(
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(j,
     'continent{W}*: ', '', 'g'), 'country{W}*: ', '', 'g'), 'state{W}*: ', '', 'g'), 'city{W}*: ', '', 'g'),
     'any other available location information{W}*:', '', 'g'),
   '" [', '"'), ']],', '],'), '[""] ', '[""],') , '\\]{W}*\\],', '],', 'g'),
   '("\\]){W}*(")', '\\1,' || chr(10) || '\\2', 'g'), '''null'',', '') j from s6),
s8 AS (select doc_id, raw, obj,
  regexp_replace(j, '\\["\\["([^"]+)"+"', '["\\1"', 'g') j from s7),
s9 AS (select doc_id, raw, case when obj <> '' and json_valid(j) and json_type(j)='OBJECT' then j end pj from s8),
rep AS (select doc_id,
  case when raw is null then 'missing' when pj is not null then 'ok' else 'unparsable' end status,
  json_extract_string(pj, '$.lang') lang,
  array_to_string(from_json(json_extract(pj, '$.tags'), '["VARCHAR"]'), '|') tags,
  case when json_type(pj, '$.type')='OBJECT' then json_extract(pj, '$.type.is_human')::boolean end is_human,
  case when json_type(pj, '$.type')='OBJECT' then json_extract_string(pj, '$.type.character_type') end character_type
 from s9)
"""


@register("repair_outputs", _REPAIR_SQL + "select * from rep")
def q_repair_outputs(spark, sf):
    r = repaired_raw(spark, sf)
    return r.select(
        "doc_id", "status", "lang",
        F.array_join("tags", "|").alias("tags"),
        F.col("type.is_human").alias("is_human"),
        F.col("type.character_type").alias("character_type"),
    )


@register("repair_summary", _REPAIR_SQL + "select status, count(*) n from rep group by status")
def q_repair_summary(spark, sf):
    return repair_summary(repaired_raw(spark, sf))


# ---- B9 / D7 / D6: nested type extraction and share of humans --------------------
@register(
    "type_human_share",
    _REPAIR_SQL
    + """select count(is_human) n_pred, round(case when count(is_human)>0 then 100.0*sum(case when is_human then 1 else 0 end)/count(is_human) else 0 end, 6) pct_human,
  count(character_type) n_type from rep""",
)
def type_human_share(spark, sf):
    r = repaired_raw(spark, sf).select(F.col("type.is_human").alias("h"), F.col("type.character_type").alias("t"))
    return r.agg(
        F.count("h").alias("n_pred"),
        F.round(M.share_true("h"), 6).alias("pct_human"),
        F.count("t").alias("n_type"),
    )


# ---- B9 + D9 on is_human, B12 non-human subset ------------------------------------
_REPAIR_GOLD_SQL = _REPAIR_SQL.replace("WITH ", "WITH doc_gold AS (" + VIEWS["doc_gold"] + "),\n", 1)
_TYPE_GOLD = """, tg AS (select d.doc_id, d.type_gold, r.is_human, r.character_type from doc_gold d join rep r on d.doc_id=r.doc_id)
"""


def _type_aligned(spark, sf):
    gold = view(spark, sf, "doc_gold").select("doc_id", "type_gold")
    pred = repaired_raw(spark, sf).select(
        F.col("doc_id").alias("pid"),
        F.col("type.is_human").alias("is_human"),
        F.col("type.character_type").alias("character_type"),
    )
    al = M.align(gold, pred, [("doc_id", "pid")])
    # gold flag: missing gold type counts as not human (null-safe equality)
    return al.withColumn("gold_is_human", F.lower("type_gold").eqNullSafe("human"))


@register(
    "type_is_human_report",
    _REPAIR_GOLD_SQL
    + _TYPE_GOLD
    + ", "
    + report_sql(
        "select cast(coalesce(lower(type_gold)='human', false) as varchar) g, cast(is_human as varchar) p from tg"
    ),
)
def type_is_human_report(spark, sf):
    al = _type_aligned(spark, sf)
    return rounded(M.classification_report(al, "gold_is_human", "is_human", kind="bool"))


@register(
    "type_nonhuman_subset",
    _REPAIR_GOLD_SQL
    + _TYPE_GOLD
    + """select doc_id, type_gold, character_type from tg
 where not coalesce(lower(type_gold)='human', false) and is_human = false""",
)
def type_nonhuman_subset(spark, sf):
    al = _type_aligned(spark, sf)
    # A null gold type passes the "not human" test
    keep = ~F.lower("type_gold").eqNullSafe("human") & (F.col("is_human") == F.lit(False))
    return al.where(keep).select("doc_id", "type_gold", "character_type")


# ---- H3, H6, H7, H8: the rare damages, expected rows derived by hand ---------------
@register(
    "repair_damaged",
    with_clause("damaged_outputs") + """select doc_id,
 case doc_id%8 when 3 then 'repaired' when 7 then 'unparsable' else 'ok' end status,
 case doc_id%8 when 3 then source when 6 then source when 7 then null else 'adult' end age,
 case doc_id%8 when 0 then source || '|Lima' when 1 then source || '|Arica' end origin,
 case when doc_id%8 in (2, 4, 5) then source when doc_id%8 = 3 then '' end residence
from damaged_outputs""",
)
def q_repair_damaged(spark, sf):
    raw = view(spark, sf, "damaged_outputs").withColumnRenamed("raw", "output")
    r = repair_outputs(raw, {"age": "string", "origin": "array<string>", "residence": "array<string>"})
    return r.select("doc_id", "status", "age", F.array_join("origin", "|").alias("origin"),
                    F.array_join("residence", "|").alias("residence"))
