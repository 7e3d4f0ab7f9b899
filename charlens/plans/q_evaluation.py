"""Registered evaluation-job queries (K3, D16, A10 report rows) on repaired outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.operators import metrics as M
from charlens.plans.evaluation_job import evaluate
from charlens.plans.q_repair import _REPAIR_GOLD_SQL, repaired_raw
from charlens.plans.registry import register, rounded
from charlens.plans.sql_oracle import report_sql
from charlens.sources.fixtures import view

EVAL_ATTRS = {"lang": "closed", "tags": "set", "type": "type"}


def _aligned(spark, sf):
    gold = view(spark, sf, "doc_gold").select(
        "doc_id",
        F.col("lang").alias("lang_gold"),
        F.array("source").alias("tags_gold"),
        F.col("type_gold"),
    )
    pred = repaired_raw(spark, sf).select(
        F.col("doc_id").alias("pid"),
        F.col("lang").alias("lang_pred"),
        F.col("tags").alias("tags_pred"),
        F.col("type").alias("type_pred"),
    )
    return M.align(gold, pred, [("doc_id", "pid")])


@register(
    "eval_lang_report",
    _REPAIR_GOLD_SQL + ", "
    + report_sql("select lower(d.lang) g, lower(r.lang) p from doc_gold d join rep r on d.doc_id=r.doc_id"),
)
def eval_lang_report(spark, sf):
    """Flagship: repair -> align -> per-class report for the language attribute."""
    return rounded(M.classification_report(_aligned(spark, sf), "lang_gold", "lang_pred"))


_SCORE_SQL = _REPAIR_GOLD_SQL + """,
a AS (select d.doc_id, d.lang lg, r.lang lp, [d.source] tg,
        coalesce(string_split(nullif(r.tags, ''), '|'), case when r.tags='' then [''] else []::varchar[] end) tp,
        d.type_gold, r.is_human
      from doc_gold d join rep r on d.doc_id=r.doc_id),
s AS (select doc_id,
  case when lg is not null and lp is not null then case when lower(lg)=lower(lp) then 1.0::double else 0.0::double end end score_lang,
  round(2.0*len(list_filter(list_distinct(tg), lambda x: list_contains(tp, x)))/(len(list_distinct(tg))+len(list_distinct(tp))), 6) score_tags,
  case when is_human is not null then case when coalesce(lower(type_gold)='human', false)=is_human then 1.0::double else 0.0::double end end score_is_human
 from a)
"""


@register("eval_scorecard", _SCORE_SQL + "select * from s")
def eval_scorecard(spark, sf):
    _, scores = evaluate(spark, _aligned(spark, sf), "doc_id", EVAL_ATTRS)
    return rounded(scores)


_REPORT_SQL = (
    _SCORE_SQL
    + """, mic AS (select sum(len(list_filter(list_distinct(tg), lambda x: list_contains(tp, x)))) tp_,
          sum(len(list_distinct(tp)) - len(list_filter(list_distinct(tg), lambda x: list_contains(tp, x)))) fp_,
          sum(len(list_distinct(tg)) - len(list_filter(list_distinct(tg), lambda x: list_contains(tp, x)))) fn_,
          count(*) n from a where len(tg)>0),
hum AS (select count(is_human) n, case when count(is_human)>0 then 100.0*sum(case when is_human then 1 else 0 end)/count(is_human) else 0 end v from a),
""" + report_sql("select lower(lg) g, lower(lp) p from a", ", lang_rows AS (select * from report_rows)")
    + ", type_rep AS (with " + report_sql(
        "select cast(coalesce(lower(type_gold)='human', false) as varchar) g, cast(is_human as varchar) p from a",
        "select * from report_rows") + ")"
    + """, cells AS (
  select 'lang' attribute, unnest(['precision','recall','f1']) metric, label, unnest(["precision",recall,f1]) v, support from lang_rows
  union all
  select 'type', unnest(['is_human_precision','is_human_recall','is_human_f1']), label, unnest(["precision",recall,f1]), support from type_rep
  union all select 'lang', 'gold_count', null, count(lg), count(*) from a
  union all select 'tags', 'gold_count', null, count(tg), count(*) from a
  union all select 'type', 'gold_count', null, count(type_gold), count(*) from a
  union all select 'tags', 'micro_f1', null, case when n>0 then 2.0*tp_/(2*tp_+fp_+fn_) end, n from mic
  union all select 'type', 'pct_human', null, v, n from hum)
select attribute, metric, label, round(cast(v as double), 6) "value", cast(support as bigint) support from cells
where v is not null""")


@register("eval_report", _REPORT_SQL)
def eval_report(spark, sf):
    """The whole K3 report over the repaired outputs."""
    rep, _ = evaluate(spark, _aligned(spark, sf), "doc_id", EVAL_ATTRS)
    return rounded(rep)
