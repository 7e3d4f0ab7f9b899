"""DuckDB oracle SQL fragments shared by several registered queries.

These strings are the independent check of the Spark jobs: plain SQL over the
fixture views, written from the metric definitions, never run by the library.
"""

from __future__ import annotations


def report_sql(aligned: str, final: str | None = None) -> str:
    """Classification report over a relation ``aligned`` with columns g, p;
    ``final`` replaces the closing select over ``report_rows``."""
    head = f"""
al AS (select g, p from ({aligned}) a where g is not null and p is not null),
e AS (select g label, 1 is_gold, 0 is_pred, case when g=p then 1 else 0 end tp from al
      union all select p, 0, 1, 0 from al),
lc AS (select label, sum(is_gold) support, sum(is_pred) predicted, sum(tp) tp from e group by label),
per AS (select label,
   case when predicted>0 then tp/predicted else 0.0 end "precision",
   case when support>0 then tp/support else 0.0 end recall,
   case when support+predicted>0 then 2.0*tp/(support+predicted) else 0.0 end f1,
   support, tp from lc),
tot AS (select sum(support) n, sum(tp) tp, avg("precision") mp, avg(recall) mr, avg(f1) mf,
   sum("precision"*support) wp, sum(recall*support) wr, sum(f1*support) wf from per),
report_rows AS (
 select label, "precision", recall, f1, support from per
 union all select 'accuracy', null, null, tp/n, n from tot where n>0
 union all select 'macro avg', mp, mr, mf, n from tot where n>0
 union all select 'weighted avg', wp/n, wr/n, wf/n, n from tot where n>0)
"""
    return head + (final or """select label, round("precision",6) "precision", round(recall,6) recall,
 round(f1,6) f1, cast(support as bigint) support from report_rows""")
