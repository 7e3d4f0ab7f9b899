"""Registered retrieval queries (G2, E2, E3, S13) on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.operators import retrieval as R
from charlens.plans.registry import register
from charlens.sources.fixtures import view, with_clause

K = 10

_SQL = with_clause("vector_queries", "vector_passages") + f""",
s AS (select q.grp, q.attr_no, p.passage_no,
        100.0 * list_dot_product(q.embedding::double[], p.embedding::double[]) score
      from vector_queries q join vector_passages p on q.grp=p.grp),
r AS (select *, row_number() over (partition by grp, attr_no order by score desc, passage_no desc) rank from s),
t AS (select * from r where rank <= {K})
"""


def _top(spark, sf):
    q = view(spark, sf, "vector_queries")
    p = view(spark, sf, "vector_passages")
    return R.top_passages(p, q, ["grp"], K)


@register(
    "top_passages",
    _SQL + "select grp, attr_no, passage_no, rank, round(score, 4) score from t",
)
def top_passages(spark, sf):
    t = _top(spark, sf)
    return t.select("grp", F.col("attr_no").cast("bigint").alias("attr_no"), "passage_no",
                    F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@register(
    "selected_passages",
    _SQL + """, f AS (select grp, passage_no, min(attr_no * 1000000 + rank) fk from t group by grp, passage_no)
select grp, passage_no, row_number() over (partition by grp order by fk) - 1 sel_order from f""",
)
def selected_passages(spark, sf):
    o = R.ordered_union(_top(spark, sf), ["grp"])
    return o.select("grp", "passage_no", F.col("sel_order").cast("bigint").alias("sel_order"))
