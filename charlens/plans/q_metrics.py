"""Registered metric queries (closed, ordinal, set and vector attributes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.operators import metrics as M
from charlens.operators.relational import set_algebra
from charlens.plans.registry import register, rounded
from charlens.plans.running_evaluation import count_batch, running_report
from charlens.plans.sql_oracle import report_sql
from charlens.session import scratch_path
from charlens.sources.fixtures import view, with_clause


def _closed_aligned(spark, sf):
    c = view(spark, sf, "closed")
    gold = c.select("doc_id", "gold")
    pred = c.select(F.col("doc_id").alias("key"), "pred")
    return M.align(gold, pred, [("doc_id", "key")])


def _ordinal_aligned(spark, sf):
    o = view(spark, sf, "ordinal")
    gold = o.select("doc_id", "gold")
    pred = o.select(F.col("doc_id").alias("key"), "pred")
    return M.align(gold, pred, [("doc_id", "key")])


# ---- D9 / C8 / B8: classification report on the closed attribute -------------------
@register(
    "closed_report",
    with_clause("closed") + ", " + report_sql("select lower(gold) g, lower(pred) p from closed"),
)
def closed_report(spark, sf):
    return rounded(M.classification_report(_closed_aligned(spark, sf)))


@register(
    "running_report",
    with_clause("closed") + ", " + report_sql("select lower(gold) g, lower(pred) p from closed"),
)
def q_running_report(spark, sf):
    """The report after four batches.  Each batch sends the one before again with
    other predictions (the first stands), and the second is counted again at the end."""
    rows = _closed_aligned(spark, sf).select("doc_id", "gold", "pred")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    path = scratch_path(spark, "running-report")
    for n in (0, 1, 2, 3, 1):  # batches, not the data, set the number of rounds
        again = rows.where(part == n - 1).withColumn("pred", F.lit("other"))
        count_batch(rows.where(part == n).unionByName(again), path, "closed", n, ["doc_id"])
    return rounded(running_report(spark, path, "closed"))


# ---- D10 / D15 / C9: per-row scores -----------------------------------------------------
@register(
    "closed_row_scores",
    with_clause("closed")
    + """select doc_id, gold, pred,
  case when gold is not null and pred is not null then case when lower(gold)=lower(pred) then 1.0::double else 0.0::double end end score,
  case when gold is not null then case when coalesce(lower(gold)='en', false) = coalesce(lower(pred)='en', false) then 1 else 0 end end agree_en
from closed""",
)
def closed_row_scores(spark, sf):
    al = _closed_aligned(spark, sf)
    return al.select(
        "doc_id", "gold", "pred",
        M.exact_match().alias("score"),
        M.agreement(value="en").alias("agree_en"),
    )


# ---- D17: value profile of predictions --------------------------------------------
@register(
    "closed_pred_profile",
    with_clause("closed") + "select pred value, count(*) n from closed group by pred",
)
def closed_pred_profile(spark, sf):
    return M.value_profile(view(spark, sf, "closed"), "pred")


# ---- D6 / D7 / D8-style counts ----------------------------------------------------------
@register(
    "closed_counts",
    with_clause("closed")
    + """select count(gold) gold_count, count(pred) pred_count,
  round(case when count(pred)>0 then 100.0*sum(case when lower(pred)=lower(gold) then 1 else 0 end)/count(pred) else 0 end, 6) pct_true
from closed""",
)
def closed_counts(spark, sf):
    c = view(spark, sf, "closed")
    hit = F.when(F.col("pred").isNotNull(), F.lower("pred") == F.lower("gold"))
    return c.agg(
        F.count("gold").alias("gold_count"),
        F.count("pred").alias("pred_count"),
        F.round(M.share_true(hit), 6).alias("pct_true"),
    )


# ---- D9 + D11 on the ordinal attribute ------------------------------------------------
@register(
    "ordinal_report",
    with_clause("ordinal") + ", " + report_sql("select lower(gold) g, lower(pred) p from ordinal"),
)
def ordinal_report(spark, sf):
    return rounded(M.classification_report(_ordinal_aligned(spark, sf)))


# the weight by the distance of the classes in the order child, teenager, adult, senior:
# 1 for the same, 0.8 for neighbours, 0 otherwise and for other labels
_W_SQL = """w0t AS (select wg, wp, abs(i - j) d from (values ('child',0),('teenager',1),('adult',2),('senior',3)) a(wg,i),
  (values ('child',0),('teenager',1),('adult',2),('senior',3)) b(wp,j)),
w AS (select wg, wp, cast(case d when 0 then 1.0 when 1 then 0.8 else 0.0 end as double) w from w0t)"""

def _soft_sql(*extra: str) -> str:
    return (
    with_clause("ordinal", *extra)
    + ", "
    + _W_SQL
    + """,
soft AS (select o.doc_id, o.gold, o.pred,
  case when o.gold is not null and o.pred is not null then coalesce(w.w, 0.0::double) end soft_score
 from ordinal o left join w on lower(trim(o.gold))=w.wg and lower(trim(o.pred))=w.wp)
"""
    )


_SOFT_ROWS_SQL = _soft_sql()


@register("ordinal_soft_rows", _SOFT_ROWS_SQL + "select doc_id, gold, pred, soft_score from soft")
def ordinal_soft_rows(spark, sf):
    return M.soft_scores(_ordinal_aligned(spark, sf)).select("doc_id", "gold", "pred", "soft_score")


@register(
    "ordinal_soft_f1",
    _SOFT_ROWS_SQL
    + """select round(case when count(*)=0 then null when sum(soft_score)>0 then sum(soft_score)/count(*) else 0.0 end, 6) soft_f1,
  count(*) n_rows from soft where soft_score is not null""",
)
def ordinal_soft_f1(spark, sf):
    return rounded(M.soft_f1(M.soft_scores(_ordinal_aligned(spark, sf))))


# ---- C10 / C11: full outer merge of hard and soft score tables ------------------------
@register(
    "ordinal_merged_scores",
    _SOFT_ROWS_SQL
    + """, hard AS (select doc_id, case when gold is not null and pred is not null then
     case when lower(gold)=lower(pred) then 1.0::double else 0.0::double end end score from ordinal)
select coalesce(h.doc_id, s.doc_id) doc_id, h.score, s.soft_score,
  coalesce(s.soft_score, h.score) best_score
from hard h full outer join soft s on h.doc_id=s.doc_id""",
)
def ordinal_merged_scores(spark, sf):
    al = _ordinal_aligned(spark, sf)
    hard = al.select("doc_id", M.exact_match().alias("score"))
    soft = M.soft_scores(al).select(F.col("doc_id").alias("sid"), "soft_score")
    j = hard.join(soft, hard["doc_id"] == soft["sid"], "full_outer")
    return j.select(
        F.coalesce("doc_id", "sid").alias("doc_id"),
        "score",
        "soft_score",
        F.coalesce("soft_score", "score").alias("best_score"),
    )


# ---- D12 / D13 / G0d: label-set metrics --------------------------------------------
def _sets(spark, sf):
    users = view(spark, sf, "set_users")
    g = view(spark, sf, "sets_gold").groupBy("user_id").agg(F.collect_set("v").alias("gold"))
    p = view(spark, sf, "sets_pred").groupBy("user_id").agg(F.collect_set("v").alias("pred"))
    empty = F.array().cast("array<string>")
    return (
        users.join(g, "user_id", "left").join(p, "user_id", "left")
        .select("user_id", F.coalesce("gold", empty).alias("gold"), F.coalesce("pred", empty).alias("pred"))
    )


_SETS_SQL = with_clause("set_users", "sets_gold", "sets_pred") + """,
g AS (select user_id, list(distinct v) gold from sets_gold group by user_id),
p AS (select user_id, list(distinct v) pred from sets_pred group by user_id),
s AS (select u.user_id, coalesce(g.gold, []::varchar[]) gold, coalesce(p.pred, []::varchar[]) pred
      from set_users u left join g on u.user_id=g.user_id left join p on u.user_id=p.user_id),
c AS (select user_id, gold, pred, len(gold) n_gold, len(pred) n_pred,
      len(list_filter(gold, lambda x: list_contains(pred, x))) tp from s)
"""


@register(
    "sets_row_f1",
    _SETS_SQL
    + """select user_id, n_gold, n_pred, tp,
  case when n_gold=0 then null else round(2.0*tp/(n_gold+n_pred), 6) end f1,
  array_to_string(list_sort(list_distinct(list_concat(gold, pred))), '|') union_labels,
  array_to_string(list_sort(list_filter(gold, lambda x: list_contains(pred, x))), '|') common_labels,
  array_to_string(list_sort(list_filter(gold, lambda x: not list_contains(pred, x))), '|') gold_only
from c""",
)
def sets_row_f1(spark, sf):
    s = _sets(spark, sf)
    c = M.set_counts()
    alg = set_algebra(F.col("gold"), F.col("pred"))
    return s.select(
        "user_id",
        c["n_gold"].cast("bigint").alias("n_gold"),
        c["n_pred"].cast("bigint").alias("n_pred"),
        c["tp"].cast("bigint").alias("tp"),
        F.round(M.set_f1(), 6).alias("f1"),
        F.array_join(alg["union"], "|").alias("union_labels"),
        F.array_join(alg["intersection"], "|").alias("common_labels"),
        F.array_join(alg["gold_only"], "|").alias("gold_only"),
    )


@register(
    "sets_micro_f1",
    _SETS_SQL
    + """, r AS (select * from c where n_gold>0)
select case when count(*)>0 then round(2.0*sum(tp)/(2*sum(tp)+sum(n_pred-tp)+sum(n_gold-tp)), 6) end micro_f1,
  count(*) n_rows from r""",
)
def sets_micro_f1(spark, sf):
    return rounded(M.micro_set_f1(_sets(spark, sf)))


# ---- D16: consolidation of per-attribute score tables -------------------------------
@register(
    "consolidated_scores",
    _soft_sql("closed")
    + """, t1 AS (select doc_id, case when gold is not null and pred is not null then case when lower(gold)=lower(pred) then 1.0::double else 0.0::double end end x,
        case when gold is not null then case when coalesce(lower(gold)='en', false) = coalesce(lower(pred)='en', false) then 1.0::double else 0.0::double end end y
       from closed),
t2 AS (select doc_id, soft_score x, case when gold is not null and pred is not null then case when lower(gold)=lower(pred) then 1.0::double else 0.0::double end end z from soft),
u AS (select doc_id, x, y, null::double z, 0 k from t1 union all select doc_id, x, null, z, 1 from t2)
select doc_id, arg_min(x, k) filter (where x is not null) x, arg_min(y, k) filter (where y is not null) y,
       arg_min(z, k) filter (where z is not null) z
from u where doc_id is not null group by doc_id""",
)
def consolidated_scores(spark, sf):
    cl = _closed_aligned(spark, sf)
    t1 = cl.select(
        "doc_id", M.exact_match().alias("x"), M.agreement(value="en").cast("double").alias("y")
    )
    od = M.soft_scores(_ordinal_aligned(spark, sf))
    t2 = od.select("doc_id", F.col("soft_score").alias("x"), M.exact_match().alias("z"))
    return M.consolidate([t1, t2], ["doc_id"])


# ---- K0 + D14: similarity from stored vectors ---------------------------------------
_VEC_SQL = with_clause("vector_gold", "vector_pred") + """,
s AS (select g.vec_id, case when p.eb is not null then
   list_dot_product(g.ea::double[], p.eb::double[]) /
   (sqrt(list_dot_product(g.ea::double[], g.ea::double[])) * sqrt(list_dot_product(p.eb::double[], p.eb::double[])))
   else 0.0 end cos_sim, p.eb is not null has_pred
 from vector_gold g left join vector_pred p on g.vec_id=p.vec_id)
"""


def _vec_scored(spark, sf):
    g = view(spark, sf, "vector_gold")
    p = view(spark, sf, "vector_pred")
    j = g.join(p, "vec_id", "left")
    return j.select("vec_id", M.vector_similarity(j, "ea", "eb").alias("cos_sim"),
                    F.col("eb").isNotNull().alias("has_pred"), "ea")


@register("vector_similarity_rows", _VEC_SQL + "select vec_id, round(cos_sim, 6) cos_sim, has_pred from s")
def vector_similarity_rows(spark, sf):
    s = _vec_scored(spark, sf)
    return s.select("vec_id", F.round("cos_sim", 6).alias("cos_sim"), "has_pred")


@register(
    "vector_similarity_mean",
    _VEC_SQL + "select round(avg(coalesce(cos_sim, 0.0)), 6) mean_cos, count(*) n_gold from s",
)
def vector_similarity_mean(spark, sf):
    s = _vec_scored(spark, sf)
    return rounded(M.mean_similarity(s, F.col("ea").isNotNull(), "cos_sim"))


# ---- D18: greedy token-alignment F1 -----------------------------------------------------
_TOK_SQL = with_clause("token_vectors") + """,
g AS (select pair_id, tok_no, embedding::double[] e from token_vectors where side='gold'),
p AS (select pair_id, tok_no, embedding::double[] e from token_vectors where side='pred'),
sim AS (select g.pair_id, g.tok_no gt, p.tok_no pt,
   list_dot_product(g.e, p.e)/(sqrt(list_dot_product(g.e,g.e))*sqrt(list_dot_product(p.e,p.e))) s
   from g join p on g.pair_id=p.pair_id),
pr AS (select pair_id, avg(m) prec from (select pair_id, pt, max(s) m from sim group by pair_id, pt) x group by pair_id),
rc AS (select pair_id, avg(m) rec from (select pair_id, gt, max(s) m from sim group by pair_id, gt) x group by pair_id),
f AS (select pr.pair_id, prec, rec, case when prec+rec<>0 then 2*prec*rec/(prec+rec) else 0.0 end f1
      from pr join rc on pr.pair_id=rc.pair_id)
"""


def _token_f1(spark, sf):
    tv = view(spark, sf, "token_vectors")
    texts = tv.groupBy("pair_id").agg(
        F.collect_list(F.when(F.col("side") == "gold", F.col("embedding"))).alias("g"),
        F.collect_list(F.when(F.col("side") == "pred", F.col("embedding"))).alias("p"),
    )
    r = texts.select("pair_id", M.alignment_f1(F.col("g"), F.col("p")).alias("m"))
    return r.where(F.col("m.f").isNotNull()).select(
        "pair_id", F.col("m.p").alias("prec"), F.col("m.r").alias("rec"), F.col("m.f").alias("f1")
    )


@register(
    "token_alignment_f1",
    _TOK_SQL + "select pair_id, round(prec,6) prec, round(rec,6) rec, round(f1,6) f1 from f",
)
def token_alignment_f1(spark, sf):
    r = _token_f1(spark, sf)
    return r.select("pair_id", *[F.round(c, 6).alias(c) for c in ("prec", "rec", "f1")])


@register(
    "token_alignment_mean",
    _TOK_SQL + "select round(avg(f1), 6) mean_f1, count(*) n_pairs from f",
)
def token_alignment_mean(spark, sf):
    r = _token_f1(spark, sf)
    return r.agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.count("*").alias("n_pairs"))
