"""Evaluation metrics over an aligned gold/prediction table.

Every metric is one or two aggregates over the aligned rows; per-label and
per-row results are small.  Partial aggregation does the heavy part map-side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.functions.text import py_strip, to_bool
from charlens.functions.vectors import cosine
from charlens.operators.relational import dedup_first

# --- fixed values -----------------------------------------------------------
# Soft-F1 weights for the ordinal age attribute, gold -> prediction -> weight.
AGE_WEIGHTS: dict[str, dict[str, float]] = {
    "child": {"child": 1.0, "teenager": 0.8, "adult": 0.0, "senior": 0.0},
    "teenager": {"child": 0.8, "teenager": 1.0, "adult": 0.8, "senior": 0.0},
    "adult": {"teenager": 0.8, "adult": 1.0, "senior": 0.8, "child": 0.0},
    "senior": {"adult": 0.8, "senior": 1.0, "teenager": 0.0, "child": 0.0},
}
# ---------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- C8 alignment -------------------------------------------------------------
def align(
    gold: DataFrame,
    pred: DataFrame,
    on: Sequence[tuple[str, str]],
    dedup: bool = True,
    gold_order: Sequence[str] | None = None,
    pred_order: Sequence[str] | None = None,
) -> DataFrame:
    """Inner equi-join of gold and predictions on ``[(gold_key, pred_key), ...]``.

    Rows without a partner vanish on both sides; null keys never match (pandas
    would pair null with null -- documented difference).  With ``dedup`` each
    side is first reduced to one row per key (keep-first, E1), so a duplicated
    key cannot fan out the join.
    """
    gk = [g for g, _ in on]
    pk = [p for _, p in on]
    if dedup:
        gold = dedup_first(gold, gk, gold_order)
        pred = dedup_first(pred, pk, pred_order)
    cond = [gold[g] == pred[p] for g, p in on]
    out = gold.join(pred, cond, "inner")
    # keep the gold key names once
    for g, p in on:
        if g != p:
            out = out.drop(pred[p])
    return out


def both_present(gold, pred) -> Column:
    """B8."""
    return _c(gold).isNotNull() & _c(pred).isNotNull()


# ---- D9 classification report ---------------------------------------------------
def _labels(gold, pred, kind: str) -> tuple[Column, Column]:
    if kind == "bool":
        return to_bool(gold).cast("string"), to_bool(pred).cast("string")
    # string predictions: both sides lower-cased, not trimmed
    return F.lower(_c(gold).cast("string")), F.lower(_c(pred).cast("string"))


def labelled(aligned: DataFrame, gold="gold", pred="pred", kind: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, g, p): the labels of each row, null where it has none."""
    g, p = _labels(gold, pred, kind)
    return aligned.select(*keep, g.alias("g"), p.alias("p"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per-label (support, predicted, tp) of labels ``g`` and ``p`` in one pass: each row
    emits a gold and a pred entry; one grouped sum with map-side combine.  Counts of
    disjoint sets of rows add up.  Rows without one of the labels do not count."""
    rows = rows.where(F.col("g").isNotNull() & F.col("p").isNotNull())
    ent = F.explode(
        F.array(
            F.struct(F.col("g").alias("label"), F.lit(1).alias("is_gold"), F.lit(0).alias("is_pred"),
                     (F.col("g") == F.col("p")).cast("int").alias("tp")),
            F.struct(F.col("p").alias("label"), F.lit(0).alias("is_gold"), F.lit(1).alias("is_pred"),
                     F.lit(0).alias("tp")),
        )
    ).alias("e")
    return (
        rows.select(ent)
        .groupBy(F.col("e.label").alias("label"))
        .agg(
            F.sum("e.is_gold").alias("support"),
            F.sum("e.is_pred").alias("predicted"),
            F.sum("e.tp").alias("tp"),
        )
    )


def label_counts(aligned: DataFrame, gold="gold", pred="pred", kind: str = "string") -> DataFrame:
    """Per-label (support, predicted, tp) of aligned rows."""
    return pair_counts(labelled(aligned.where(both_present(gold, pred)), gold, pred, kind))


def classification_report(aligned: DataFrame, gold="gold", pred="pred", kind: str = "string") -> DataFrame:
    """Per-label precision/recall/F1/support plus accuracy, macro and
    weighted averages; zero division gives 0; no aligned rows -> no rows."""
    return report_of(label_counts(aligned, gold, pred, kind))


def report_of(lc: DataFrame) -> DataFrame:
    """The report of per-label counts."""
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    per = lc.select("label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    "support", "tp")
    tot = per.agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    ).where(F.col("n") > 0)
    overall = tot.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1")),
                F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                         F.col("mr").alias("recall"), F.col("mf").alias("f1")),
                F.struct(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                         (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1")),
            )
        ).alias("r"),
        F.col("n").alias("support"),
    ).select("r.*", "support")
    out = per.drop("tp").unionByName(overall)
    return out.select(
        "label",
        "precision", "recall", "f1",
        F.col("support").cast("bigint").alias("support"),
    )


# ---- per-row scores ----------------------------------------------------------------
def exact_match(gold="gold", pred="pred", kind: str = "string") -> Column:
    """1.0/0.0 where both sides present, null otherwise."""
    g, p = _labels(gold, pred, kind)
    return F.when(both_present(gold, pred), (g == p).cast("double"))


def agreement(gold="gold", pred="pred", value: str = "human") -> Column:
    """1 when gold and prediction both are, or both are not, ``value``;
    null where gold is missing."""
    v = value.lower()
    gi = F.coalesce(F.lower(_c(gold)) == v, F.lit(False))
    pi = F.coalesce(F.lower(_c(pred)) == v, F.lit(False))
    return F.when(_c(gold).isNotNull(), (gi == pi).cast("int"))


def soft_score(gold="gold", pred="pred", weights: Mapping[str, Mapping[str, float]] = AGE_WEIGHTS) -> Column:
    """D11 per row: the weight of the trimmed, lower-cased pair, from a literal map
    (no join); pairs not in it weigh 0; null where a side is missing."""
    pairs = [x for g, row in weights.items() for p, w in row.items()
             for x in (F.lit(f"{g}\n{p}"), F.lit(float(w)))]
    # trimmed text holds no line feed at its ends, so the joined key is unambiguous for trimmed labels
    key = F.concat(F.lower(py_strip(_c(gold))), F.lit("\n"), F.lower(py_strip(_c(pred))))
    weight = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double")
    return F.when(both_present(gold, pred), F.coalesce(weight, F.lit(0.0)))


def soft_scores(aligned: DataFrame, gold="gold", pred="pred",
                weights: Mapping[str, Mapping[str, float]] = AGE_WEIGHTS) -> DataFrame:
    """``aligned`` with its ``soft_score``."""
    return aligned.withColumn("soft_score", soft_score(gold, pred, weights))


def soft_f1(scored: DataFrame) -> DataFrame:
    """D11 summary: every row has one gold and one prediction, so precision =
    recall = mean weight and F1 equals it; no rows -> null."""
    r = scored.where(F.col("soft_score").isNotNull()).agg(
        F.sum("soft_score").alias("tpw"), F.count("*").alias("n")
    )
    f1 = F.when(F.col("n") == 0, F.lit(None)).when(F.col("tpw") > 0, F.col("tpw") / F.col("n")).otherwise(0.0)
    return r.select(f1.alias("soft_f1"), F.col("n").alias("n_rows"))


# ---- set metrics -----------------------------------------------------------------
def set_counts(gold="gold", pred="pred") -> dict[str, Column]:
    empty = F.array().cast("array<string>")
    g = F.array_distinct(F.coalesce(_c(gold), empty))
    p = F.array_distinct(F.coalesce(_c(pred), empty))
    tp = F.size(F.array_intersect(g, p))
    return {"n_gold": F.size(g), "n_pred": F.size(p), "tp": tp}


def set_f1(gold="gold", pred="pred") -> Column:
    """Per-row F1 of label sets; empty gold -> null, empty prediction -> 0."""
    c = set_counts(gold, pred)
    return F.when(c["n_gold"] == 0, F.lit(None)).otherwise(
        2.0 * c["tp"] / (c["n_gold"] + c["n_pred"])
    )


def micro_set_f1(rows: DataFrame, gold="gold", pred="pred") -> DataFrame:
    """Micro F1 over rows with non-empty gold; none -> null."""
    c = set_counts(gold, pred)
    r = rows.select(c["n_gold"].alias("ng"), c["n_pred"].alias("np"), c["tp"].alias("tp")).where(
        F.col("ng") > 0
    )
    s = r.agg(
        F.sum("tp").alias("tp"),
        F.sum(F.col("np") - F.col("tp")).alias("fp"),
        F.sum(F.col("ng") - F.col("tp")).alias("fn"),
        F.count("*").alias("n"),
    )
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return s.select(
        F.when((F.col("n") > 0) & (den > 0), 2.0 * F.col("tp") / den)
        .when(F.col("n") > 0, F.lit(0.0))
        .alias("micro_f1"),
        F.col("n").alias("n_rows"),
    )


# ---- counts ------------------------------------------------------------------------
def gold_count(df: DataFrame, col: str) -> Column:
    """D6."""
    return F.count(F.col(col))


def share_true(col) -> Column:
    """Percent of true among non-null values; 0 when none (aggregate)."""
    c = _c(col)
    n = F.count(c)
    return F.when(n > 0, 100.0 * F.sum(c.cast("int")) / n).otherwise(0.0)


def value_profile(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with their counts."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def type_profile(df: DataFrame, col: str) -> DataFrame:
    """The kinds of value a VARIANT column holds, with their counts."""
    return df.groupBy(F.schema_of_variant(_c(col)).alias("kind")).agg(F.count("*").alias("n"))


# ---- D16 consolidation ------------------------------------------------------------
def consolidate(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Stack score tables (attribute order = list order) and keep, per key
    and column, the first non-null value; rows with a null key are dropped."""
    tagged = [t.withColumn("_attr_no", F.lit(i)) for i, t in enumerate(tables)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    keys = list(keys)
    for k in keys:
        u = u.where(F.col(k).isNotNull())
    cols = [c for c in u.columns if c not in keys and c != "_attr_no"]
    aggs = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_attr_no"))).alias(c) for c in cols
    ]
    return u.groupBy(*keys).agg(*aggs)


# ---- similarity (K0, D14, D18) --------------------------------------------------
def mean_similarity(scored: DataFrame, gold_present: Column, score="cos_sim") -> DataFrame:
    """Mean score over rows with gold; a missing prediction counts 0."""
    return scored.agg(
        F.avg(F.when(gold_present, F.coalesce(_c(score), F.lit(0.0)))).alias("mean_cos"),
        F.count(F.when(gold_present, 1)).alias("n_gold"),
    )


def vector_similarity(aligned: DataFrame, gold_vec="ea", pred_vec="eb") -> Column:
    """K0 score from stored vectors: cosine, 0.0 when a side is missing."""
    return F.coalesce(
        F.when(_c(gold_vec).isNotNull() & _c(pred_vec).isNotNull(), cosine(gold_vec, pred_vec)),
        F.lit(0.0),
    )


def similarity(
    aligned: DataFrame,
    task: str,
    embed: Callable[[pd.Series], pd.Series],
    gold: str = "gold",
    pred: str = "pred",
    score: str = "cos_sim",
) -> DataFrame:
    """K0 from texts: values -> instruction texts (S8, S12) -> each *distinct*
    text embedded once by the plug-in (U1) -> vectors joined back -> cosine.

    gold/pred are strings (split on ', ') or arrays; the score stays 0.0 when
    gold is missing or the prediction is not a list.
    """
    from charlens.functions.text import instruct_text, split_comma_blank
    from charlens.operators.inference import embed_distinct, text_key

    def as_list(c: str) -> Column:
        dt = dict(aligned.dtypes)[c]
        return split_comma_blank(c) if dt == "string" else F.col(c)

    a = aligned.withColumn("_gl", as_list(gold)).withColumn("_pl", as_list(pred))
    ok = F.col(gold).isNotNull() & F.col("_pl").isNotNull()
    a = a.withColumn("_gt", F.when(ok, instruct_text(F.lit(task), F.col("_gl")))).withColumn(
        "_pt", F.when(ok, instruct_text(F.lit(task), F.col("_pl")))
    )
    texts = a.select(F.col("_gt").alias("text")).union(a.select(F.col("_pt").alias("text")))
    vecs = embed_distinct(texts, embed)
    a = a.withColumn("_gt", text_key("_gt")).withColumn("_pt", text_key("_pt"))
    gv = vecs.select(F.col("key").alias("_gt"), F.col("vec").alias("_gv"))
    pv = vecs.select(F.col("key").alias("_pt"), F.col("vec").alias("_pv"))
    j = a.join(gv, "_gt", "left").join(pv, "_pt", "left")
    return j.withColumn(score, F.coalesce(cosine("_gv", "_pv"), F.lit(0.0))).drop(
        "_gl", "_pl", "_gt", "_pt", "_gv", "_pv"
    )


def _greedy_match_batch(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    ps, rs, fs = [], [], []
    for g, p in zip(gold, pred):
        if g is None or p is None or len(g) == 0 or len(p) == 0:
            ps.append(None), rs.append(None), fs.append(None)
            continue
        gm = np.vstack([np.asarray(v, dtype=np.float64) for v in g])
        pm = np.vstack([np.asarray(v, dtype=np.float64) for v in p])
        gm /= np.linalg.norm(gm, axis=1, keepdims=True)
        pm /= np.linalg.norm(pm, axis=1, keepdims=True)
        sim = pm @ gm.T  # one matrix product per text pair
        prec = float(sim.max(axis=1).mean())
        rec = float(sim.max(axis=0).mean())
        f = 2 * prec * rec / (prec + rec) if prec + rec != 0 else 0.0
        ps.append(prec), rs.append(rec), fs.append(f)
    return pd.DataFrame({"p": ps, "r": rs, "f": fs})


def alignment_f1(gold_tokens: Column, pred_tokens: Column) -> Column:
    """Greedy best-match F1 over token vectors (published BERTScore
    definition, no idf, no rescaling); one matrix product per text pair."""
    from charlens.functions.text import arrow_udf

    return arrow_udf(_greedy_match_batch, "struct<p:double,r:double,f:double>")(gold_tokens, pred_tokens)
