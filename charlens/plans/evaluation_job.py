"""K3: the evaluation job -- gold and prediction files to one report and one
consolidated score row per entity.

Metric dispatch by attribute kind (every kind also reports D6, its gold count):

=========  ===========================================================
closed     D9 report + D10 per-row exact match
ordinal    D9 + D10 + D11 soft F1 (weights given)
set        D12 per-row set F1 + D13 micro F1; text values by S7/S9
open       K0 cosine (vectors by the ``embed`` plug-in) + D14 mean,
           D18 (token vectors by the ``token_embed`` plug-in)
type       B9 extraction, D7 share of humans, D9 on is_human,
           K0 + D14 on the non-human subset (B12)
=========  ===========================================================

An attribute of another kind is an error, and so is a ``type`` prediction that
is text instead of a struct.  ``aligned`` is checkpointed once; all per-row scores
are columns of that one frame, never separate tables joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charlens.functions.text import (list_to_text, parse_list_literal, py_strip, split_comma_blank,
                                     split_list)
from charlens.operators import metrics as M
from charlens.operators.relational import union_all
from charlens.session import checkpoint_root
from charlens.sources import io

KINDS = ("closed", "ordinal", "set", "open", "type")
TYPE_STRUCT = "struct<is_human:boolean,character_type:string>"


def _line(df: DataFrame, attr: str, metric: str, value, support) -> DataFrame:
    return df.select(F.lit(attr).alias("attribute"), F.lit(metric).alias("metric"),
                     F.lit(None).cast("string").alias("label"),
                     F.col(value).cast("double").alias("value"), F.col(support).cast("bigint").alias("support"))


def _report_lines(rep: DataFrame, attr: str, prefix: str = "") -> DataFrame:
    """Precision, recall and F1 of each label as report rows."""
    cells = F.array(*[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).alias("value"))
                      for m in ("precision", "recall", "f1")])
    return rep.select(F.lit(attr).alias("attribute"), "label", "support", F.explode(cells).alias("c")).where(
        F.col("c.value").isNotNull()).select(
        "attribute", "c.metric", "label", "c.value", F.col("support").cast("bigint").alias("support"))


def as_items(df: DataFrame, col: str) -> Column:
    """A label set held as a list, as list-literal text (S9) or as comma text."""
    c = F.col(col)
    if dict(df.dtypes)[col] != "string":
        return c
    return F.when(c.isNotNull(), F.when(py_strip(c).startswith("["), parse_list_literal(py_strip(c))).otherwise(split_list(c)))


def _embedder(embed, attr: str):
    if embed is None:
        raise ValueError(f"attribute {attr!r} needs an embed plug-in")
    return embed


def evaluate(
    spark: SparkSession,
    aligned: DataFrame,
    key: str | Sequence[str],
    attrs: Mapping[str, str],
    embed: Callable[[pd.Series], pd.Series] | None = None,
    tasks: Mapping[str, str] | None = None,
    weights: Mapping[str, Mapping[str, float]] = M.AGE_WEIGHTS,
    token_embed: Callable[[pd.Series], pd.Series] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``aligned`` holds the key columns, one row per key (C8), and, per attribute ``a``,
    columns ``a_gold`` and ``a_pred`` (for ``type``: ``type_gold`` string and
    ``type_pred`` struct<is_human, character_type>).  Returns (report, scores);
    rows with a null key have no score row."""
    keys = [key] if isinstance(key, str) else list(key)
    tasks = dict(tasks or {})
    kinds = dict(aligned.dtypes)
    for attr, kind in attrs.items():
        if kind not in KINDS:
            raise ValueError(f"attribute {attr!r}: unsupported kind {kind!r}")
        io.require_columns(aligned, f"{attr}_gold", f"{attr}_pred")
        if kind == "type" and not kinds[f"{attr}_pred"].startswith("struct"):
            raise TypeError(f"attribute {attr!r}: predictions must be a struct, found {kinds[f'{attr}_pred']}")
    checkpoint_root(spark)
    rows = aligned.checkpoint()
    score_cols: list[str] = []

    def add(frame: DataFrame, name: str, value: Column) -> DataFrame:
        score_cols.append(name)
        return frame.withColumn(name, value)

    # per-row scores, all on one frame
    for attr, kind in attrs.items():
        g, p = f"{attr}_gold", f"{attr}_pred"
        if kind in ("closed", "ordinal"):
            rows = add(rows, f"score_{attr}", M.exact_match(g, p))
            if kind == "ordinal":
                rows = add(rows, f"soft_score_{attr}", M.soft_score(g, p, weights))
        elif kind == "set":
            rows = rows.withColumn(g, as_items(rows, g)).withColumn(p, as_items(rows, p))
            rows = add(rows, f"score_{attr}", M.set_f1(g, p))
        elif kind == "open":
            task = tasks.get(attr, f"Identify the character's {attr.replace('_', ' ')}.")
            rows = M.similarity(rows, task, _embedder(embed, attr), g, p, f"cos_sim_{attr}")
            score_cols.append(f"cos_sim_{attr}")
            if token_embed is not None:
                vectors = F.pandas_udf(token_embed, "array<array<double>>")
                texts = [list_to_text(c) if dict(rows.dtypes)[c] != "string" else F.col(c) for c in (g, p)]
                rows = add(rows, f"token_f1_{attr}", F.when(
                    M.both_present(g, p), M.alignment_f1(vectors(texts[0]), vectors(texts[1]))["f"]))
        else:
            rows = rows.withColumn("_gold_is_human", F.lower(F.col(g)).eqNullSafe("human"))
            rows = rows.withColumn("_is_human", F.col(p)["is_human"])
            rows = add(rows, "score_is_human", M.exact_match("_gold_is_human", "_is_human", "bool"))
            if embed is not None:
                # Neither side human; other rows have no similarity
                rows = rows.withColumn("_nonhuman", ~F.col("_gold_is_human") & F.col("_is_human").eqNullSafe(False))
                rows = rows.withColumn("_tg", F.when(F.col("_nonhuman"), F.col(g)))
                rows = rows.withColumn("_tp", F.when(F.col("_nonhuman"), F.col(p)["character_type"]))
                rows = M.similarity(rows, tasks.get(attr, "Identify the type of character."), embed, "_tg", "_tp", "_cos")
                rows = add(rows, f"cos_sim_{attr}", F.when(F.col("_nonhuman"), F.col("_cos")))
    rows = rows.checkpoint() if any(k in ("open", "type") for k in attrs.values()) else rows

    lines: list[DataFrame] = []
    for attr, kind in attrs.items():
        g, p = f"{attr}_gold", f"{attr}_pred"
        lines.append(_line(rows.agg(F.count(g).alias("n"), F.count("*").alias("r")), attr, "gold_count", "n", "r"))
        if kind in ("closed", "ordinal"):
            lines.append(_report_lines(M.classification_report(rows, g, p), attr))
            if kind == "ordinal":
                soft = M.soft_f1(rows.select(F.col(f"soft_score_{attr}").alias("soft_score")))
                lines.append(_line(soft, attr, "soft_f1", "soft_f1", "n_rows"))
        elif kind == "set":
            lines.append(_line(M.micro_set_f1(rows, g, p), attr, "micro_f1", "micro_f1", "n_rows"))
        elif kind == "open":
            lines.append(_line(M.mean_similarity(rows, F.col(g).isNotNull(), f"cos_sim_{attr}"), attr, "mean_cos",
                               "mean_cos", "n_gold"))
            if token_embed is not None:
                t = f"token_f1_{attr}"
                lines.append(_line(rows.agg(F.avg(t).alias("m"), F.count(t).alias("n")), attr, "token_f1", "m", "n"))
        else:
            share = rows.agg(M.share_true("_is_human").alias("v"), F.count("_is_human").alias("n"))
            lines.append(_line(share, attr, "pct_human", "v", "n"))
            lines.append(_report_lines(M.classification_report(rows, "_gold_is_human", "_is_human", "bool"),
                                       attr, "is_human_"))
            if embed is not None:
                lines.append(_line(M.mean_similarity(rows.where("_nonhuman"), F.col(g).isNotNull(), f"cos_sim_{attr}"),
                                   attr, "mean_cos", "mean_cos", "n_gold"))
    scored = rows
    for k in keys:
        scored = scored.where(F.col(k).isNotNull())
    return union_all(*lines), scored.select(*keys, *score_cols)


def _gold_value(attr: str, kind: str) -> Column:
    v = F.col(attr)
    text = F.try_variant_get(v, "$", "string")
    if kind in ("closed", "ordinal", "type"):
        return text
    items = F.try_variant_get(v, "$", "array<string>")
    # an absent value stays null (S7 would make it an empty list, which D6 counts)
    return F.coalesce(items, F.when(text.isNotNull(), split_comma_blank(text) if kind == "open" else split_list(text)))


PRED_TYPES = {"closed": "string", "ordinal": "string", "set": "array<string>", "open": "array<string>", "type": TYPE_STRUCT}


def align_files(spark: SparkSession, gold_path: str, pred_path: str, attrs: Mapping[str, str],
                datatype: str = "raw") -> DataFrame:
    """Gold JSON Lines (A1, B1) and predictions CSV (A2), cleaned by ``datatype`` (B14),
    aligned on name and book (C8): ``name``, ``url`` and ``a_gold``, ``a_pred`` each."""
    gold = io.flatten_gold(io.read_gold(spark, gold_path), {a: "variant" for a in attrs})
    gold = gold.select("name", F.col("gutenberg_url").alias("url"),
                       *[_gold_value(a, k).alias(f"{a}_gold") for a, k in attrs.items()])
    pred = load_and_clean(io.read_predictions(spark, pred_path), datatype, {a: PRED_TYPES[k] for a, k in attrs.items()})
    io.require_columns(pred, "book", "character", *attrs)
    pred = pred.select("character", "book", *[F.col(a).alias(f"{a}_pred") for a in attrs])
    return M.align(gold, pred, [("name", "character"), ("url", "book")])


def evaluate_files(spark: SparkSession, gold_path: str, pred_path: str, attrs: Mapping[str, str],
                   datatype: str = "raw", **plugins) -> tuple[DataFrame, DataFrame]:
    """K3 as one job: files in, (report, scores per name and url) out."""
    return evaluate(spark, align_files(spark, gold_path, pred_path, attrs, datatype), ["name", "url"], attrs, **plugins)


def load_and_clean(pred: DataFrame, datatype: str, attrs: Mapping[str, str],
                   output_col: str = "output") -> DataFrame:
    """Baseline predictions already hold attribute columns and are used
    as they are; raw and cleaned outputs go through the repair job (cleaned
    ones are repaired again, which is a no-op on valid JSON)."""
    if datatype == "baseline":
        return pred
    from charlens.operators.repair import repair_outputs

    return repair_outputs(pred, attrs, output_col=output_col)


def report_with_run(report: DataFrame, run_id: str, source_path: str) -> DataFrame:
    """Stamp a report with the run identity before appending it."""
    return report.select(
        F.lit(run_id).alias("run_id"), F.lit(source_path).alias("source"),
        F.current_timestamp().alias("evaluated_at"), "*",
    )
