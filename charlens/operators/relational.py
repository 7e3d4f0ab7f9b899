"""Generic relational operators: keep-first dedup (E1), ordered heads (L1-L3),
unions (G0a/G0b), per-row set algebra (G0d)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order`` (ties, and rows without an
    order, by the row itself, nulls last).  Columns without an ordering (VARIANT,
    MAP) are kept but never compared.

    Implemented as ``min_by`` aggregation so the reduction is partial (map-side
    combine) and a hot key is collapsed before the shuffle; no window sort.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(c) for c in rest])
    kinds = dict(df.dtypes)
    sortable = [c for c in rest if not any(k in kinds[c] for k in ("variant", "map<"))]
    ties = [k.alias(f"_{i}") for i, k in enumerate(k for c in sortable for k in (F.col(c).isNull(), F.col(c)))]
    ordk = F.struct(*[F.col(c) for c in order or ()], *ties, F.lit(0).alias("_last"))
    agg = F.min_by(row, ordk).alias("_r")
    return df.groupBy(*keys).agg(agg).select(*keys, "_r.*")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """L1/L3: ordered head; Spark plans ``orderBy().limit()`` as TakeOrdered."""
    return df.orderBy(*order).limit(n)


def union_all(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Union by name; missing columns become null when allowed."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def set_algebra(g: Column, p: Column) -> dict[str, Column]:
    """G0d: per-row label-set union / intersection / difference (distinct, sorted)."""
    g = F.array_distinct(g)
    p = F.array_distinct(p)
    return {
        "union": F.array_sort(F.array_union(g, p)),
        "intersection": F.array_sort(F.array_intersect(g, p)),
        "gold_only": F.array_sort(F.array_except(g, p)),
        "pred_only": F.array_sort(F.array_except(p, g)),
    }
