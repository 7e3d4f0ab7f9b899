"""S13 vector functions: dot product, L2 norm, cosine; all JVM-side.

Spark 4.1 has no vector_cosine_similarity; ``zip_with`` + ``aggregate`` keeps
the work inside the executor JVM.  Large token-by-token matrices (D18) use the
Arrow UDF in ``operators.metrics`` instead of per-pair rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)
