"""Sharding by Hilbert-curve order.

Metadata dimensions (numbers, or strings by their first bytes) are quantised at
approximate quantiles into ``2**bits`` cells each; rows are sorted by the index of their
cell on the Hilbert curve, then by id, and the order is cut into runs of equal row
counts.  Shards then cover compact boxes, so readers that filter on any of the
dimensions skip most files by their minima and maxima.

Law ``rows``: shard sizes in rows differ by one at most.  Row numbers come from one
range-partitioned sort, whose partitions are numbered on their own and then shifted by
the counts before them; a cell of any size is spread by the id.

Defined cases: nulls in a dimension form its lowest cell; a null text has size 1 (its
no bytes plus 1) and checksum 0; rows without an id sort first in their cell; equal rows
are kept, each in its own slot; input columns named as the result's own are replaced; fewer rows than shards leave shards empty; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql import Window

from charlens.llm import exchange as X

BITS = 5
#: columns of the result; input columns of these names are replaced
OWN = ("curve", "part", "shift", "place", "shard", "slot")


def curve_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits`` bits per dimension (Gray-code walk)."""
    x = [np.array(c, np.int64) for c in cells]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ flip) >> b) & 1)
    return out


def sort_key(column: Column, kind: ty.DataType) -> Column:
    """A number in the order of the column: itself, or a string's first seven bytes."""
    if isinstance(kind, ty.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return column.cast("double")


def quantised(rows: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """A cell number per dimension: how many of the quantile edges lie at or below the value."""
    keys = {c: sort_key(F.col(c), rows.schema[c].dataType) for c in dims}
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    edges = rows.agg(*[F.percentile_approx(k, shares, 10_000).alias(c) for c, k in keys.items()]).first()
    cells = []
    for c, k in keys.items():
        above = F.lit(0)
        for e, n in sorted(Counter(edges[c] or ()).items()):
            above = above + F.when(k >= F.lit(e), n).otherwise(0)
        cells.append(F.coalesce(above, F.lit(0)))
    return cells


def ordered(rows: DataFrame, dims: list[str], id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve`` (Hilbert index) and ``place`` (gapless row number from 0 along it)."""
    spark = rows.sparkSession

    @F.pandas_udf("bigint")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(curve_index([c.to_numpy() for c in cells], bits))

    rows = rows.drop(*OWN)
    keyed = rows.withColumn("curve", index(*quantised(rows, dims, bits)))
    by = ["curve", id_col, *[c for c in rows.columns if c != id_col]]
    ranged = X.cut(keyed.repartitionByRange(X.shuffle_partitions(spark), *by).withColumn("part", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("part").count().collect())
    before = itertools.accumulate([0] + [n for _, n in counts])
    # one row per partition
    shift = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)] or [(0, 0)], "part int, shift bigint")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return (ranged.withColumn("place", local.cast("bigint")).join(F.broadcast(shift), "part")
            .withColumn("place", F.col("place") + F.col("shift")).drop("shift", "part"))


def sharded(rows: DataFrame, dims: list[str], shards: int, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``rows`` with curve, shard (0 to ``shards - 1``) and slot (gapless from 0), law ``rows``."""
    total = rows.count()
    placed = ordered(rows, dims, id_col, bits)
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    first = F.expr(f"((place * {shards}) div {max(total, 1)} * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("slot", F.col("place") - first).withColumn("shard", shard.cast("int")).drop("place"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order inside: files carry tight minima and maxima."""
    (rows.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path))
