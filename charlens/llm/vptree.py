"""Approximate nearest neighbours: vantage-point trees per shard.

Largest inner product becomes Euclidean nearness by one more coordinate,
``sqrt(M*M - |x|*|x|)`` with M the largest norm (0 for queries).  Vectors are dealt to
shards by a hash; each shard builds a vantage-point tree and searches it for all queries
of a block together.  A subtree goes unvisited when the triangle inequality keeps it
beyond ``factor`` times the query's k-th best distance: factor 1 is exact search, smaller
factors prune more and may miss neighbours.  The k-th best distance within a bounded
sample of the vectors (``SAMPLE``) serves as first bound for every shard.

Equal vectors are one point: at most ``k + 1`` smallest ids of a vector can be among the
k nearest of a query that leaves itself out, so only these are kept, exactly.

Distances select candidates with some slack; ranking uses the inner product of the
original vectors, summed in order of the components in double precision, ties to the
smaller id.  Shards return at most k rows a query (and ties at the end).

Defined cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part; an id that repeats gives a row for each
distinct vector it has; fewer than k candidates give all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from charlens.llm import exchange as X

LEAF, SHARD_ROWS, QUERY_BLOCK, SAMPLE = 256, 16384, 2048, 2048
FACTOR = 1.0


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    width = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (width["d"] if width else 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class Tree:
    """Vantage-point tree over rows of a matrix: nodes with a vantage row, children split at the median."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf = points, leaf
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if len(rows) <= leaf:
                self.nodes.append([rows, None, None, None, None, None])
                continue
            vantage = points[rows[rng.integers(len(rows))]]
            d = distances(vantage[None], points[rows])[0]
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            inner, outer = order[:half], order[half:]
            self.nodes.append([None, vantage, None, None, d[inner[-1]], (d[outer[0]], d[outer[-1]])])
            todo += [(rows[inner], me, 2), (rows[outer], me, 3)]

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray, factor: float):
        """For each query the rows found within its k-th best distance (with slack)."""
        n = len(queries)
        tau = bound.copy()
        near = np.full((n, k), np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slack = 1e-6 * (1.0 + np.abs(tau[np.isfinite(tau)]).max(initial=0.0))
        todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(n), None)]
        while todo:
            me, q, least = todo.pop()
            if least is not None:
                keep = least <= factor * tau[q] + slack
                q = q[keep]
            if not len(q):
                continue
            rows, vantage, inner, outer, inside, shell = self.nodes[me]
            if rows is not None:
                d = distances(queries[q], self.points[rows])
                best = np.sort(np.concatenate([near[q], d], axis=1), axis=1)[:, :k]
                near[q] = best
                tau[q] = np.minimum(tau[q], best[:, -1])
                i, j = np.nonzero(d <= (tau[q] + slack)[:, None])
                hits.append((q[i], rows[j], d[i, j]))
                continue
            d = distances(vantage[None], queries[q])[0]
            to_inner, to_outer = np.maximum(d - inside, 0), np.maximum(np.maximum(shell[0] - d, d - shell[1]), 0)
            first = to_inner <= to_outer
            # nearer side first: last in, first out
            todo += [(inner, q[~first], to_inner[~first]), (outer, q[first], to_outer[first]),
                     (outer, q[~first], to_outer[~first]), (inner, q[first], to_inner[first])]
        if not hits:
            none = np.zeros(0, np.int64)
            return none, none
        qi, row, d = (np.concatenate([h[x] for h in hits]) for x in range(3))
        ok = d <= tau[qi] + slack
        return qi[ok], row[ok]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Points with the coordinate that turns inner products into distances."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _search(shared, k: int, factor: float, leaf: int):
    """Shard -> candidates (query_id, vec_id, score) for one block of queries."""

    def run(table: pa.Table) -> pa.Table:
        queries, ids, bound, top = shared.value
        x, others = _matrix(table.column("v")), table.column("ids").to_pylist()
        tree = Tree(lifted(x, top), leaf)
        found = []
        lift = np.column_stack([queries, np.zeros(len(queries))])
        # one neighbour more: the query itself may be among them
        qi, row = tree.search(lift, k + 1, bound, factor)
        score = products(queries[qi], x[row])
        order = np.lexsort((-score, qi))
        qi, row, score = qi[order], row[order], score[order]
        for q, r, s in zip(qi.tolist(), row.tolist(), score.tolist()):
            found += [(ids[q], o, s) for o in others[r] if o != ids[q]]
        q, o, s = (np.array([f[c] for f in found], t) for c, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((o, -s, q))
        q, o, s = q[order], o[order], s[order]
        first, n = np.unique(q, return_index=True, return_counts=True)[1:] if len(q) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keep = (np.arange(len(q)) - np.repeat(first, n)) < k
        return pa.table({"query_id": q[keep], "vec_id": o[keep], "score": s[keep]})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, leaf: int = LEAF, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query by largest inner product.

    ``queries`` has the columns of ``rows``; a candidate with the query's id is left out.
    """
    spark = rows.sparkSession
    points = usable(rows, id_col, vec_col)
    asked = X.cut(usable(queries, id_col, vec_col))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = X.cut(points.withColumn("rank", rank).where(F.col("rank") <= k + 1)
                    .groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = classes.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    shards = max(1, -(-size["n"] // shard_rows))
    top = float(size["top"] or 0.0)
    spot = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"].tolist() if size["n"] else []
    sample = lifted(np.array(spot), top) if spot else None
    total = asked.count()
    blocks = max(1, -(-total // query_block))
    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")
    dealt = X.cut(classes.select(shard, "v", "ids").repartition(shards, "shard")) if blocks > 1 else classes.select(shard, "v", "ids")
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        if not len(part) or sample is None:
            continue
        q, ids = np.array(part["v"].tolist()), part["vec_id"].to_numpy()
        lift = np.column_stack([q, np.zeros(len(q))])
        seen = np.sort(distances(lift, sample), axis=1)
        bound = seen[:, k] + 1e-6 * (1 + top) if seen.shape[1] > k else np.full(len(q), np.inf)
        shared = spark.sparkContext.broadcast((q, ids.tolist(), bound, top))
        got = dealt.groupBy("shard").applyInArrow(_search(shared, k, factor, leaf), "query_id bigint, vec_id bigint, score double")
        got = got if blocks == 1 else X.cut(_best(got, k))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    return _best(out, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
