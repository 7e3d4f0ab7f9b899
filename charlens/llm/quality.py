"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of the text alone (byte classes, word lengths, repetition) are standardised
and mapped to random cosines that approximate a Gaussian kernel.  Each partition adds
up its part of the normal equations for every fold, Spark sums the parts, the driver
solves systems of ``features + 1`` unknowns.  Scores of each fold by the model without
it are binned (at most ``BINS``) and made monotone by pooling adjacent violators; that
step function, interpolated, calibrates the model of all folds.

Defined cases: a null text is an empty text and is scored; labels that are null or
other than 0 and 1, and labels without a document, are ignored; several labels of a
document count each; without any label the score is 0.5, with labels of one class only
their rate.  Rows without an id are scored and take no part in training.  Rows that
repeat an id are scored each.  Extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X
from charlens.llm import textops as T

#: random features, kernel width (in units of the root of the statistics' number), ridge
FEATURES, WIDTH, RIDGE = 256, 1.0, 1e-2
FOLDS, BINS, SEED = 4, 2000, 7
ACCEPT = 0.3

#: byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence end,
#: 7 comma-like, 8 bracket or bar, 9 other symbol, 10 beyond ASCII, 11 exclamation or question mark
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 9
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _chars, _k in ((b" \t", 4), (b"\n\r\x0b\x0c", 5), (b".", 6), (b",;:'\"-", 7), (b"|[]{}<>()/\\_=", 8), (b"!?", 11)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
_N = 12


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text of a sub-block."""
    docs = len(off) - 1
    size = np.diff(off).astype(np.float64)
    of = np.repeat(np.arange(docs), np.diff(off))
    share = np.bincount(of * _N + _CLASS[data], minlength=docs * _N).reshape(docs, _N).astype(np.float64)
    safe = np.maximum(size, 1)[:, None]
    w = T.Words(data, off, T.NON_SPACE)
    n = w.counts.astype(np.float64)
    some = np.maximum(n, 1)
    doc = w.doc
    length = (w.end - w.start).astype(np.float64)
    per = lambda v: np.bincount(doc, weights=v, minlength=docs) / some
    mean = per(length)
    wh = w.hash
    again = np.zeros(len(w))
    if len(w) > 1:
        again[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((wh, doc))
    fresh = np.ones(len(w))
    if len(w) > 1:
        a, b = order[1:], order[:-1]
        fresh[a] = (wh[a] != wh[b]) | (doc[a] != doc[b])
    at, h = w.windows(4)
    runs = np.bincount(w.doc[at], minlength=docs)
    order = np.lexsort((h, w.doc[at]))
    repeated = np.zeros(len(at))
    if len(at) > 1:
        a, b = order[1:], order[:-1]
        repeated[a] = (h[a] == h[b]) & (w.doc[at[a]] == w.doc[at[b]])
    repeats = np.bincount(w.doc[at], weights=repeated, minlength=docs)
    last = _CLASS[data[w.end - 1]] if len(w) else np.zeros(0, np.int64)
    shout = np.bincount(of, weights=(data == 33), minlength=docs)
    odd = ((last == 9) | (last == 8) | (last == 11)).astype(float)
    letters = share[:, 1] + share[:, 2] + share[:, 10]
    return np.column_stack([
        share / safe, np.log1p(share),
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(per(length ** 2) - mean ** 2, 0)),
        share[:, 2] / np.maximum(letters, 1), shout / some,
        per(again), np.log1p(per(again) * n), per(fresh), repeats / np.maximum(runs, 1), np.log1p(repeats),
        per(odd), np.log1p(per(odd) * n), per((length == 1).astype(float)), per((length <= 3).astype(float)), per((length >= 12).astype(float)),
    ])


def _describe(names: list[str]):
    def run(batches):
        for batch in batches:
            data, off = T.text_buffer(batch.column("text"))
            rows = [statistics(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in T.sub_blocks(off, docs=4096)]
            x = np.vstack(rows) if rows else np.zeros((0, 1))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            out = {c: batch.column(c) for c in names}
            out["x"] = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def described(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, x): the statistics of each text, in one pass."""
    kinds = dict(docs.dtypes)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = f"doc_id {kinds[id_col]}" + "".join(f", `{c}` {kinds[c]}" for c in keep) + ", x array<double>"
    return source.mapInArrow(_describe(["doc_id", *keep]), schema)


class Cosines:
    """Standardisation and the random cosines."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.turn = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.scale = np.sqrt(2.0 / features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8) @ self.turn + self.shift
        return np.column_stack([self.scale * np.cos(z), np.ones(len(x))])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _parts(cosines: Cosines):
    """Rows (fold, values): one partition's part of each fold's normal equations."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = cosines(_matrix(batch.column("x")))
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                a = np.column_stack([z[fold == f], y[fold == f]])
                sums[int(f)] = sums.get(int(f), 0) + a.T @ a
        upper = None
        for f, m in sums.items():
            upper = np.triu_indices(len(m)) if upper is None else upper
            v = m[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(v)], np.int32), pa.array(v))], ["fold", "v"])

    return run


def solve(m: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the summed products of features (last: label)."""
    a, b = m[:-1, :-1], m[:-1, -1]
    n = max(m[-2, -2], 1.0)
    penalty = np.full(len(a), ridge * n / len(a))
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(penalty), b)


def pool_adjacent(score: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rates over ascending scores: (mean score, rate) of each pool."""
    pools: list[list[float]] = []
    for s, c, p in zip(score, n, positive):
        pools.append([s * c, c, p])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


class Model:
    """Scores matrices of statistics."""

    def __init__(self, cosines=None, weights=None, knots=None, rates=None, constant=None):
        self.cosines, self.weights, self.knots, self.rates, self.constant = cosines, weights, knots, rates, constant

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.cosines(x) @ self.weights, self.knots, self.rates), 0.0, 1.0)


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS) -> Model:
    """Fit on rows (fold int, y double, x array<double>); all rows take part."""
    spark = rows.sparkSession
    y_rate = rows.agg(F.count("y"), F.avg("y")).first()
    if not y_rate[0]:
        return Model(constant=0.5)
    if y_rate[1] in (0.0, 1.0):
        return Model(constant=float(y_rate[1]))
    stats = (rows.select(F.posexplode("x").alias("k", "v")).groupBy("k")
             .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect())
    cosines = Cosines(np.array([r["m"] for r in stats]), np.array([r["s"] for r in stats]), features, width)
    shared = spark.sparkContext.broadcast(cosines)
    size = features + 2
    summed = (rows.select("fold", "y", "x").mapInArrow(_parts(cosines), "fold int, v array<double>")
              .select("fold", F.posexplode("v").alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v")).toPandas())
    upper = np.triu_indices(size)
    by_fold = np.zeros((folds, size, size))
    for f, part in summed.groupby("fold"):
        m = np.zeros((size, size))
        v = np.zeros(len(upper[0]))
        v[part["k"].to_numpy()] = part["v"].to_numpy()
        m[upper] = v
        by_fold[f] = m + np.triu(m, 1).T
    total = by_fold.sum(axis=0)
    apart = np.array([solve(total - m if (total - m)[-2, -2] > 0 else total, ridge) for m in by_fold])

    def outside(batches):
        for batch in batches:
            if batch.num_rows:
                z = shared.value(_matrix(batch.column("x")))
                raw = (z * apart[batch.column("fold").to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(raw, -0.5, 1.5)), batch.column("y")], ["raw", "y"])

    step = 2.0 / BINS
    bins = (rows.select("fold", "y", "x").mapInArrow(outside, "raw double, y double")
            .groupBy(F.floor(F.col("raw") / step).alias("b")).agg(F.avg("raw").alias("s"), F.count("*").alias("n"), F.sum("y").alias("p"))
            .orderBy("b").collect())
    knots, rates = pool_adjacent(*(np.array([float(r[c]) for r in bins]) for c in ("s", "n", "p")))
    return Model(cosines, solve(total, ridge), knots, rates)


def score(docs: DataFrame, labels: DataFrame, train=None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", **params) -> DataFrame:
    """(doc_id, *keep, score): the calibrated chance of label 1 of each text.

    ``train``: a condition on ``doc_id`` (column expression) that names the rows to
    learn from; all labelled rows by default.
    """
    keep = [c for c in keep if c not in ("doc_id", "score", "x", "text")]
    table = X.cut(described(docs, keep, id_col, text_col))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    known = known if train is None else known.where(train)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = X.cut(table.select("doc_id", "x").join(known, "doc_id").select(fold, "y", "x"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, **params))

    def run(batches):
        for batch in batches:
            out = {c: batch.column(c) for c in ("doc_id", *keep)}
            out["score"] = pa.array(model.value(_matrix(batch.column("x"))) if batch.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, f"doc_id {kinds['doc_id']}" + "".join(f", `{c}` {kinds[c]}" for c in keep) + ", score double")
