"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z), framed by a byte that UTF-8 never uses (0xFF: five in front
as context, one at the end that is coded too) and coded byte by byte, each byte as eight
binary decisions.  A decision's context is the bits of its byte so far and the preceding
0 to ``DEPTH`` = 5 bytes.  Every node of a tree has counts of zeros and ones from all
training texts and the Krichevsky-Trofimov estimate; its block probability depends on the
counts alone, so the weighted probabilities follow bottom-up,
``Pw = (Pe + product of the children's Pw) / 2``, and ``w = Pe / 2 / Pw`` is the weight
with which a node stops.  Scoring runs down the path and mixes the estimates of all
depths by these weights.  Where a context was never seen, the deepest seen estimate takes
the weight that is left, so each decision has a proper distribution.

As Spark jobs: chunks of documents send their distinct 6-byte strings (five of context and
the next byte) with training counts to buckets by the last three bytes of context.  A
bucket holds whole subtrees below depth 3 and weighs them; depths 2 to 0 are aggregated
with SQL.  The weights of depth 0 and 1 (at most 65,535 nodes) are broadcast, those of
depth 2 joined to the buckets that need them.  Buckets answer each chunk with the code
lengths of its own strings, and chunks add them up per text.  Word counts for the base
score travel along.  Nothing that grows with the corpus is broadcast or collected.
A task holds a chunk (16 MB of text) with its distinct strings and their answers; strings
are made and looked up a piece of 256 KB at a time, however long the text.  Rows are
dealt to chunks by id and text, so rows without an id, or with one id, spread.

Defined cases: a null text is an empty text (one end, coded); rows without an id take
part like others; repeated rows count each; without training texts every decision costs
one bit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X
from charlens.llm import textops as T

DEPTH = 5
CHUNK_BYTES = 16 << 20
#: bytes of text whose words, and whose strings, are in memory at a time
BLOCK, PIECE = 512 << 10, 256 << 10
U = np.uint64
_FRAME = 0xFF
#: the end token among word hashes
_END = U(0xE17D0000E17D0001)
_HALF = float(np.log(0.5))


def framed(data: np.ndarray, off: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, text index) of every coded byte: five bytes of context, the latest in
    front, and the byte itself, in 48 bits; about ``piece`` bytes at a time."""
    size = np.diff(off)
    front = off[:-1] + 6 * np.arange(len(size))
    coded = np.ones(len(data) + 6 * len(size), bool)
    for j in range(5):
        coded[front + j] = False
    body = coded.copy()
    body[front + 5 + size] = False
    text = np.full(len(coded), _FRAME, np.uint8)
    text[body] = data
    del body
    for a in range(0, len(text), piece):
        low = max(a - 5, 0)
        near = text[low:a + piece].astype(np.uint64)
        at = np.flatnonzero(coded[a:a + piece]) + (a - low)
        key = near[at]
        for j in range(1, 6):
            key |= near[at - j] << U(8 * (6 - j))
        yield key, np.searchsorted(front, at + low, "right") - 1


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (T.mix((keys >> U(24)) + U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)


class Counts:
    """Sorted distinct keys with summed counts; what comes in is merged when it outgrows them."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, one: int) -> None:
        keys = np.sort(keys)
        first, n = T.run_lengths(keys)
        self.keys.append(keys[first])
        self.counts.append(n * one)
        self.waiting += len(first)
        if self.waiting > max(len(self.key), 1 << 18):
            self.merge()

    def merge(self) -> None:
        key, n = np.concatenate([self.key, *self.keys]), np.concatenate([self.n, *self.counts])
        self.keys, self.counts, self.waiting = [], [], 0
        order = np.argsort(key)
        key, n = key[order], n[order]
        first, _ = T.run_lengths(key)
        self.key, self.n = key[first], (np.add.reduceat(n, first) if len(first) else n)


def _count_pass(bits: int):
    """Chunk -> packed strings (buckets 0 ...) and word hashes (from ``2**bits``) with training counts."""

    def run(table: pa.Table) -> pa.Table:
        data, off = T.text_buffer(table.column("text"))
        train = table.column("train").to_numpy().astype(np.int64)
        kinds = (Counts(), Counts())
        for i, j in T.sub_blocks(off, BLOCK):
            w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.NON_SPACE)
            learn = train[i:j]
            word = np.concatenate([w.hash, np.full(j - i, _END)])
            use = np.concatenate([learn[w.doc], learn]) > 0
            kinds[1].add(word[use], 1)
            kinds[1].add(word[~use], 0)
            for key, doc in framed(w.data, w.off):
                use = learn[doc] > 0
                kinds[0].add(key[use], 1)
                kinds[0].add(key[~use], 0)
        out = []
        for kind, all_of in enumerate(kinds):
            all_of.merge()
            key, n = all_of.key, all_of.n
            bucket = _bucket_of(key, bits) if kind == 0 else (key >> U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, n, bucket = key[order], n[order], bucket[order]
            at, size = T.run_lengths(bucket)
            out.append(pa.table({
                "bucket": pa.array(bucket[at] + (kind << bits), pa.int32()), "chunk": pa.array(np.full(len(at), table.column("chunk")[0].as_py()), pa.int32()),
                "keys": pa.array([key[a:a + s].tobytes() for a, s in zip(at, size)], pa.binary()),
                "n": pa.array([n[a:a + s].astype(np.uint32).tobytes() for a, s in zip(at, size)], pa.binary())}))
        return pa.concat_tables(out)

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5 (Stirling's series after a shift)."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log block probability of counts under the Krichevsky-Trofimov estimator."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: id is context << 8 | bits so far (with a leading 1)."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        self.node, self.n0, self.n1 = node, n0, n1
        own = log_kt(n0, n1)
        self.log_w = own if children is None else np.logaddexp(_HALF + own, _HALF + children)
        self.stop = np.ones(len(node)) if children is None else np.exp(_HALF + own - self.log_w)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits so far with a leading 1, bit) of the eight decisions of each string, shape (8, n)."""
    byte = keys & U(0xFF)
    prefix = np.stack([(U(1) << U(j)) | (byte >> U(8 - j)) for j in range(8)])
    bit = np.stack([(byte >> U(7 - j)) & U(1) for j in range(8)]).astype(bool)
    return prefix, bit


def subtree(keys: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """Levels 5 to 3 of the trees over strings with training counts."""
    seen = n > 0
    keys, n = keys[seen], n[seen].astype(np.float64)
    prefix, bit = decisions(keys)
    levels: dict[int, Level] = {}
    for depth in (5, 4, 3):
        node = (((keys >> U(8 * (6 - depth))) << U(8))[None] | prefix).ravel()
        one, at = np.unique(node, return_inverse=True)
        weight = np.broadcast_to(n, bit.shape).ravel()
        b = bit.ravel()
        n1 = np.bincount(at, weights=weight * b, minlength=len(one))
        n0 = np.bincount(at, weights=weight * ~b, minlength=len(one))
        below = None
        if depth < 5:
            deeper = levels[depth + 1]
            up = ((deeper.node >> U(16)) << U(8)) | (deeper.node & U(0xFF))
            below = np.bincount(np.searchsorted(one, up), weights=deeper.log_w, minlength=len(one))
        levels[depth] = Level(one, n0, n1, below)
    return levels


def _bucket_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, total counts, all keys, row of each, place among the distinct)."""
    key, row = X.unpack(table, keys=np.uint64)
    n, _ = X.unpack(table, n=np.uint32)
    one, at = np.unique(key, return_inverse=True)
    return one, np.bincount(at, weights=n, minlength=len(one)), key, row, at


def _up_pass(bits: int):
    """Bucket -> its depth-3 nodes (kind 0), the depth-2 contexts it needs (kind 1), or word totals (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        one, n, *_ = _bucket_counts(table)
        if bucket >> bits:
            rows = (2, np.zeros(1, np.int64), np.array([n.sum()]), np.array([float((n > 0).sum())]), np.zeros(1))
            parts = [rows]
        else:
            top = subtree(one, n)[3]
            need = np.unique(one >> U(32)).view(np.int64)
            zero = np.zeros(len(need))
            parts = [(0, top.node.view(np.int64), top.n0, top.n1, top.log_w), (1, need, zero, zero, zero)]
        return pa.concat_tables([pa.table({
            "kind": pa.array(np.full(len(p[1]), p[0]), pa.int32()), "bucket": pa.array(np.full(len(p[1]), bucket), pa.int32()),
            "node": pa.array(p[1], pa.int64()), "n0": pa.array(p[2], pa.float64()), "n1": pa.array(p[3], pa.float64()),
            "log_w": pa.array(p[4], pa.float64())}) for p in parts])

    return run


def _log_gamma(x: Column) -> Column:
    """As ``log_gamma``, in SQL: shifted by eight."""
    y = x + 8
    product = x
    for j in range(1, 8):
        product = product * (x + j)
    return ((y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(product))


def _weighted(below: DataFrame) -> DataFrame:
    """(node, n0, n1, log_w, stop, one) of a level from the level below."""
    up = F.shiftleft(F.shiftright("node", 16), 8) + F.col("node").bitwiseAND(255)
    level = below.groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
    own = _log_gamma(F.col("n0") + 0.5) + _log_gamma(F.col("n1") + 0.5) - _log_gamma(F.col("n0") + F.col("n1") + 1.0) - F.lit(float(np.log(np.pi)))
    level = level.withColumn("own", own).withColumn("most", F.greatest("own", "below"))
    mixed = _HALF + F.col("most") + F.log(F.exp(F.col("own") - F.col("most")) + F.exp(F.col("below") - F.col("most")))
    return level.withColumn("log_w", mixed).select(
        "node", "n0", "n1", "log_w", F.exp(_HALF + F.col("own") - F.col("log_w")).alias("stop"),
        ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).alias("one"))


def _mixed(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """(node, mix, rest, last): the mixture down to the level, the weight left, its own estimate."""
    if above is None:
        return level.select("node", (F.col("stop") * F.col("one")).alias("mix"), (1 - F.col("stop")).alias("rest"), F.col("one").alias("last"))
    up = F.shiftleft(F.shiftright("node", 16), 8) + F.col("node").bitwiseAND(255)
    over = above.select(F.col("node").alias("up"), F.col("mix").alias("m"), F.col("rest").alias("r"))
    return level.withColumn("up", up).join(over, "up").select(
        "node", (F.col("m") + F.col("r") * F.col("stop") * F.col("one")).alias("mix"),
        (F.col("r") * (1 - F.col("stop"))).alias("rest"), F.col("one").alias("last"))


def _length_pass(shared, bits: int):
    """Bucket and its depth-2 mixtures -> for each chunk the log10 probability of its strings
    (4 bytes each), or the training counts of its words (8 bytes each)."""

    def run(key, table: pa.Table, tops: pa.Table) -> pa.Table:
        one, n, every, row, at = _bucket_counts(table)
        if key[0].as_py() >> bits:
            value = n.astype(np.float64)
        else:
            value = _log_probability(one, n, shared.value, tops).astype(np.float32)
        return X.answers(table, row, keys=every, value=value[at])

    return run


def _log_probability(keys: np.ndarray, n: np.ndarray, top: tuple, tops: pa.Table) -> np.ndarray:
    prefix, bit = decisions(keys)
    mix0, rest0, last0 = top  # [1 + latest byte, bits so far]; row 0: depth 0
    p = prefix.astype(np.int64)
    mix, rest, last = mix0[0][p], rest0[0][p], last0[0][p]
    late = (keys >> U(40)).astype(np.int64)[None] + 1
    known = ~np.isnan(mix0[late, p])
    mix, rest, last = (np.where(known, x[late, p], y) for x, y in ((mix0, mix), (rest0, rest), (last0, last)))
    node2 = tops.column("node").to_numpy().astype(np.int64)
    order = np.argsort(node2)
    found = T.find(node2[order].view(np.uint64), ((keys >> U(32)) << U(8))[None].repeat(8, 0).ravel() | prefix.ravel()).reshape(prefix.shape)
    ok = found >= 0
    for name in ("mix", "rest", "last"):
        v = tops.column(name).to_numpy()[order]
        v = np.where(ok, v[found], 0.0) if len(v) else np.zeros(prefix.shape)
        if name == "mix":
            mix = np.where(ok, v, mix)
        elif name == "rest":
            rest = np.where(ok, v, rest)
        else:
            last = np.where(ok, v, last)
    levels = subtree(keys, n)
    for depth in (3, 4, 5):
        level = levels[depth]
        node = ((keys >> U(8 * (6 - depth))) << U(8))[None] | prefix
        found = T.find(level.node, node.ravel()).reshape(node.shape)
        ok = found >= 0
        if not ok.any():
            break
        est, stop = level.one[found], level.stop[found]
        mix = np.where(ok, mix + rest * stop * est, mix)
        last = np.where(ok, est, last)
        rest = np.where(ok, rest * (1 - stop), rest)
    p1 = mix + rest * last
    return np.log10(np.where(bit, p1, 1.0 - p1)).sum(axis=0)


def _answered(found: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of packed answers and their values."""
    key = np.frombuffer(b"".join(found.column("keys").to_pylist()), np.uint64)
    value = np.frombuffer(b"".join(found.column("value").to_pylist()), kind)
    order = np.argsort(key)
    return key[order], value[order]


def _score_pass(bits: int):
    """Chunk and its answers -> per text the model's score and the parts of the base score."""

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        words = pc.greater_equal(found.column("bucket"), pa.scalar(1 << bits, pa.int32()))
        counts = _answered(found.filter(words), np.float64)
        lengths = _answered(found.filter(pc.invert(words)), np.float32)
        del found
        data, off = T.text_buffer(docs.column("text"))
        out: list[list] = [[], [], [], [], []]
        for i, j in T.sub_blocks(off, BLOCK):
            w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.NON_SPACE)
            score = np.zeros(j - i)
            for string, doc in framed(w.data, w.off):
                own = (string << U(16)) | doc.astype(np.uint64)
                own.sort()
                first, n = T.run_lengths(own)
                own = own[first]
                length = lengths[1][np.searchsorted(lengths[0], own >> U(16))]
                score += np.bincount((own & U(0xFFFF)).astype(np.int64), weights=length * n, minlength=j - i)
            out[0].append(score)
            word = np.concatenate([w.hash, np.full(j - i, _END)])
            of = np.concatenate([w.doc, np.arange(j - i)])
            c = counts[1][np.searchsorted(counts[0], word)]
            out[1].append(np.bincount(of, weights=np.log10(c + 1.0), minlength=j - i))
            out[2].append(np.bincount(of, minlength=j - i))
            out[3].append(np.bincount(of[c > 0], minlength=j - i))
            out[4].append(np.diff(w.off) + 1)
        cat = lambda k, kind: np.concatenate(out[k]).astype(kind) if out[k] else np.zeros(0, kind)
        return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "score": cat(0, np.float64), "logs": cat(1, np.float64),
                         "n_tokens": cat(2, np.int64), "n_known": cat(3, np.int64), "n_coded": cat(4, np.int64)})

    return run


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    ``train``: condition on the rows to learn from.  ``score``: log10 probability of the
    text under the trees; ``bits_per_byte``: its code length over its bytes and end.
    """
    spark = docs.sparkSession
    chunks = X.chunk_count(docs, text_col, chunk_bytes, per_partition=1)
    bits = X.bucket_bits(chunks)
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")
    texts = docs.select(chunk.alias("chunk"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(train, F.lit(False)).alias("train")).repartition(chunks, "chunk")
    path = X.scratch(spark, "ctw")
    texts.groupBy("chunk").applyInArrow(_count_pass(bits), "bucket int, chunk int, keys binary, n binary").write.parquet(path)
    packed = spark.read.schema("bucket int, chunk int, keys binary, n binary").parquet(path)
    low = X.cut(packed.groupBy("bucket").applyInArrow(_up_pass(bits), "kind int, bucket int, node bigint, n0 double, n1 double, log_w double"))
    deep = low.where("kind = 0").select("node", "n0", "n1", "log_w")
    two = _weighted(deep)
    one = _weighted(two)
    zero = _weighted(one)
    zero_mix = _mixed(zero, None)
    one_mix = _mixed(one, zero_mix)
    top = np.full((3, 257, 256), np.nan)
    top[0, 0], top[1, 0], top[2, 0] = 0.0, 1.0, 0.5
    for r in zero_mix.collect():
        top[:, 0, r["node"] & 255] = r["mix"], r["rest"], r["last"]
    for r in one_mix.collect():
        top[:, 1 + (r["node"] >> 8), r["node"] & 255] = r["mix"], r["rest"], r["last"]
    need = low.where("kind = 1").select("bucket", F.col("node").alias("context")).distinct()
    tops = (_mixed(two, one_mix).withColumn("context", F.shiftright("node", 8)).join(need, "context")
            .select("bucket", "node", "mix", "rest", "last"))
    shared = spark.sparkContext.broadcast(tuple(top))
    found = packed.groupBy("bucket").cogroup(tops.groupBy("bucket")).applyInArrow(
        _length_pass(shared, bits), "chunk int, bucket int, keys binary, value binary")
    rows = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _score_pass(bits), "doc_id bigint, train boolean, score double, logs double, n_tokens bigint, n_known bigint, n_coded bigint")
    total = low.where("kind = 2").agg(F.coalesce(F.sum("n0"), F.lit(0.0)), F.coalesce(F.sum("n1"), F.lit(0.0))).first()
    tokens, distinct = int(total[0]), int(total[1])
    each = float(np.log10(tokens + distinct + 1.0))
    return rows.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
        (F.col("score") * F.lit(-float(np.log2(10.0))) / F.col("n_coded")).alias("bits_per_byte"))
