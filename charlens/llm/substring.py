"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``(window + 1) // 2`` words;
these are the index.  Every rolling window of a block's length probes it.  A repeat
of ``window`` words holds one whole block of the document it repeats, so a probe
that hits a block of another document marks every place where a repeat can be.
Around the hits whole windows are compared (64-bit hashes of 13 word hashes) and
runs of equal windows make up the maximal exact repeats.

Three passes over the chunks of documents, joined by two exchanges of packed keys:
blocks and probes, then the windows around hits with the smallest id that has each.

Defined cases: a null or empty text, or one of fewer words than the window, loses
nothing.  Rows without an id are left out.  Rows that repeat an id are scored each
on its own and never remove anything from each other.  An empty table gives an
empty result.  Extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X
from charlens.llm import textops as T

#: words of a repeat
WINDOW = 13
U = np.uint64


def _anchor_keys(bits: int):
    return 32 + bits


def _mark_pass(block: int, bits: int):
    """Chunk -> packed probe keys; flag 1: some document's block, flag 2: in two texts."""
    key_bits = _anchor_keys(bits)
    drop = U(64 - key_bits)

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        data, off = T.text_buffer(table.column("text"))
        found = []
        for i, j in T.sub_blocks(off):
            w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.NON_SPACE, lower=False)
            at, h = w.windows(block)
            doc = w.doc[at]
            aligned = (at - w.bounds[doc]) % block == 0
            key = h >> drop
            order = np.argsort(key)
            key, doc, aligned = key[order], doc[order], aligned[order]
            found.append((key, doc + i, aligned))
        key = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
        doc = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        aligned = np.concatenate([x[2] for x in found]) if found else np.zeros(0, bool)
        order = np.argsort(key, kind="stable")
        key, doc, aligned = key[order], doc[order], aligned[order]
        first, _ = T.run_lengths(key)
        if len(first):
            flags = np.maximum.reduceat(aligned.view(np.uint8), first)
            flags = flags | ((np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint8) << 1)
        else:
            flags = np.zeros(0, np.uint8)
        return X.pack(chunk, bits, key_bits, key[first], flags=flags)

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Bucket -> for each chunk its keys that are a block and occur in two texts."""
    key, row = X.unpack(table, keys=np.uint32)
    flags, _ = X.unpack(table, flags=np.uint8)
    order = np.argsort(key, kind="stable")
    key, row, flags = key[order], row[order], flags[order]
    first, n = T.run_lengths(key)
    if not len(first):
        return X.answers(table, row, keys=key)
    any_flag = np.bitwise_or.reduceat(flags, first)
    shared = ((n > 1) | (any_flag >= 2)) & (any_flag & 1 > 0)
    keep = np.repeat(shared, n)
    return X.answers(table, row[keep], keys=key[keep])


def _windows_around(w: T.Words, anchors: np.ndarray, block: int, window: int, drop) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold a hit of the anchors: (first word, hash)."""
    at, h = w.windows(block)
    hit = at[T.find(anchors, h >> drop) >= 0]
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marks = np.zeros(len(w) + 1, np.int32)
    marks[hit + 1] = 1
    marks = np.cumsum(marks)
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(n)
    span = window - block + 1
    first = first[(marks[first + span] > marks[first]) & (w.doc[:n] == w.doc[window - 1:])]
    return first, T.run_hash(w, first, window)


def _window_pass(block: int, window: int, bits: int):
    """Chunk and its shared anchors -> windows around hits, with the smallest id here."""
    key_bits = _anchor_keys(bits)
    drop = U(64 - key_bits)

    def run(key, docs: pa.Table, shared: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        anchors = X.unpack_keys(shared, bits, key_bits)
        found = []
        if docs.num_rows and len(anchors):
            data, off = T.text_buffer(docs.column("text"))
            ids = docs.column("doc_id").to_numpy()
            for i, j in T.sub_blocks(off):
                w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.NON_SPACE, lower=False)
                first, h = _windows_around(w, anchors, block, window, drop)
                found.append((h, ids[i + w.doc[first]]))
        h = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
        doc = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first, _ = T.run_lengths(h)
        low = np.minimum.reduceat(doc, first) if len(first) else doc[:0]
        high = np.maximum.reduceat(doc, first) if len(first) else doc[:0]
        return X.pack(chunk, bits, 64, h[first], low=low, many=(high > low).astype(np.uint8))

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Bucket -> for each chunk its windows that some smaller id has too, with that id."""
    h, row = X.unpack(table, keys=np.uint64)
    low, _ = X.unpack(table, low=np.int64)
    many, _ = X.unpack(table, many=np.uint8)
    order = np.argsort(h, kind="stable")
    h, low, many, row = h[order], low[order], many[order], row[order]
    first, n = T.run_lengths(h)
    least = np.repeat(np.minimum.reduceat(low, first), n) if len(first) else low
    ask = (least < low) | (many > 0)
    return X.answers(table, row[ask], keys=h[ask], low=least[ask])


def _remove_pass(window: int, bits: int, emit: str, keep: list[str]):
    def run(key, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        rows = sorted(zip(repeats.column("bucket").to_pylist(), repeats.column("keys").to_pylist(), repeats.column("low").to_pylist()))
        rest = 64 - bits
        known = np.concatenate([np.frombuffer(k, np.uint64) | U(b << rest) for b, k, _ in rows]) if rows else np.zeros(0, np.uint64)
        least = np.concatenate([np.frombuffer(m, np.int64) for _, _, m in rows]) if rows else np.zeros(0, np.int64)
        data, off = T.text_buffer(docs.column("text"))
        ids = docs.column("doc_id").to_numpy()
        n_words, n_removed, kept = [], [], []
        for i, j in T.sub_blocks(off):
            part = data[off[i]:off[j]]
            w = T.Words(part, off[i:j + 1] - off[i], T.NON_SPACE, lower=False)
            gone = np.zeros(len(w), bool)
            if len(known):
                at, h = w.windows(window)
                where = T.find(known, h)
                hit = where >= 0
                hit[hit] = least[where[hit]] < ids[i + w.doc[at[hit]]]
                gone = T.cover(len(w), at[hit], window)
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), w.bounds[:-1]) if len(w.bounds) > 1 else np.zeros(0, np.int64)
            lost[w.counts == 0] = 0
            n_words.append(w.counts)
            n_removed.append(lost)
            raw = part.tobytes()
            for d in range(j - i):
                text = raw[w.off[d]:w.off[d + 1]]
                if emit == "digest":
                    words = text.split()
                    if lost[d]:
                        stay = ~gone[w.bounds[d]:w.bounds[d + 1]]
                        words = [words[x] for x in np.flatnonzero(stay)]
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                elif lost[d]:
                    kept.append(_without(text, w, d, gone))
                else:
                    kept.append(text.decode("utf-8"))
        out = {"doc_id": docs.column("doc_id"),
               "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
               "n_removed": pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64()),
               "kept": pa.array(kept, pa.string())}
        for c in keep:
            out[c] = docs.column(c)
        return pa.table(out)

    return run


def _without(text: bytes, w: T.Words, d: int, gone: np.ndarray) -> str:
    """The text without its removed words and the white space after each."""
    a, b = w.bounds[d], w.bounds[d + 1]
    ends = np.append(w.start[a + 1:b], w.off[d + 1]) - w.off[d]
    starts = w.start[a:b] - w.off[d]
    out = np.frombuffer(text, np.uint8)
    drop = np.zeros(len(out) + 1, np.int32)
    g = gone[a:b]
    np.add.at(drop, starts[g], 1)
    np.add.at(drop, ends[g], -1)
    return out[np.cumsum(drop[:-1]) == 0].tobytes().decode("utf-8")


def remove_repeats(docs: DataFrame, window: int = WINDOW, emit: str = "text", keep: tuple[str, ...] = (),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *keep) of each row with an id.

    ``kept`` is the text without the repeats (``emit="text"``; untouched where
    nothing repeats) or the SHA-256 of the kept words joined by one space
    (``emit="digest"``).  A word goes if a window over it also starts in a
    document with a smaller id.
    """
    block = (window + 1) // 2
    docs = docs.where(F.col(id_col).isNotNull())
    chunks = X.chunk_count(docs, text_col)
    bits = X.bucket_bits(chunks)
    extra = [c for c in keep if c not in ("chunk", "n_words", "n_removed", "kept", "doc_id")]
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(chunks)).cast("int")
    base = [chunk.alias("chunk"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")]
    texts = docs.select(*base).repartition(chunks, "chunk")
    probes = texts.groupBy("chunk").applyInArrow(
        _mark_pass(block, bits), "bucket int, chunk int, keys binary, flags binary")
    shared = probes.groupBy("bucket").applyInArrow(_shared_anchors, "chunk int, bucket int, keys binary")
    near = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _window_pass(block, window, bits), "bucket int, chunk int, keys binary, low binary, many binary")
    repeats = near.groupBy("bucket").applyInArrow(_smallest, "chunk int, bucket int, keys binary, low binary")
    whole = docs.select(*base, *extra).repartition(chunks, "chunk") if extra else texts
    kinds = dict(docs.dtypes)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string" + "".join(f", `{c}` {kinds[c]}" for c in extra)
    return whole.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        _remove_pass(window, bits, emit, extra), schema)
