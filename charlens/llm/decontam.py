"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Items and documents are lower-cased (A-Z) and cut into words of letters and digits;
an item's windows are its runs of ``window`` words, or all its words if it has fewer.
Document windows are looked up by hash, hits are verified on the words themselves.

The set goes to the executors in slices of at most ``slice_windows`` windows, so its
size is bounded whatever the benchmark's size: more windows mean more map-only
passes over the documents, each adding its hits to the spans found so far.

Defined cases: null or empty texts have no words and are clean; items without words
are ignored; an item without an id counts as the item ''; repeated items count once
per id; rows that repeat an id each get their own result; an empty table on either
side gives no hits.  Only columns named in ``keep`` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X
from charlens.llm import textops as T

#: words of a window
WINDOW = 10
#: windows broadcast at once (about 100 bytes each)
SLICE_WINDOWS = 200_000

_SEPARATORS = bytes(c if T.ALNUM[c] else 32 for c in range(256))


def normalised(w: T.Words, first: int, length: int) -> bytes:
    """Words ``first`` to ``first + length - 1`` joined by one space."""
    return b" ".join(w.data[w.start[first]:w.end[first + length - 1]].tobytes().translate(_SEPARATORS).split())


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, hash, words): the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = T.text_buffer(batch.column(1))
            for i, j in T.sub_blocks(off):
                w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.ALNUM)
                rows = []
                for d, n in enumerate(w.counts):
                    size = min(window, int(n))
                    if size:
                        first = w.bounds[d] + np.arange(n - size + 1)
                        for at, h in zip(first, T.run_hash(w, first, size).view(np.int64)):
                            rows.append((ids[i + d], size, int(h), normalised(w, at, size)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["item", "length", "hash", "words"])

    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "item string, length int, hash bigint, words binary").distinct()


def _scan(shared, keep: list[str], texts: bool):
    """Add the hits of one broadcast slice to (spans, items) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {}
        for length, rows in shared.value.items():
            known = np.array(sorted({r[0] for r in rows}), np.int64).view(np.uint64)
            known.sort()
            words: dict[tuple[int, bytes], list[str]] = {}
            for h, text, item in rows:
                words.setdefault((h, text), []).append(item)
            index[length] = (known, words)
        for batch in batches:
            data, off = T.text_buffer(batch.column("text"))
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for i, j in T.sub_blocks(off):
                w = T.Words(data[off[i]:off[j]], off[i:j + 1] - off[i], T.ALNUM)
                n_words.append(w.counts)
                hits: dict[int, tuple[list, set]] = {}
                for length, (known, words) in index.items():
                    at, h = w.windows(length)
                    ok = np.flatnonzero(T.find(known, h) >= 0)
                    for a, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist()):
                        named = words.get((x, normalised(w, a, length)))
                        if named:
                            d = int(w.doc[a])
                            got = hits.setdefault(d, ([], set()))
                            got[0].append((a - int(w.bounds[d]), a - int(w.bounds[d]) + length))
                            got[1].update(named)
                for d in range(j - i):
                    s, m = hits.get(d, ((), ()))
                    spans.append(_merged([*((x["first"], x["end"]) for x in old_spans[i + d]), *s]))
                    items.append(sorted({*old_items[i + d], *m}))
            out = {c: batch.column(c) for c in ("doc_id", *["text"] * texts, *keep)}
            out["n_words"] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            out["spans"] = pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            out["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), slice_windows: int = SLICE_WINDOWS, texts: bool = True,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text, *keep, n_words, spans, items) of each row; no text if ``texts`` is off.

    ``spans``: merged word ranges [first, end) that benchmark windows cover;
    ``items``: sorted ids of the items with a window in the text.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("doc_id", "text", "n_words", "spans", "items")]
    grams = item_windows(items, window, item_col, item_text)
    slices = max(1, -(-grams.count() // slice_windows))
    grams = X.cut(grams) if slices > 1 else grams
    kinds = dict(docs.dtypes)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep, F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = lambda text: (f"doc_id {kinds[id_col]}" + ", text string" * text + "".join(f", `{c}` {kinds[c]}" for c in keep)
              + ", n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>")
    for s in range(slices):
        part = grams.where(F.pmod(F.xxhash64("item", "hash"), F.lit(slices)) == s) if slices > 1 else grams
        by_length: dict[int, list] = {}
        for r in part.collect():
            by_length.setdefault(r["length"], []).append((r["hash"], bytes(r["words"]), r["item"]))
        more = texts or s < slices - 1
        rows = rows.mapInArrow(_scan(spark.sparkContext.broadcast(by_length), keep, more), schema(more))
    return rows


def hit_words(spans: str = "spans"):
    """Words inside the spans, as a column."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, mode: str = "documents", **names) -> DataFrame:
    """Rows of ``docs`` after decontamination, with their columns.

    ``mode="documents"``: rows with a hit go.  ``mode="spans"``: the covered words
    go, the others stay joined by one space; untouched texts stay as they are.
    """
    id_col, text_col = names.pop("id_col", "doc_id"), names.pop("text_col", "text")
    # the scan's own columns and the input's may have the same names
    inner = {c: "doc_id" if c == id_col else "text" if c == text_col else f"kept_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()])
    found = scan(rows, items, window, keep=tuple(n for n in inner.values() if n.startswith("kept_")), **names)
    if mode == "documents":
        found = found.where(F.size("spans") == 0)
    else:
        words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
        inside = lambda i: F.exists("spans", lambda s: (i >= s["first"]) & (i < s["end"]))
        cut = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(F.filter(words, lambda w, i: ~inside(i)), " "))
        found = found.withColumn("text", cut)
    return found.select(*[F.col(name).alias(c) for c, name in inner.items()])
