"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of ``SLOTS`` bits; sliced by bits, slot ``s`` holds one
mask with bit L set if language L's filter has bit ``s`` set.  Looking an n-gram up takes
``HASHES`` masks, ANDed: all languages that contain it.  Per language the n-grams found in
a text are counted and corrected for false positives with the filter's fill; the largest
corrected count decides, ties go to the language with more training texts, then by name.

A language contains an n-gram if at least ``RATE`` of its training texts do and no other
language has it over ``1 / RELATIVE`` times as often.  The n-grams are 4 bytes of the
lower-cased letters with single spaces for all else, each once per text; so the filter
has a fixed size of ``SLOTS`` masks and is broadcast.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text with
letters but no known n-gram gets the language with most training texts, score 0; without
training texts all are ``und``; null languages are not learned.  Rows are scored one by
one, whatever their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.llm import textops as T

SLOTS, HASHES = 1 << 20, 3
RATE, RELATIVE = 0.002, 0.25
U = np.uint64

#: letters (ASCII ones in lower case, and all beyond ASCII) keep their byte, others become a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text index, 4-byte gram) pairs of lower-cased texts."""
    docs = len(off) - 1
    # a space before and after each text, runs of spaces made one
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(docs), np.diff(off)) + 1
    text = np.full(len(data) + 2 * docs, 32, np.uint8)
    text[at] = _FOLD[data]
    doc = np.repeat(np.arange(docs), np.diff(off) + 2)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (doc[1:] != doc[:-1])
    text, doc = text[keep].astype(np.uint64), doc[keep]
    n = len(text) - 3
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = (text[:n] << U(24)) | (text[1:n + 1] << U(16)) | (text[2:n + 2] << U(8)) | text[3:]
    inside = doc[:n] == doc[3:]
    key = np.unique((doc[:n][inside].astype(np.uint64) << U(32)) | g[inside])
    return (key >> U(32)).astype(np.int64), key & U(0xFFFFFFFF)


def slots_of(g: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The slots of each gram: double hashing."""
    h = T.mix(g.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    step = (h >> U(32)) | U(1)
    return [((h + U(i) * step) % U(slots)).astype(np.int64) for i in range(hashes)]


def _count(batches):
    """(lang, gram, n): texts of the partition with each gram, by language."""
    found: dict[str, list] = {}

    def merge(parts):
        keys = np.concatenate([k for k, _ in parts])
        n = np.concatenate([c for _, c in parts])
        one, at = np.unique(keys, return_inverse=True)
        return one, np.bincount(at, weights=n, minlength=len(one)).astype(np.int64)

    for batch in batches:
        data, off = T.text_buffer(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), object)
        for i, j in T.sub_blocks(off):
            doc, g = grams(data[off[i]:off[j]], off[i:j + 1] - off[i])
            of = lang[i:j][doc]
            for name in set(lang[i:j]):
                one, n = np.unique(g[of == name], return_counts=True)
                parts = found.setdefault(name, [])
                parts.append((one, n))
                if len(parts) > 8:
                    found[name] = [merge(parts)]
    for name, parts in found.items():
        one, n = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(one), pa.string()), pa.array(one.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Filter:
    """Bit-sliced filters: ``masks[slot, word]`` holds 64 languages a word."""

    def __init__(self, langs: list[str], masks: np.ndarray, hashes: int):
        self.langs, self.masks, self.hashes = langs, masks, hashes
        fill = [((masks[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(langs))]
        self.false = np.array(fill) ** hashes

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each gram."""
        out = None
        for s in slots_of(g, len(self.masks), self.hashes):
            out = self.masks[s] if out is None else out & self.masks[s]
        return out

    def counts(self, doc: np.ndarray, g: np.ndarray, docs: int) -> np.ndarray:
        """Corrected number of grams of each text in each language."""
        mask = self.lookup(g)
        n = np.bincount(doc, minlength=docs)
        out = np.zeros((docs, len(self.langs)))
        for i in range(len(self.langs)):
            hits = np.bincount(doc[(mask[:, i // 64] >> U(i % 64)) & U(1) > 0], minlength=docs)
            out[:, i] = np.maximum(hits - n * self.false[i], 0) / max(1 - self.false[i], 1e-9)
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, hashes: int = HASHES,
          rate: float = RATE, relative: float = RELATIVE) -> Filter | None:
    """Filters from all given texts with a language; None without any."""
    source = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.lower(text_col).alias("text"), F.col(lang_col).alias("lang"))
    size = [(r["lang"], r["count"]) for r in source.groupBy("lang").count().collect()]
    if not size:
        return None
    langs = [name for name, _ in sorted(size, key=lambda x: (-x[1], x[0]))]
    total = source.sparkSession.createDataFrame([(n, c, langs.index(n)) for n, c in size], "lang string, texts bigint, bit int")
    df = source.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = df.join(F.broadcast(total), "lang").select("bit", "gram", (F.col("n") / F.col("texts")).alias("p"))
    best = shares.groupBy("gram").agg(F.max("p").alias("top"), F.collect_list(F.struct("bit", "p")).alias("each")).where(F.col("top") >= rate)
    has = best.select("gram", F.explode("each").alias("e"), "top").where((F.col("e.p") >= rate) & (F.col("e.p") >= relative * F.col("top")))

    def spread(batches):
        for batch in batches:
            g = batch.column("gram").to_numpy().view(np.uint64)
            bit = batch.column("bit").to_numpy()
            for s in slots_of(g, slots, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(bit // 64), pa.array((U(1) << (bit % 64).astype(np.uint64)).view(np.int64))],
                                                 ["slot", "word", "mask"])

    rows = (has.select("gram", F.col("e.bit").cast("bigint").alias("bit")).mapInArrow(spread, "slot bigint, word bigint, mask bigint")
            .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas())
    masks = np.zeros((slots, -(-len(langs) // 64)), np.uint64)
    masks[rows["slot"].to_numpy(np.int64), rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(langs, masks, hashes)


def predict(docs: DataFrame, model: Filter | None, keep: tuple[str | Column, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(*keep, lang_pred, score) of each row; the score is the winner's part of all corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*keep, F.lower(text_col).alias("__text"), letters.alias("__letters"))
    names = source.columns[:-2]

    def run(batches):
        filters = shared.value
        for batch in batches:
            data, off = T.text_buffer(batch.column("__text"))
            lang, score = [], []
            for i, j in T.sub_blocks(off):
                if filters is None:
                    lang += ["und"] * (j - i)
                    score.append(np.zeros(j - i))
                    continue
                doc, g = grams(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = filters.counts(doc, g, j - i)
                lang += [filters.langs[k] for k in n.argmax(axis=1)]
                score.append(n.max(axis=1) / np.maximum(n.sum(axis=1), 1e-12))
            ok = np.array(batch.column("__letters").to_pylist(), bool)
            score = np.where(ok, np.concatenate(score) if score else np.zeros(0), 0.0)
            out = {c: batch.column(c) for c in names}
            out["lang_pred"] = pa.array([x if y else "und" for x, y in zip(lang, ok)], pa.string())
            out["score"] = pa.array(np.clip(score, 0.0, 1.0))
            yield pa.RecordBatch.from_pydict(out)

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double")
