r"""Alignment of two tokenizers over a corpus: which tokens end together, and how firmly.

``A`` (byte-level BPE) encodes a blank and the text, ``B`` (pieces with byte fallback)
the text, to which it adds the blank.  Byte offsets at which a token of each side ends
cut both into groups; the two tokens that end there are linked.  A pair of ids counts
how often it is linked in the corpus, and each text learns the sum of its links' counts
and how many of them are the best of their B id.

Method: external spill counting.  A task encodes its texts in runs of ``RUN_BYTES``.
A run's records (B id, A id, text) are sorted, radix-partitioned by the low bits of the
B id and spilled as zstd blocks to a table in the shared folder: distinct pairs with
their counts, and apart from them the texts of each pair.  Counting reads the pairs
alone: tasks merge up to ``FAN_IN`` runs of a radix by a k-way heap, level after level,
until one run per radix is left.  In its order, B id first, a B id's highest count is
known when its pairs end.  The counts then stream back to every run of the radix, are
added up per text, and meet the text's own row.

Runs, not occurrences, are merged: a pair that makes up a third of all links costs one
entry per run.  No task holds more than a run, ``FAN_IN`` runs of one radix, or the
distinct pairs of one radix, whose number the two vocabularies bound.

Encoding: no token of either side crosses a single blank between two characters that
are not white space (A splits there, no piece of B holds a blank after its first place:
checked on loading), so a text is the sequence of its pieces between such blanks.  Each
distinct piece is encoded once and kept for the next runs of the task.

Defined cases.  A null or empty text, or one that a side does not give back byte by byte
(one that holds U+2581, which B reads as a blank), has no tokens: zeros and the empty
string.  Strings of special tokens inside a text are plain text.  Texts are encoded
whole; a text longer than a run is a run of its own.  Rows count one by one, whatever
their ids: equal rows and rows without an id all count.  Further columns of any name are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange
from charlens.llm.textops import run_lengths

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of text and texts per run at most; runs merged at once; radix bits of the B id
RUN_BYTES, RUN_TEXTS, FAN_IN, RADIX = 8 << 20, 60_000, 64, 5
#: pieces remembered by a task (beyond it, those of the present run alone); pieces encoded at once, in characters
KEPT, BATCH = 300_000, 1 << 16
MARK = "▁"
#: blanks between two characters that are not white space
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s |^ | \s| $")


class Tokenizers:
    """Both sides, with the bytes of each id."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece with an inner blank: texts cannot be cut at blanks")
        assert len(pre_tokenizers.ByteLevel.alphabet()) == 256
        self.a_bytes = {i: self._byte_level(t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        self.sizes = tuple(np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (self.a_bytes, self.b_bytes))
        #: each id in decimals and the sign that follows it: inside a group, after its A side, after its B side
        self.signed = [f"{i}{sign}" for i in range(max(map(len, self.sizes))) for sign in ",|;"]

    @staticmethod
    @cache
    def _printed() -> dict[str, int]:
        """Character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on in order."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        rest = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _byte_level(self, token: str) -> bytes:
        printed = self._printed()
        return bytes(printed[c] for c in token) if all(c in printed for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of texts that begin with the added blank."""
        a = self.a.encode_batch(texts, add_special_tokens=False)
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [(np.array(x.ids, np.int64), np.array(y, np.int64)) for x, y in zip(a, b)]

    def faithful(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        raw = text.encode()
        return all(b"".join(map(side.__getitem__, ids.tolist())) == raw for side, ids in ((self.a_bytes, a), (self.b_bytes, b)))


@cache
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def pieces(text: str) -> list[str]:
    """The text between blanks that no token crosses (each piece without its blank)."""
    return _BLANK.split(text) if _ODD.search(text) else text.split(" ")


class Book:
    """Distinct pieces with their tokens: counts, groups as text, and linked pairs (B id << 16 | A id)."""

    def __init__(self, both: Tokenizers):
        self.both, self.at = both, {}
        #: per piece: tokens of each side (-1: a side does not give the piece back), links, groups
        self.n_a, self.n_b, self.n_links, self.text = [], [], [], []
        self.pairs: list[np.ndarray] = []

    def keep(self, wanted: set[str]) -> None:
        """Forget all other pieces."""
        old = np.array(self.n_links, np.int64)
        flat, start = np.concatenate([*self.pairs, np.zeros(0, np.uint32)]), np.cumsum(old) - old
        stay = [(p, i) for p, i in self.at.items() if p in wanted]
        which = [i for _, i in stay]
        size = old[which]
        self.at = {p: i for i, (p, _) in enumerate(stay)}
        self.n_a, self.n_b, self.n_links, self.text = ([x[i] for i in which] for x in (self.n_a, self.n_b, self.n_links, self.text))
        self.pairs = [flat[np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())]]

    def learn(self, new: Iterable[str]) -> None:
        """Encode new pieces, many in one text; a piece that white space begins or ends stands alone."""
        batch, size = [], 0
        for piece in new:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                self._encode([piece])
                continue
            batch.append(piece)
            size += len(piece) + 1
            if size > BATCH:
                self._encode(batch)
                batch, size = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        text = " " + " ".join(batch)
        a, b = self.both.encode([text])[0]
        if not self.both.faithful(text, a, b):
            if len(batch) > 1:
                for piece in batch:
                    self._encode([piece])
            else:
                self._add(batch, np.array([-1]), np.array([0]), np.array([0]), [""], np.zeros(0, np.uint32))
            return
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.both.sizes, (a, b)))
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        # the tokens group by group, A before B, each with the sign that follows it
        group = np.concatenate((np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)))
        side = np.repeat([0, 1], [len(a), len(b)])
        sign = np.zeros(len(side), np.int64)
        sign[at_a], sign[len(a) + at_b] = 1, 2
        order = np.lexsort((side, group))
        told, signed = self.both.signed, np.concatenate((a, b)) * 3 + sign
        told = [told[i] for i in signed[order].tolist()]
        stop = np.searchsorted(shared, np.cumsum([len(p.encode()) + 1 for p in batch])) + 1
        last_a, last_b = at_a[stop - 1] + 1, at_b[stop - 1] + 1
        ends = (last_a + last_b).tolist()
        texts = ["".join(told[i:j])[:-1] for i, j in zip([0, *ends], ends)]
        self._add(batch, np.diff(last_a, prepend=0), np.diff(last_b, prepend=0), np.diff(stop, prepend=0), texts,
                  (b[at_b] << 16 | a[at_a]).astype(np.uint32))

    def _add(self, batch: list[str], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, texts: list[str], pairs: np.ndarray) -> None:
        first = len(self.at)
        self.at.update(zip(batch, range(first, first + len(batch))))
        self.n_a += n_a.tolist()
        self.n_b += n_b.tolist()
        self.n_links += n_links.tolist()
        self.text += texts
        self.pairs.append(pairs)


SPILLED = ("run long, radix int, pairs binary, totals binary, widths binary, texts binary, times binary, "
           "place int, doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string")
_packer, _opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    return _packer.compress(np.ascontiguousarray(values).tobytes())


def opened(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_opener.decompress(blob), kind)


def spill(run: int, ids: pa.Array, texts: list[str | None], book: Book, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one run: its texts, and its pairs by radix."""
    cut = [pieces(t) if t and MARK not in t else [] for t in texts]
    wanted = set().union(*cut)
    if len(book.at) + len(wanted) > KEPT:
        book.keep(wanted)
    book.learn(sorted(wanted - book.at.keys()))
    at, n_a, n_b, n_links = book.at, np.array(book.n_a), np.array(book.n_b), np.array(book.n_links)
    digests, used = [], []
    for place, own in enumerate(cut):
        which = np.array([at[p] for p in own], np.int64)
        if len(which) == 0 or n_a[which].min() < 0:
            digests.append((0, 0, 0, ""))
            continue
        told = ";".join([book.text[i] for i in which.tolist()])
        digests.append((int(n_a[which].sum()), int(n_b[which].sum()), int(n_links[which].sum()), hashlib.sha256(told.encode()).hexdigest()))
        used.append((place, which))
    n = len(texts)
    columns = dict(zip(("n_a", "n_b", "n_groups", "groups_sha256"), zip(*digests)))
    yield _batch(schema, n, run=[run] * n, place=range(n), doc_id=ids, **columns)
    if not used:
        return
    which = np.concatenate([w for _, w in used])
    place = np.repeat(np.array([p for p, _ in used], np.uint64), [len(w) for _, w in used])
    # one sorted number per link: radix, B id, A id, text
    flat, size = np.concatenate(book.pairs), n_links[which]
    start = (np.cumsum(n_links) - n_links)[which]
    take = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    low = np.uint64((1 << RADIX) - 1)
    pair = flat[take].astype(np.uint64)
    keys = ((pair >> np.uint64(16) & low) << np.uint64(48)) | (pair << np.uint64(16)) | np.repeat(place, size)
    keys.sort()
    first, times = run_lengths(keys)
    keys = keys[first]
    heads, widths = run_lengths(keys >> np.uint64(16))
    totals = np.add.reduceat(times, heads)
    radix = (keys[heads] >> np.uint64(48)).astype(np.int64)
    bounds = np.searchsorted(radix, np.arange((1 << RADIX) + 1))
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        i, j = bounds[r], bounds[r + 1]
        lo, hi = heads[i], heads[j] if j < len(heads) else len(keys)
        yield _batch(schema, 1, run=[run], radix=[r], pairs=[packed((keys[heads[i:j]] >> np.uint64(16)).astype(np.uint32))],
                     totals=[packed(totals[i:j].astype(np.int64))], widths=[packed(widths[i:j].astype(np.uint32))],
                     texts=[packed(keys[lo:hi].astype(np.uint16))], times=[packed(times[lo:hi].astype(np.uint32))])


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else
         pa.array(list(columns[f.name]), f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def spilled(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """All runs of ``docs`` as a table in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(SPILLED.format(kind.simpleString()))
    schema = to_arrow_schema(shape)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, run = Book(tokenizers(folder)), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.large_string()))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, min(int(np.searchsorted(sizes, sizes[i] + RUN_BYTES, "right")) - 1, i + RUN_TEXTS, batch.num_rows))
                yield from spill(run, batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i).to_pylist(), book, schema)
                i, run = j, run + 1

    path = exchange.scratch(spark, "aligned")
    rows.mapInArrow(encode, shape).write.parquet(path)
    return spark.read.parquet(path)


def merged(runs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts of some sorted runs in one: a k-way heap over them."""
    cursors = [zip(opened(p, np.uint32).tolist(), opened(t, np.int64).tolist())
               for p, t in zip(runs.column("pairs").to_pylist(), runs.column("totals").to_pylist())]
    pairs, totals, last = [], [], None
    for pair, n in heapq.merge(*cursors) if len(cursors) > 1 else cursors[0]:
        if pair == last:
            totals[-1] += n
        else:
            pairs.append(pair)
            totals.append(n)
            last = pair
    return np.array(pairs, np.uint32), np.array(totals, np.int64)


def counted(runs: DataFrame) -> DataFrame:
    """(radix, pairs, totals): all runs merged, ``FAN_IN`` at a time, to one per radix."""
    found = runs.where("radix is not null").select("radix", "run", "pairs", "totals")
    left = runs.select("run").distinct().count()

    def merge(table: pa.Table) -> pa.Table:
        pairs, totals = merged(table)
        return pa.table({"radix": table.column("radix").slice(0, 1), "run": table.column("part").slice(0, 1),
                         "pairs": pa.array([packed(pairs)], pa.binary()), "totals": pa.array([packed(totals)], pa.binary())})

    while True:
        left = max(1, -(-left // FAN_IN))
        found = found.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(left))).groupBy("radix", "part").applyInArrow(
            merge, "radix int, run long, pairs binary, totals binary")
        if left == 1:
            return found.select("radix", "pairs", "totals")


def best_of(pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their B id (pairs in order, B id first)."""
    first, size = run_lengths(pairs >> np.uint32(16))
    return totals == np.repeat(np.maximum.reduceat(totals, first), size) if len(pairs) else np.zeros(0, bool)


def returned(runs: DataFrame) -> DataFrame:
    """(run, places, sums, bests): per run and radix what the counts of its links add to each of its texts."""
    spills = runs.where("radix is not null")
    parts = max(1, -(-spills.select("run").distinct().count() // FAN_IN))
    part = F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int").alias("part")
    asked = spills.select("radix", part, "run", "pairs", "widths", "texts", "times")
    known = counted(runs).select("radix", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "pairs", "totals")

    def give_back(mine: pa.Table, all_of: pa.Table) -> pa.Table:
        out = {"run": [], "places": [], "sums": [], "bests": []}
        if mine.num_rows:
            pairs, totals = opened(all_of.column("pairs")[0].as_py(), np.uint32), opened(all_of.column("totals")[0].as_py(), np.int64)
            best = best_of(pairs, totals)
        for i in range(mine.num_rows):
            own = mine.slice(i, 1)
            get = lambda name, kind: opened(own.column(name)[0].as_py(), kind)  # noqa: E731, B023
            at = np.repeat(np.searchsorted(pairs, get("pairs", np.uint32)), get("widths", np.uint32))
            place, times = get("texts", np.uint16), get("times", np.uint32).astype(np.int64)
            order = np.argsort(place, kind="stable")
            first, _ = run_lengths(place[order])
            out["run"].append(own.column("run")[0].as_py())
            out["places"].append(packed(place[order][first]))
            out["sums"].append(packed(np.add.reduceat((totals[at] * times)[order], first)))
            out["bests"].append(packed(np.add.reduceat((best[at] * times)[order], first)))
        return pa.table({"run": pa.array(out["run"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("places", "sums", "bests")}})

    return asked.groupBy("radix", "part").cogroup(known.groupBy("radix", "part")).applyInArrow(
        give_back, "run long, places binary, sums binary, bests binary")


def aligned(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    runs = spilled(docs, folder, id_col, text_col)
    texts = runs.where("radix is null").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def add_up(own: pa.Table, back: pa.Table) -> pa.Table:
        place = own.column("place").to_numpy()
        sums, bests = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64)
        at = np.argsort(place)
        for i in range(back.num_rows):
            where = at[opened(back.column("places")[i].as_py(), np.uint16)]
            sums[where] += opened(back.column("sums")[i].as_py(), np.int64)
            bests[where] += opened(back.column("bests")[i].as_py(), np.int64)
        got = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
        return pa.table({**got, "n_links": own.column("n_groups"), "n_best": bests, "count_sum": sums, "groups_sha256": own.column("groups_sha256")})

    return texts.groupBy("run").cogroup(returned(runs).groupBy("run")).applyInArrow(
        add_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
