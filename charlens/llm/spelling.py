r"""Spelling variants: words one edit apart, grouped under the more frequent form.

Words are maximal runs of Latin letters (``RUN``), A-Z lower-cased, counted over all
texts; kept are those of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.
Two words are near if one inserted, deleted or replaced code point turns one into the
other.  A word's form is its most frequent near word (ties: smallest in code point
order) if that is at least twice as frequent, and its root is where the forms end.

Method: k-d trees over letter counts.  A replaced letter lowers one count by one and
raises another, an inserted one raises one: L1 distance two and one.  Words of a length
form a tree; its upper part, fitted on a bounded sample, cuts the length into cells of
about ``CELL`` words.  Every word is put into its own cell, and is sent as a query to
the cells of its own length and the next one whose boxes its edits can reach.  A cell
is one task: it builds the lower tree and walks it with all its queries at once, leaving
out boxes that need more than one letter up or one down; in the leaves a parity mask
of the letters, then the letter order itself, is compared.  The sample only places the
cuts; every word is indexed and every search is exact.

Defined cases.  Null and empty texts have no words; a null id counts as the empty string
in the checksum of ``lost_letter``; rows that repeat count as often as they occur.
Letters count by code point, upper-case letters beyond A-Z stay as they are.  Words of
any length are compared (counts above 100 of one letter are cut to 100, which only
widens the search).  Further columns of any name are not read.  No words: no rows.

What moves: word counts, summed map-side; each word once to its cell and as a query to
the cells it can reach; near pairs, at most proportional to word length x alphabet per
word, folded map-side to one best per word.  Roots by pointer doubling: forms at least
double the count, so a chain has at most log2 of the largest count links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: words per cell, sampled words per cell for the cuts, points per leaf
CELL, SAMPLE, LEAF = 1 << 14, 64, 32
#: letters a-z, and the others folded into six more dimensions (which never lengthens a distance)
DIMS = 32
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
_BIT = np.array([1 << (c - 97 if 97 <= c <= 122 else 26 + c % 38) for c in range(256)], np.uint64)
#: bytes of compared letters at once
BLOCK = 1 << 23


def lost_letter(doc_id: Column, run: Column) -> Column:
    """One run in 97, told by the checksum of its text and id, loses the letter at that checksum."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (crc % F.length(run)).cast("int")
    return F.when(crc % 97 == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, damaged: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id",
          text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts; ``damaged`` maps (id, run) to the word that counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.select("doc_id", low.alias("run"))
    word = damaged(F.col("doc_id"), F.col("run")) if damaged else F.col("run")
    rows = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(texts: list[str], length: int) -> np.ndarray:
    """(word, place) matrix of code points of words of one length."""
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """(dimension, word) letter counts, at most 100 each."""
    n = len(codes)
    out = np.zeros((DIMS, n), np.int8)
    for i in range(0, n, step := max(1, BLOCK // max(1, codes.shape[1]))):
        part = codes[i:i + step]
        at = np.arange(len(part))[:, None] * DIMS + _DIM[part]
        counts = np.bincount(at.ravel(), minlength=len(part) * DIMS)
        out[:, i:i + step] = np.minimum(counts, 100).reshape(-1, DIMS).T
    return out


def reaches(q: np.ndarray, low: np.ndarray, high: np.ndarray, down: int) -> np.ndarray:
    """Which queries (columns of ``q``) come into the box with one letter more and ``down`` (0 or 1) fewer."""
    more = np.maximum(low[:, None] - q, 0).sum(0, dtype=np.int16)
    less = np.maximum(q - high[:, None], 0).sum(0, dtype=np.int16)
    return (more <= 1) & (less <= down)


def halves(points: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(dimension, cut, which points lie below or at the cut) of the most even split; None if all are equal."""
    spread = np.flatnonzero(points.min(1) < points.max(1))
    best = None
    for d in spread:
        row = points[d]
        cut = int(np.partition(row, (len(row) - 1) // 2)[(len(row) - 1) // 2])
        cut -= cut == row.max()
        share = abs(2 * np.count_nonzero(row <= cut) - len(row))
        if best is None or share < best[0]:
            best = (share, int(d), cut)
    if best is None:
        return None
    _, d, cut = best
    return d, cut, points[d] <= cut


class Cells:
    """The upper part of a length's tree: boxes of cells, in the order of their numbers."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.low, self.high = [], []
        self._split(sample, np.zeros(DIMS, np.int8), np.full(DIMS, 100, np.int8), cells)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> None:
        found = halves(points) if cells > 1 and points.shape[1] > 1 else None
        if found is None:
            self.low.append(low)
            self.high.append(high)
            return
        d, cut, below = found
        left, right = high.copy(), low.copy()
        left[d], right[d] = cut, cut + 1
        self._split(points[:, below], low, left, cells // 2)
        self._split(points[:, ~below], right, high, cells - cells // 2)

    def own(self, v: np.ndarray) -> np.ndarray:
        """The cell that holds each point: the boxes tile the space."""
        out = np.zeros(v.shape[1], np.int64)
        for c, (low, high) in enumerate(zip(self.low, self.high)):
            out[((v >= low[:, None]) & (v <= high[:, None])).all(0)] = c
        return out


class Tree:
    """A k-d tree over the columns of ``points``; leaves hold at most ``LEAF`` of them unless they are equal."""

    def __init__(self, points: np.ndarray):
        self.nodes: list[tuple] = []  # (box low, box high, left, right, members)
        self._build(points, np.arange(points.shape[1]))

    def _build(self, points: np.ndarray, members: np.ndarray) -> int:
        here = len(self.nodes)
        own = points[:, members]
        self.nodes.append((own.min(1), own.max(1), 0, 0, members))
        found = halves(own) if len(members) > LEAF else None
        if found:
            below = found[2]
            left = self._build(points, members[below])
            right = self._build(points, members[~below])
            self.nodes[here] = (*self.nodes[here][:2], left, right, None)
        return here

    def walk(self, q: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) of each leaf that some queries reach."""
        todo = [(0, np.arange(q.shape[1]))]
        while todo:
            node, asked = todo.pop()
            low, high, left, right, members = self.nodes[node]
            asked = asked[reaches(q[:, asked], low, high, down)]
            if len(asked) == 0:
                continue
            if members is None:
                todo += [(left, asked), (right, asked)]
            else:
                yield asked, members


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of code points that differ by exactly one replaced (equal lengths) or inserted letter."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    front = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= n


def pairs(members: list[str], queries: list[str], length: int, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) indices of near words: members of ``length`` letters, queries of ``asked``, equal or one less."""
    m, q = letters(members, length), letters(queries, asked)
    parity = [np.bitwise_xor.reduce(_BIT[x], axis=1) for x in (q, m)]
    bits = 2 if asked == length else 1
    tree, out = Tree(vectors(m)), []
    step = max(1, BLOCK // length)
    for who, there in tree.walk(vectors(q), int(asked == length)):
        for i in range(0, len(who), each := max(1, BLOCK // (8 * len(there)))):
            part = who[i:i + each]
            a, b = np.nonzero(np.bitwise_count(parity[0][part][:, None] ^ parity[1][there][None]) <= bits)
            a, b = part[a], there[b]
            for j in range(0, len(a), step):
                ok = one_edit(q[a[j:j + step]], m[b[j:j + step]])
                out.append((a[j:j + step][ok], b[j:j + step][ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


ROUTED = "length int, cell int, asked int, word string, n bigint"
PAIRS = "word string, near string, near_n bigint"


def routed(counted: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """(length, cell, asked, word, n): each word in its own cell (``asked`` null) and as a query, of ``asked`` letters, where it reaches."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(w) for w in batch.column("word").to_pylist()])
            for length in np.unique(size):
                mine = pa.RecordBatch.take(batch, pa.array(np.flatnonzero(size == length)))
                v = vectors(letters(mine.column("word").to_pylist(), length))
                rows = [(length, trees[length].own(v), None, None)]
                for to in (length, length + 1):
                    if to in trees:
                        for c, (low, high) in enumerate(zip(trees[to].low, trees[to].high)):
                            rows.append((to, c, length, np.flatnonzero(reaches(v, low, high, int(to == length)))))
                for to, cell, asked, which in rows:
                    part = mine if which is None else mine.take(pa.array(which))
                    if part.num_rows:
                        k = part.num_rows
                        cell = pa.array(cell, pa.int32()) if which is None else pa.array(np.full(k, cell), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, to), pa.int32()), cell, pa.array([asked] * k, pa.int32()),
                             part.column("word").cast(pa.string()), part.column("n")], ["length", "cell", "asked", "word", "n"])

    return counted.mapInArrow(route, ROUTED)


def searched(cell: pa.Table) -> pa.Table:
    """The near pairs that the members of one cell are part of, both ways where the lengths differ."""
    length = cell.column("length")[0].as_py()
    asked = cell.column("asked").to_numpy()
    members = cell.filter(pa.array(np.isnan(asked)))
    out = []
    if members.num_rows:
        names, counts = members.column("word").to_pylist(), members.column("n").to_numpy()
        for size in (length, length - 1):
            queries = cell.filter(pa.array(asked == size))
            if queries.num_rows:
                q = queries.column("word")
                a, b = pairs(names, q.to_pylist(), length, size)
                out.append((q.take(pa.array(a)), members.column("word").take(pa.array(b)), counts[b]))
                if size != length:
                    out.append((members.column("word").take(pa.array(b)), q.take(pa.array(a)), queries.column("n").to_numpy()[a]))
    flat = lambda x: pa.concat_arrays([c.cast(pa.string()) for c in x.chunks]) if x.num_chunks else pa.array([], pa.string())
    tables = [pa.table({"word": flat(w), "near": flat(x), "near_n": pa.array(n, pa.int64())}) for w, x, n in out]
    return pa.concat_tables(tables) if tables else pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})


def cut_trees(counted: DataFrame, cell: int = CELL) -> dict[int, Cells]:
    """The cells of each length; lengths beyond one cell are cut on a sample of ``SAMPLE`` words a cell."""
    sizes = {r["length"]: r["n"] for r in counted.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    cells = {length: -(-n // cell) for length, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for length, k in cells.items() if k > 1 for x in (length, min(1.0, SAMPLE * k / sizes[length]))] or [F.lit(0), F.lit(0.0)])
    chance = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / (1 << 20)
    sample: dict[int, list[str]] = {}
    if max(cells.values(), default=1) > 1:
        for r in counted.where(chance < F.try_element_at(share, F.length("word"))).select("word").collect():
            sample.setdefault(len(r["word"]), []).append(r["word"])
    return {length: Cells(vectors(letters(sample.get(length, []), length)), k) for length, k in cells.items()}


def near_pairs(counted: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): every pair of near words of ``counted`` (word, n), both ways."""
    return routed(counted, cut_trees(counted, cell)).groupBy("length", "cell").applyInArrow(searched, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with the root of each word, by pointer doubling."""
    links = exchange.cut(forms.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = exchange.cut(links.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(counted: DataFrame, cell: int = CELL, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``counted`` (word, n)."""
    counted = exchange.cut(counted)
    best = near_pairs(counted, cell).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    strong = -F.col("best.minus") >= factor * F.col("n")
    forms = exchange.cut(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.minus")).cast("bigint").alias("form_n")))
    return roots(forms)
