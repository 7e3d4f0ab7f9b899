"""Mention extraction (G1) with phrase match (C13), token frames (E4) and
mention counts (G8).

A book is never one task.  Plan:
  1. its tokens are dealt to blocks of ``BLOCK`` tokens, each with the tokens
     around it that its passages and phrases need (``token_blocks``, one shuffle
     by (url, block)); a book may come as one cell or as rows of chunks;
  2. the book's cast, one short text, is sent to each of its blocks and becomes
     an Aho-Corasick automaton over tokens: one pass finds every alias, whatever
     their number (C13);
  3. per block and character the first listed alias of a position wins
     (``min_by``), then greedy left-to-right non-overlap: an overlap over a block
     border is a *carry*, the number of tokens at the next block's start that are
     taken.  Only blocks whose candidates reach over their border have one;
  4. mentions are numbered by a running sum of the blocks' counts and cut out of
     the block's own tokens, all of a block in its one row; a job that wants all
     passages of a character in one row has them cut there too (``cut_pieces``).
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlens.functions.text import arrow_udf, fold, fold_str, py_strip, tokens
from charlens.session import checkpoint_root, scratch_path

#: tokens per block of a book
BLOCK = 1 << 17


def normalize_aliases(df: DataFrame, col: str, sep: str = ",") -> Column:
    """List of strings | separator string | missing -> list of stripped,
    non-blank strings (column may be ARRAY<STRING>, STRING or VARIANT)."""
    dt = dict(df.dtypes)[col]
    c = F.col(col)
    if dt == "variant":
        as_list = F.try_variant_get(c, "$", "array<string>")
        as_text = F.split(F.try_variant_get(c, "$", "string"), sep, -1)
        c = F.when(F.schema_of_variant(c).startswith("ARRAY"), as_list).otherwise(as_text)
    elif dt == "string":
        c = F.split(c, sep, -1)
    c = F.coalesce(c, F.array().cast("array<string>"))
    return F.filter(F.transform(c, lambda a: py_strip(a)), lambda a: a.isNotNull() & (a != ""))


def alias_table(characters: DataFrame, url="url", name="name", aliases="aliases") -> DataFrame:
    """Name first, then aliases in the given order; blank names are skipped.
    Each alias is folded as a whole string and then split (S1 then S2)."""
    names = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    ex = characters.select(
        F.col(url).alias("url"), F.col(name).alias("character"), F.posexplode(names).alias("alias_no", "alias")
    ).where(F.col("alias").isNotNull() & (py_strip("alias") != ""))
    toks = ex.withColumn("toks", tokens(fold(F.col("alias"))))
    # read by several branches of the plan: written once, so the Python fold runs once
    checkpoint_root(characters.sparkSession)
    return toks.where(F.size("toks") > 0).select(
        "url", "character", "alias_no", "toks", F.size("toks").alias("alias_len")).checkpoint()


def longest(aliases: DataFrame) -> int:
    """Tokens of the longest alias."""
    return int(aliases.agg(F.max("alias_len")).first()[0] or 1)


# ---- blocks ------------------------------------------------------------------
def token_blocks(books: DataFrame, before: int, after: int, block: int | None = None) -> DataFrame:
    """(url, block, first, text): each block's tokens, joined by one blank, with the
    ``before`` tokens that precede and the ``after`` that follow it; ``first`` is the
    place of the first one in the book.

    ``books(url, text)`` has a row per book; with a column ``chunk_no`` a book is the
    rows of its url in that order, cut at white space (``read_book_chunks``).  A book
    without tokens has no block.  No row is larger than a chunk or a block."""
    block = block or BLOCK
    chunked = "chunk_no" in books.columns
    if chunked:
        # only token counts meet in a book's window, never its text
        by = Window.partitionBy("url")
        sizes = books.select("url", "chunk_no", F.col("n") if "n" in books.columns else _count(F.col("text")).alias("n"))
        places = sizes.select("url", "chunk_no", (F.sum("n").over(by.orderBy("chunk_no")) - F.col("n")).alias("start"), F.sum("n").over(by).alias("total"))
        # the text moves, its tokens, far larger as an array, are made behind the join
        rows = books.select("url", "chunk_no", "text").join(places, ["url", "chunk_no"]).withColumn("toks", tokens(F.col("text")))
    else:
        rows = books.select("url", tokens(F.col("text")).alias("toks"))
        rows = rows.withColumn("start", F.lit(0).cast("bigint")).withColumn("total", F.size("toks").cast("bigint"))
    end = F.col("start") + F.size("toks")
    number = lambda place: F.floor(place / block)
    low = number(F.greatest(F.col("start") - after, F.lit(0)))
    high = F.least(number(end - 1 + before), number(F.col("total") - 1))

    def piece(b: Column) -> Column:
        at = F.greatest(F.col("start"), b * block - before)
        n = F.least(end, (b + 1) * block + after) - at
        text = F.array_join(F.slice("toks", (at - F.col("start") + 1).cast("int"), n.cast("int")), " ")
        return F.struct(b.alias("block"), at.alias("first"), text.alias("text"))

    # the slices are cut inside the row: the book's token array is never copied per block
    each = F.when(F.size("toks") > 0, F.transform(F.sequence(low, high), piece))
    pieces = rows.select("url", F.explode(each).alias("p")).select("url", "p.*")
    pieces = pieces.repartition("url", "block")
    if not chunked:
        return pieces
    parts = F.array_sort(F.collect_list(F.struct("first", "text")))
    joined = pieces.groupBy("url", "block").agg(parts.alias("parts"))
    return joined.select("url", "block", F.col("parts")[0]["first"].alias("first"),
                         F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


def _count(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def _gathered(books: DataFrame) -> DataFrame:
    """The chunks as a table of the shared folder with their token counts ``n``: several
    branches read it, and each would gather the chunks in Python again."""
    path = scratch_path(books.sparkSession, "chunks")
    books.select("url", "chunk_no", "text", _count(F.col("text")).alias("n")).write.parquet(path)
    return books.sparkSession.read.parquet(path)


def _most_blocks(books: DataFrame, block: int) -> DataFrame:
    """(url, most): a bound on the blocks' numbers of a book by its characters (two make a token at least)."""
    size = books.groupBy("url").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"))
    return size.select("url", F.floor((F.col("chars") + F.col("rows")) / 2 / block).alias("most"))


def one_block_each(books: DataFrame, block: int) -> bool:
    """Whether no book can have a second block."""
    if "chunk_no" not in books.columns:
        return (books.agg(F.max(F.length("text"))).first()[0] or 0) < 2 * block
    return not (_most_blocks(books, block).agg(F.max("most")).first()[0] or 0)


def _casts(books: DataFrame, aliases: DataFrame, block: int, single: bool) -> DataFrame:
    """(url, block, cast, names): the aliases of a book as one text, a line each, for
    each block it can have."""
    entries = F.array_sort(F.collect_list(F.struct("character", "alias_no", "toks", "alias_len")))
    cast = aliases.groupBy("url").agg(entries.alias("entries")).select(
        "url", F.array_join(F.transform("entries", lambda e: F.array_join(e["toks"], " ")), "\n").alias("cast"),
        F.transform("entries", lambda e: F.struct(e["character"].alias("character"), e["alias_no"].alias("alias_no"), e["alias_len"].alias("alias_len"))).alias("names"))
    if single:  # not a literal: as a constant it would leave the join's key, and the blocks' shuffle would not fit
        return cast.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))))
    return cast.join(_most_blocks(books, block), "url").select(
        "url", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most"))).alias("block"), "cast", "names")


class PhraseBook:
    """Aho-Corasick automaton over tokens: all phrases that end at a token in one step."""

    def __init__(self, phrases: list[list[str]]):
        self.ids: dict[str, int] = {}
        self.size = [len(p) for p in phrases]
        self.go: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for no, phrase in enumerate(phrases):
            at = 0
            for token in phrase:
                key = self.ids.setdefault(token, len(self.ids))
                if key not in self.go[at]:
                    self.go[at][key] = len(self.go)
                    self.go.append({})
                    ends.append([])
                at = self.go[at][key]
            ends[at].append(no)
        self.fall = [0] * len(self.go)
        level = list(self.go[0].values())
        while level:
            below = []
            for at in level:
                for key, to in self.go[at].items():
                    self.fall[to] = self._step(self.fall[at], key)
                    ends[to] += ends[self.fall[to]]
                    below.append(to)
            level = below
        self.ends = [tuple(e) for e in ends]

    def _step(self, at: int, key: int) -> int:
        while at and key not in self.go[at]:
            at = self.fall[at]
        return self.go[at].get(key, 0)

    def find(self, toks: list[str]) -> tuple[list[int], list[int]]:
        """(phrase numbers, places of their first tokens) of every occurrence."""
        which, where, at = [], [], 0
        for i, key in enumerate(map(self.ids.get, toks)):
            if key is None:
                at = 0
                continue
            at = self._step(at, key)
            for no in self.ends[at]:
                which.append(no)
                where.append(i + 1 - self.size[no])
        return which, where


def _find_batch(text: pa.Array, cast: pa.Array) -> pa.Array:
    # one text at a time is a Python string; the finds are numbers in flat buffers
    book, of = None, None
    which, place, ends = array("i"), array("i"), array("i", [0])
    for t, c in zip(text, cast):
        c = c.as_py()
        if c != of:
            book, of = PhraseBook([line.split(" ") for line in c.split("\n")]), c
        found = book.find(fold_str(t.as_py()).split(" "))
        which.extend(found[0])
        place.extend(found[1])
        ends.append(len(which))
    lists = [pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(x))) for x in (which, place)]
    return pa.StructArray.from_arrays(lists, ["which", "place"])


def candidates_in(blocks: DataFrame, books: DataFrame, aliases: DataFrame, block: int, single: bool) -> DataFrame:
    """C13 over ``token_blocks``: (url, block, character, pos, alias_no, alias_len) of
    every place where an alias's folded token sequence occurs, told by the block that
    owns its first token."""
    find = arrow_udf(_find_batch, "which array<int>, place array<int>", F.arrow_udf)
    hit = blocks.join(_casts(books, aliases, block, single).hint("shuffle_hash"), ["url", "block"]).withColumn("f", find("text", "cast"))
    hit = hit.where(F.size("f.which") > 0).select("url", "block", "names", F.explode(F.transform(
        F.arrays_zip("f.which", "f.place"), lambda x: F.struct(x["which"].alias("which"), (F.col("first") + x["place"]).alias("pos")))).alias("h"))
    own = hit.where(F.floor(F.col("h.pos") / block) == F.col("block"))
    return own.select("url", "block", F.col("names")[F.col("h.which")].alias("e"), F.col("h.pos").alias("pos")).select(
        "url", "block", "e.character", "pos", "e.alias_no", "e.alias_len")


def candidates(books: DataFrame, aliases: DataFrame, max_len: int | None = None, block: int | None = None) -> DataFrame:
    """Every (url, block, character, pos, alias_no, alias_len) of ``books``."""
    block = block or BLOCK
    blocks = token_blocks(books, 0, (max_len or longest(aliases)) - 1, block)
    return candidates_in(blocks, books, aliases, block, one_block_each(books, block))


# ---- greedy choice -------------------------------------------------------------
def _chosen(place, size, end: int) -> tuple[list[int], int]:
    """Which candidates stay, left to right without overlap, if the tokens before ``end`` are taken; the new end."""
    kept = []
    for i, (p, n) in enumerate(zip(place, size)):
        if p >= end:
            kept.append(i)
            end = p + n
    return kept, int(end)


def _chosen_batch(place: pd.Series, size: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else _chosen(p, n, e)[0] for p, n, e in zip(place, size, end)])


def _carry_batch(place: pd.Series, size: pd.Series, start: pd.Series, stop: pd.Series, most: pd.Series) -> pd.Series:
    """Per carry into the block (0 to the longest alias less one) the carry out of it."""
    return pd.Series([[max(0, _chosen(p, n, a + c)[1] - z) for c in range(m)] for p, n, a, z, m in zip(place, size, start, stop, most)])


def _carries(found: DataFrame, max_len: int, block: int) -> DataFrame:
    """(url, character, block, carry): taken tokens at the start of blocks that follow a
    candidate reaching over a border.

    A block's candidates map its carry in to a carry out; where the map is constant, or no
    candidate reaches into the block, the carry out is known.  Runs of blocks that hand
    it on from border to border are resolved by composing maps, twice the blocks a round."""
    over = F.exists(F.arrays_zip("place", "size"), lambda x: x["place"] + x["size"] > (F.col("block") + 1) * block)
    table = arrow_udf(_carry_batch, "array<int>")("place", "size", F.col("block") * block, (F.col("block") + 1) * block, F.lit(max_len))
    maps = found.where(over).select("url", "character", "block", table.alias("map")).checkpoint()
    ahead = maps.select("url", "character", (F.col("block") + 1).alias("block"), F.lit(True).alias("entered"))
    maps = maps.join(ahead, ["url", "character", "block"], "left")
    known = F.col("entered").isNull() | (F.size(F.array_distinct("map")) == 1)
    # carry out if known, else a map of the carry out of block ``since`` - 1
    state = maps.select("url", "character", "block", F.when(known, F.col("map")[0]).alias("out"), "map", F.col("block").alias("since")).checkpoint()
    while not state.where("out is null").isEmpty():
        back = state.select("url", "character", (F.col("block") + 1).alias("since"), F.col("out").alias("b_out"), F.col("map").alias("b_map"),
                            F.col("since").alias("b_since"))
        state = state.join(back, ["url", "character", "since"], "left").select(
            "url", "character", "block", F.coalesce("out", F.col("map")[F.col("b_out")]).alias("out"),
            F.when(F.col("out").isNull() & F.col("b_out").isNull(), F.transform("b_map", lambda c: F.col("map")[c])).otherwise(F.col("map")).alias("map"),
            F.when(F.col("out").isNull() & F.col("b_out").isNull(), F.col("b_since")).otherwise(F.col("since")).alias("since")).checkpoint()
    return state.select("url", "character", (F.col("block") + 1).alias("block"), F.col("out").alias("carry"))


def choose_places(cands: DataFrame, max_len: int, block: int, single: bool) -> DataFrame:
    """(url, block, character, place, size): the first listed alias per position, then greedy
    non-overlap over the whole book, as two arrays a block and character, in order.

    The candidates of a block and character are one short row; rows are matched with
    their neighbours' carries, so no task holds more of a book than a block.
    ``single``: no book has a second block, so there is nothing to carry."""
    if block < max_len:
        raise ValueError("a block must hold the longest alias")
    best = cands.groupBy("url", "block", "character", "pos").agg(F.min_by("alias_len", "alias_no").cast("int").alias("len"))
    found = best.groupBy("url", "block", "character").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("items"))
    found = found.select("url", "block", "character", F.transform("items", lambda x: x["pos"]).alias("place"), F.transform("items", lambda x: x["len"]).alias("size"))
    start = F.col("block") * block
    if max_len > 1:
        if single:
            found = found.withColumn("carry", F.lit(0))
        else:
            checkpoint_root(cands.sparkSession)
            found = found.checkpoint()  # read twice below
            found = found.join(_carries(found, max_len, block), ["url", "character", "block"], "left")
        after = F.arrays_zip("place", "size", F.slice("place", 2, F.size("place")).alias("next"))
        crowded = (F.col("carry") > 0) | F.exists(after, lambda x: x["place"] + x["size"] > x["next"])
        chosen = arrow_udf(_chosen_batch, "array<int>")(F.when(crowded, F.col("place")), F.col("size"), start + F.coalesce("carry", F.lit(0)))
        found = found.withColumn("kept", chosen)
        pick = lambda c: F.when(F.col("kept").isNull(), F.col(c)).otherwise(F.transform("kept", lambda i: F.col(c)[i]))
        found = found.select("url", "block", "character", pick("place").alias("place"), pick("size").alias("size"))
    return found


def number_mentions(found: DataFrame, single: bool) -> DataFrame:
    """(url, block, character, pos, len, mention_no) of ``choose_places``, numbered by position in the book."""
    earlier = Window.partitionBy("url", "character").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.lit(0) if single else F.coalesce(F.sum(F.size("place").cast("bigint")).over(earlier), F.lit(0))
    found = found.withColumn("before", before)
    each = F.transform(F.arrays_zip("place", "size"), lambda x, i: F.struct(
        x["place"].cast("int").alias("pos"), x["size"].alias("len"), (F.col("before") + i).cast("int").alias("mention_no")))
    return found.select("url", "block", "character", F.explode(each).alias("m")).select("url", "block", "character", "m.*")


def cut_passages(blocks: DataFrame, mentions: DataFrame, window: int = 200) -> DataFrame:
    """passage = original tokens [pos-half, pos+len+half) clipped to the
    book, joined by one blank; half = max(1, window // 2).  The mentions of a
    block come to its row and are cut there."""
    half = max(1, window // 2)
    here = mentions.groupBy("url", "block").agg(F.collect_list(F.struct("character", "pos", "len", "mention_no")).alias("ms"))
    # hints: the text stays where it is, small sides come to it
    rows = blocks.join(here.hint("shuffle_hash"), ["url", "block"]).select("url", "first", "ms", F.split("text", " ", -1).alias("toks"))

    def cut(m: Column) -> Column:
        start = F.greatest(m["pos"] - half, F.lit(0)) - F.col("first")
        end = F.least(F.size("toks"), m["pos"] + m["len"] + half - F.col("first"))
        text = F.array_join(F.slice("toks", (start + 1).cast("int"), (end - start).cast("int")), " ")
        return F.struct(m["character"].alias("character"), m["pos"].alias("pos"), m["len"].alias("len"), text.alias("passage"), m["mention_no"].alias("mention_no"))

    return rows.select("url", F.explode(F.transform("ms", cut)).alias("m")).select("url", "m.*")


def _spans_batch(text: pa.Array, first: pa.Array, place: pa.Array, size: pa.Array, half: pa.Array, whole: pa.Array) -> pa.Array:
    """Where the passages of a row lie (bytes): in its text if ``whole``, else in what they cover of it, each token once."""
    ends, place, size = place.offsets.to_numpy(), place.values.to_numpy(), size.values.to_numpy()
    low, high = (np.zeros(len(place), dtype=np.int32) for _ in range(2))
    spans = []
    for i, (t, f, h, all_of_it) in enumerate(zip(text, first.to_numpy(), half.to_numpy(), whole.to_pylist())):
        raw, own = t.as_buffer().to_pybytes(), slice(ends[i], ends[i + 1])
        blank = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
        begin, stop = np.append(0, blank + 1), np.append(blank, len(raw))
        # texts of a book listed twice may differ: a passage behind the end of one is empty there
        start = np.minimum(np.maximum(place[own] - h, 0) - f, len(begin))
        end = np.maximum(np.minimum(place[own] + size[own] + h - f, len(begin)), start)
        begin, stop = np.append(begin, len(raw)), np.append(0, stop)
        low[own], high[own] = begin[start], np.maximum(stop[end], begin[start])
        if all_of_it:
            spans.append(None)
            continue
        fresh = np.flatnonzero(np.append(True, low[own][1:] > np.maximum.accumulate(high[own])[:-1]))
        a, z = low[own][fresh], np.maximum.reduceat(high[own], fresh)
        spans.append(b"".join(raw[x:y] for x, y in zip(a, z)))
        moved = np.repeat(a - np.append(0, np.cumsum(z - a)[:-1]), np.diff(np.append(fresh, len(start)))).astype(np.int32)
        low[own] -= moved
        high[own] -= moved
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (low, high)]
    return pa.StructArray.from_arrays([pa.array(spans, pa.binary()), *lists], ["text", "low", "high"])


def cut_pieces(blocks: DataFrame, found: DataFrame, window: int = 200, mixed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, character, ``keep``, at, pieces): E4 with all passages of a character in one row.

    ``found`` is ``choose_places`` with a column ``several``: whether a character has several
    pieces, as its mentions lie in several blocks or its book is listed twice (``mixed``: some
    may).  ``pieces`` (text, place, low, high) are a block's text, or what the passages cover of
    it, and the bytes of each passage in that.  ``at`` (block, place, size, low, high) serves to
    cut again, as rows of ``found``: where low and high are known nothing is searched.

    Passages overlap and are many times the books, so none of them moves: a sole piece stays
    at its block, several come together with each token once."""
    half, keep = F.lit(max(1, window // 2)), ("url", "character", *keep)
    spans = arrow_udf(_spans_batch, "struct<text binary, low array<int>, high array<int>>", F.arrow_udf)
    known = "low" in found.columns

    def rows(here: DataFrame, sole: bool) -> DataFrame:
        # hint: the text stays where it is, small sides come to it
        here = blocks.join(here.hint("shuffle_hash"), ["url", "block"])
        if sole and known:
            return here.select(*keep, "block", "low", "high", F.col("text").cast("binary").alias("text"))
        here = here.withColumn("s", spans("text", "first", "place", "size", half, F.lit(sole)))
        return here.select(*keep, "block", "place", "size", "s.low", "s.high", (F.col("text").cast("binary") if sole else F.col("s.text")).alias("text"))

    def at(place: str | None, low: str | None) -> Column:
        names = {"place": place, "size": place and "size", "low": low, "high": low and "high"}
        types = {"place": "array<bigint>", "size": "array<int>", "low": "array<int>", "high": "array<int>"}
        return F.struct("block", *[(F.col(c) if c else F.lit(None)).cast(types[n]).alias(n) for n, c in names.items()])

    piece = lambda place: F.struct("text", F.col(place).cast("array<bigint>").alias("place"), "low", "high")
    # a sole piece has its passages in the order of its bytes
    sole = rows(found.where("not several") if mixed else found, True).select(
        *keep, F.array(at(None, "low")).alias("at"), F.array(piece("low")).alias("pieces"))
    if not mixed:
        return sole
    return sole.union(rows(found.where("several"), False).groupBy(*keep).agg(
        F.collect_set(at("place", None)).alias("at"), F.collect_list(piece("place")).alias("pieces")))


def find_mentions(books: DataFrame, characters: DataFrame, window: int = 200, url="url", name="name",
                  aliases="aliases", block: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(token blocks, ``choose_places`` of them, whether no book has a second block)."""
    al = alias_table(characters, url, name, aliases)
    if "chunk_no" in books.columns:
        books = _gathered(books)
    max_len, half, block = longest(al), max(1, window // 2), block or BLOCK
    # one shuffle of the text by (url, block); both readers of the blocks reuse it
    blocks = token_blocks(books, half, half + max_len, block)
    single = one_block_each(books, block)
    return blocks, choose_places(candidates_in(blocks, books, al, block, single), max_len, block, single), single


def place_mentions(books: DataFrame, characters: DataFrame, window: int = 200,
                   url="url", name="name", aliases="aliases", block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(token blocks, mentions as places in them): what ``cut_passages`` takes.  A job that
    reads the mentions several times keeps the places, short rows, and cuts texts when needed."""
    blocks, found, single = find_mentions(books, characters, window, url, name, aliases, block)
    return blocks, number_mentions(found, single)


def extract_mentions(books: DataFrame, characters: DataFrame, window: int = 200,
                     url="url", name="name", aliases="aliases", block: int | None = None) -> DataFrame:
    """G1: all mentions of every character in its book with the token window
    around each.  ``books(url, text)`` or ``(url, chunk_no, text)``,
    ``characters(url, name, aliases)``; a character whose book is missing gets
    no rows (inner join)."""
    return cut_passages(*place_mentions(books, characters, window, url, name, aliases, block), window)


def mention_counts(characters: DataFrame, mentions: DataFrame, url="url", name="name") -> DataFrame:
    """Mentions per character, 0 kept for characters without any."""
    cnt = mentions.groupBy("url", "character").agg(F.count("*").alias("mentions_counter"))
    ch = characters.select(F.col(url).alias("url"), F.col(name).alias("character")).distinct()
    return ch.join(cnt, ["url", "character"], "left").select(
        "url", "character", F.coalesce("mentions_counter", F.lit(0)).cast("bigint").alias("mentions_counter")
    )
