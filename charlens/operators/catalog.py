"""Catalogue matching (C7, B7, D8): does a catalogue entry contain the wanted
title (case-insensitive substring) and list an author containing the wanted
author's last name?

The substring theta-join is an equi-join on starts of the wanted texts: the key of
a wanted text is the text itself up to 16 code points, of a longer one its start of
at least four fifths.  An entry sends a 64-bit hash of a substring only where some wanted
text may begin: the first code points of all wanted texts, dealt to a fixed number of
buckets, are broadcast with the key lengths that follow them.  Pairs that meet are few
more than those that match, and the exact predicate is checked on them.  An empty
title is matched on authors alone, last names against authors in the same way.  No
nested-loop or cartesian join is planned.

Texts such as "the" stand in a large part of all titles.  Keys are counted by length
and a bucket of their hashes; a bucket with more than 1/``HEAVY`` of all postings is
heavy, so there are fewer than ``HEAVY`` of them whatever the catalogue: only these are
broadcast, their postings are dealt over as many salts as keep each share below that
part, and the few wanted texts in them visit every share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.functions.text import last_token_lower, py_strip
from charlens.session import checkpoint_root, scratch_path

#: first code points of a key by which substrings are told apart before they move
LEAD = 6
#: buckets of such first code points: the rows of what is broadcast
STARTS = 1 << 18
#: buckets of the keys of a length whose postings are counted
PARTS = 1 << 12
#: a gram is heavy beyond this part of all postings
HEAVY = 1024


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of length n (all of text when shorter).  A fixed n
    uses one native regex pass (overlapping matches through a lookahead)."""
    if isinstance(n, int):
        allg = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))
        return F.when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(allg))
    ln = F.length(text)
    return F.when(ln <= n, F.array(text)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), ln - n + 1), lambda i: F.substring(text, i, n)))
    )


def heavy_grams(freq: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(k, g, cnt, salts) of the grams of ``freq`` (k, g, cnt) with more than 1/``heavy`` of all postings: fewer than ``heavy`` rows."""
    total = freq.agg(F.sum("cnt")).first()[0] or 1
    share = max(1.0, total / heavy)
    return freq.where(F.col("cnt") > share).withColumn("salts", F.ceil(F.col("cnt") / share).cast("int"))


def salted(postings: DataFrame, heavy: DataFrame) -> DataFrame:
    """``postings`` (cid, k, g) with the share ``salt`` each belongs to: one share but for heavy grams."""
    dealt = postings.join(F.broadcast(heavy.select("k", "g", "salts")), ["k", "g"], "left")
    salt = F.pmod(F.xxhash64("cid"), F.coalesce("salts", F.lit(1))).cast("int")
    return dealt.withColumn("salt", salt).drop("salts")


def _key_length(n: Column) -> Column:
    """Code points of a text of ``n`` that are its key: all of 16, else a multiple of a quarter of the power of two below."""
    step = F.pow(F.lit(2), F.floor(F.log2(n)) - 2).cast("int")
    return F.when(n <= 16, n).otherwise(n - n % step)


def _part(k: Column, h: Column) -> list[Column]:
    return [k.alias("k"), F.pmod(h, F.lit(PARTS)).alias("g")]


def _postings(texts: DataFrame, starts: DataFrame, leads: list[int]) -> DataFrame:
    """(cid, k, g, h): a hash ``h`` of each substring of ``texts`` (cid, x) of length ``k`` with which a wanted text may begin."""
    ln = F.length("x")
    at = texts.where(ln > 0).select("cid", "x", F.explode(F.sequence(F.lit(1), ln)).alias("i"))
    at = at.select("cid", "x", "i", F.explode(F.array(*map(F.lit, leads))).alias("m")).where(F.col("i") + F.col("m") <= ln + 1)
    at = at.withColumn("b", _start(F.substring("x", F.col("i"), F.col("m")))).join(F.broadcast(starts), "b")
    at = at.select("cid", "x", "i", "m", F.explode("lens").alias("k"))
    at = at.where((F.least("k", F.lit(LEAD)) == F.col("m")) & (F.col("i") + F.col("k") <= ln + 1))
    at = at.select("cid", "k", F.xxhash64(F.substring("x", F.col("i"), F.col("k"))).alias("h"))
    return at.select("cid", *_part(F.col("k"), F.col("h")), "h")


def _start(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(STARTS))


def occurrences(want: DataFrame, texts: DataFrame, w: str) -> DataFrame:
    """Rows of ``want`` with the ``cid`` of every row of ``texts`` (cid, x) that contains the
    text ``w`` of at least one code point, and of few that do not: the caller checks."""
    keyed = want.withColumn("k", _key_length(F.length(w))).withColumn("h", F.xxhash64(F.substring(w, F.lit(1), F.col("k"))))
    lead = F.least("k", F.lit(LEAD))
    starts = keyed.groupBy(_start(F.substring(w, F.lit(1), lead)).alias("b")).agg(F.collect_set("k").alias("lens")).checkpoint()
    # the lengths that the first code points of a key have: LEAD numbers at most
    leads = sorted(r[0] for r in keyed.select(lead).distinct().collect())
    if not leads:
        return want.withColumn("cid", F.lit(None).cast("bigint")).limit(0)
    postings = _postings(texts, starts, leads)
    heavy = heavy_grams(postings.groupBy("k", "g").agg(F.count("*").alias("cnt")).checkpoint())
    probes = keyed.withColumn("g", _part(F.col("k"), F.col("h"))[1]).join(F.broadcast(heavy.select("k", "g", "salts")), ["k", "g"], "left")
    probes = probes.select(*want.columns, "h", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return probes.join(salted(postings, heavy).select("cid", "h", "salt"), ["h", "salt"]).select(*want.columns, "cid")


def flag_in_catalog(books: DataFrame, catalog: DataFrame, title: str = "title", author: str = "author",
                    cat_title: str = "title", cat_authors: str = "authors") -> DataFrame:
    """Add ``found`` to ``books`` (null title -> false)."""
    spark = books.sparkSession
    checkpoint_root(spark)
    want = books.select(title, author).distinct().select(
        F.lower(py_strip(F.col(title))).alias("t"), last_token_lower(F.col(author)).alias("ln"),
    ).where(F.col("t").isNotNull()).distinct().checkpoint()  # read by several branches below, the books' own plan once
    # read by several branches too: a table, so that each reads its columns only
    path = scratch_path(spark, "catalog")
    authors = F.transform(F.coalesce(F.col(cat_authors), F.array().cast("array<string>")), lambda a: F.lower(a))
    catalog.select(
        F.lower(py_strip(F.coalesce(F.col(cat_title), F.lit("")))).alias("ct"),
        # authors joined by a line feed: a last name has no whitespace, so it
        # is contained in the joined text iff it is contained in one author
        F.array_join(authors, "\n").alias("ca"), (F.size(authors) > 0).alias("by"),
    ).where("by").select("ct", "ca", F.xxhash64("ct", "ca").alias("cid")).write.parquet(path)
    cat = spark.read.parquet(path)
    titled = want.where(F.length("t") > 0)
    cand = occurrences(titled, cat.select("cid", F.col("ct").alias("x")), "t")
    hits = cand.join(cat, "cid").where(F.contains("ct", "t") & F.contains("ca", "ln")).select("t", "ln").distinct()
    empty = want.where(F.length("t") == 0)
    if not empty.isEmpty():  # an empty title is contained in every one, so only authors decide
        hits = hits.unionByName(_empty_title_hits(empty, cat.select("cid", F.col("ca").alias("x"))))
    found = hits.withColumn("_found", F.lit(True))
    keyed = books.withColumn("t", F.lower(py_strip(F.col(title)))).withColumn("ln", last_token_lower(F.col(author)))
    out = keyed.join(found, ["t", "ln"], "left")
    return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("t", "ln", "_found")


def _empty_title_hits(empty: DataFrame, authors: DataFrame) -> DataFrame:
    """Empty wanted title: found iff the last name is part of an author of ``authors`` (cid, x)."""
    # last name '' is contained in any author: found iff any author exists
    # (an uncorrelated EXISTS subquery, planned as a filter, not a join)
    blank = empty.where((F.col("ln") == "") & authors.exists())
    authors = authors.select(F.explode(F.split("x", "\n")).alias("x")).distinct().select(F.xxhash64("x").alias("cid"), "x")
    named = occurrences(empty.where(F.col("ln") != ""), authors, "ln").join(authors, "cid")
    return blank.unionByName(named.where(F.contains("x", "ln")).select("t", "ln").distinct())


def found_share(flagged: DataFrame) -> DataFrame:
    """Books found, total."""
    return flagged.agg(F.count_if(F.col("found")).alias("found"), F.count("*").alias("total"))
