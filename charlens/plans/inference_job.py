"""K2: the inference job -- mentions -> passage selection -> prompt -> model.

``strategy='all_mentions'`` keeps every passage in text order (G3);
``strategy='embedding'`` keeps the top ``k`` passages per attribute query by
embedding similarity and unites them in first-appearance order (G2, E2, E3).
Characters whose book is missing are dropped (the reference skips them);
characters without a mention keep a row with a null output (B11).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from charlens.functions.text import WS_CLASS, py_strip
from charlens.operators import mentions as MN
from charlens.operators import retrieval as R
from charlens.operators.inference import embed_distinct, embed_keyed, infer, prompt_key, text_key
from charlens.session import checkpoint_root

STRATEGIES = ("all_mentions", "embedding")


def select_passages(spark: SparkSession, blocks: DataFrame, places: DataFrame, characters: DataFrame, attrs: Sequence[str],
                    strategy: str, embed: Callable[[pd.Series], pd.Series] | None = None,
                    window: int = 200, k: int = 10) -> DataFrame:
    """(url, character, passages) for every character that has mentions, from ``place_mentions``.

    Passages overlap and are many times the books: they are cut where they are used and
    never stored before the choice."""
    if strategy == "all_mentions":
        return R.all_passages(MN.cut_passages(blocks, places, window))
    if strategy != "embedding":
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    if embed is None:
        raise ValueError("the embedding strategy needs an embed plug-in")
    checkpoint_root(spark)
    keys = ["url", "character"]
    row = [*keys, "mention_no"]
    # every distinct passage text and query text is embedded once: passages meet by their
    # keys alone, and the first of equal ones is cut again for the plug-in
    places = places.where(F.col("character").isNotNull())  # no query asks for others
    keyed = MN.cut_passages(blocks, places, window).select(*row, text_key("passage").alias("key")).checkpoint()
    first = keyed.groupBy("key").agg(F.min(F.struct(*row)).alias("f")).select("f.*")
    texts = MN.cut_passages(blocks, places.join(first, row, "left_semi"), window)
    vecs = embed_keyed(texts.select(text_key("passage").alias("key"), F.col("passage").alias("text")), embed)
    vecs = vecs.groupBy("key").agg(F.first("vec").alias("vec"))  # a book listed twice gives its passages twice
    queries = R.attribute_queries(spark, characters.select(F.col("url"), F.col("name").alias("character")).distinct(),
                                  attrs)
    pv = keyed.join(vecs, "key").select(*keys, F.col("mention_no").alias("passage_no"), F.col("vec").alias("embedding"))
    qv = queries.select(*keys, "attr_no", text_key("query").alias("key")).join(embed_distinct(queries, embed, "query"), "key").select(
        *keys, "attr_no", F.col("vec").alias("embedding"))
    top = R.top_passages(pv, qv, keys, k)
    order = R.ordered_union(top, keys).withColumnRenamed("passage_no", "mention_no")
    # only what was chosen is cut; its place in the choice stands for its number
    chosen = places.join(order, row).drop("mention_no").withColumnRenamed("sel_order", "mention_no")
    sel = MN.cut_passages(blocks, chosen, window)
    return sel.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("mention_no", "passage"))),
                    lambda s: s["passage"]).alias("passages"))


def _with_all_mentions(books: DataFrame, characters: DataFrame, attrs: Sequence[str],
                       model_fn: Callable[[list[str]], list[str]], window: int) -> DataFrame:
    """``run_inference`` with every passage.

    The passages of a character overlap and are many times its book: neither they nor the
    prompts made of them are ever dealt or stored.  Places and prompt keys are checkpointed
    before the model calls; prompts and passages are cut at the blocks, the answers come there."""
    keys = ["url", "character"]
    blocks, found, single = MN.find_mentions(books, characters, window)
    # no row asks for mentions without a name; a block's places may all be taken by its carry
    found = found.where(F.col("character").isNotNull() & (F.size("place") > 0))
    # chunks of one block are one row however often they are listed
    listed = books.where("url is not null").groupBy("url").agg((F.count("*") > 1).alias("copied")).where("copied")
    once = "chunk_no" in books.columns or listed.isEmpty()
    mixed = not (single and once)
    found = found.withColumn("several", F.lit(False) if single else F.count("*").over(Window.partitionBy(*keys)) > 1)
    if not once:
        found = found.join(listed, "url", "left").withColumn("several", F.col("several") | F.coalesce("copied", F.lit(False))).drop("copied")
    if mixed:
        found = found.checkpoint()  # read twice below

    def read(places: DataFrame, *keep: str) -> DataFrame:
        return R.all_passages(MN.cut_pieces(blocks, places, window, mixed, keep))

    def placed(rows: DataFrame) -> DataFrame:
        each = rows.select("*", F.explode("at").alias("a")).select("*", "a.*")
        return each.withColumn("several", F.col("low").isNull()).drop("a", "at")

    def prompt(rows: DataFrame) -> DataFrame:
        said = F.exists("passages", lambda p: p.rlike("[^" + WS_CLASS[1:]))  # blank is what py_strip would empty
        return rows.withColumn("prompt", F.when(said, R.build_prompt(F.col("character"), R.excerpts(F.col("passages")), attrs)))

    asked = prompt(read(found)).select(*keys, "at", prompt_key(F.col("prompt")).alias("pkey")).checkpoint()
    answered = infer(asked, model_fn, "pkey", make=lambda rows: prompt(read(placed(rows), "pkey"))).drop("pkey")
    if mixed:
        answered = answered.checkpoint()  # read twice below
    told = read(placed(answered), "output", "status").select(*keys, "output", "status", "mentions_counter", "passages")
    none = characters.join(books.select("url"), "url", "left_semi").select("url", F.col("name").alias("character")).distinct()
    none = none.join(asked.select(*keys), keys, "left_anti").select(
        *keys, F.lit(None).cast("string").alias("output"), F.lit("skipped").alias("status"),
        F.lit(0).cast("bigint").alias("mentions_counter"), F.array().cast("array<string>").alias("passages"))
    return told.union(none).select(F.col("url").alias("book"), "character", "output", "status", "mentions_counter",
                                   F.col("passages").alias("selected_passages"))


def run_inference(spark: SparkSession, books: DataFrame, characters: DataFrame, attrs: Sequence[str],
                  strategy: str, model_fn: Callable[[list[str]], list[str]],
                  embed: Callable[[pd.Series], pd.Series] | None = None, window: int = 200,
                  k: int = 10) -> DataFrame:
    """Predictions ``(book, character, output, status, mentions_counter,
    selected_passages)``; ``characters(url, name, aliases array)``."""
    # the places of the mentions feed several branches (counts, selection): written
    # once to the shared checkpoint folder instead of being recomputed, and a
    # lost executor does not send the search back to the books
    checkpoint_root(spark)  # the session's shared folder (set only when unset)
    if strategy == "all_mentions":
        return _with_all_mentions(books, characters, attrs, model_fn, window)
    blocks, places = MN.place_mentions(books, characters, window)
    places = places.checkpoint()
    # as many as passages: those of a book listed twice count twice
    counts = MN.mention_counts(characters.join(books.select("url"), "url", "left_semi"), blocks.select("url", "block").join(places, ["url", "block"]))
    sel = select_passages(spark, blocks, places, characters, attrs, strategy, embed, window, k).select(
        "url", "character", "passages")
    # checkpointed before the (expensive, retried) model calls
    rows = counts.join(sel, ["url", "character"], "left").withColumn(
        "passages", F.coalesce("passages", F.array().cast("array<string>"))).checkpoint()
    exc = R.excerpts(F.col("passages"))
    prompts = rows.select("url", "character", F.when(py_strip(exc) != "", R.build_prompt(F.col("character"), exc, attrs)).alias("prompt"))
    # the passages stay where they are: answers come to them by the character
    out = rows.join(infer(prompts, model_fn).drop("prompt"), ["url", "character"], "left")
    return out.select(
        F.col("url").alias("book"), "character", "output",
        # no mention has a null book or name, so what meets no answer had no prompt
        F.coalesce("status", F.lit("skipped")).alias("status"),
        "mentions_counter", F.col("passages").alias("selected_passages"),
    )
