"""Graph-statement jobs: star patterns and joins (C1-C6), property counts (D1, D2),
multi-value fold (D3), basic info (D4) and wide flatten (D5).

Statements are a long table ``(s, p, o[, ord])``; labels ``(id, label, lang)``.
Every pattern is a filter on ``p`` (pushed to the scan / partition pruning
when the dump is partitioned by ``p``); a pattern around one subject is one
aggregation by it, others are equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.functions.text import uri_tail


def _prop(st: DataFrame, p: str, s_as: str, o_as: str | None = None) -> DataFrame:
    cols = [F.col("s").alias(s_as)] + ([F.col("o").alias(o_as)] if o_as else [])
    return st.where(F.col("p") == p).select(*cols)


def label_table(labels: DataFrame, lang: str = "en") -> DataFrame:
    """B6 + C6: one label per id in ``lang`` (first = smallest, for determinism)."""
    return labels.where(F.col("lang") == lang).groupBy("id").agg(F.min("label").alias("label"))


def with_label(df: DataFrame, id_col: str, labels: DataFrame, out_col: str, fallback: bool = True) -> DataFrame:
    """C4: optional label join; without a label fall back to the last URI
    segment (``fallback``) or null."""
    lt = labels.select(F.col("id").alias("_lid"), F.col("label").alias("_lbl"))
    j = df.join(lt, df[id_col] == lt["_lid"], "left")
    val = F.coalesce(F.col("_lbl"), uri_tail(F.col(id_col))) if fallback else F.col("_lbl")
    return j.withColumn(out_col, val).drop("_lid", "_lbl")


def star_books(st: DataFrame, labels: DataFrame, cutoff: str, genre: str,
               genre_p: str = "genre", char_p: str = "character", date_p: str = "date",
               author_p: str = "author", catalog_p: str = "catalog_id") -> DataFrame:
    """C1 in one pass: (book, title, author, date, has_id) of books of ``genre`` with at
    least one character, a date strictly before ``cutoff`` and an author.

    The pattern is a star: all its statements share the subject.  Statements that can
    take part are folded by subject, map-side first, so a book with very many characters
    or repeated statements sends one row per task, and the star is matched on that row
    without any self join.  A book with two authors or dates gives several rows."""
    p, o = F.col("p"), F.col("o")
    # An unreadable date is not before the cutoff
    fits = (((p == genre_p) & (o == genre)) | ((p == date_p) & (o.try_cast("date") < F.to_date(F.lit(cutoff)))) | ((p == author_p) & o.isNotNull())
            | (p == char_p) | (p == catalog_p))
    of = lambda name: F.when(p == name, o)
    star = st.where(p.isin(genre_p, date_p, author_p, char_p, catalog_p) & F.col("s").isNotNull() & fits).groupBy(F.col("s").alias("book")).agg(
        F.max(p == genre_p).alias("fits"), F.max(p == char_p).alias("cast"), F.max(p == catalog_p).alias("has_id"),
        F.collect_set(of(date_p)).alias("dates"), F.collect_set(of(author_p)).alias("authors"))
    rows = star.where("fits and cast").select("book", "has_id", "authors", F.explode("dates").alias("date"))
    rows = rows.select("book", "has_id", "date", F.explode("authors").alias("author"))
    lt = label_table(labels)
    rows = with_label(with_label(rows, "book", lt, "title"), "author", lt, "author_name")
    return rows.select("book", "title", F.col("author_name").alias("author"), "date", "has_id").distinct()


def match_books(st: DataFrame, labels: DataFrame, cutoff: str, genre: str, has_catalog_id: bool = True, **names: str) -> DataFrame:
    """C1 + C2 or C3 (B4): distinct (book, title, author, date) of ``star_books`` with
    (C2) or without (C3) a catalogue id."""
    found = star_books(st, labels, cutoff, genre, **names)
    return found.where(F.col("has_id") if has_catalog_id else ~F.col("has_id")).drop("has_id")


def characters_of(books: DataFrame, st: DataFrame, labels: DataFrame, char_p: str = "character",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Book -> characters (1:n, a book without characters gives no row),
    with the character's label and the columns ``keep`` of the book."""
    rel = _prop(st, char_p, "book", "character_uri")
    j = books.select("book", F.col("title").alias("book_title"), F.col("author").alias("book_author"), *keep).join(
        rel, "book")
    j = with_label(j, "character_uri", label_table(labels), "character_name")
    return j.select("character_name", "character_uri", "book_title", "book_author", *keep)


def property_frequency(characters: DataFrame, st: DataFrame, labels: DataFrame,
                       prefix: str | None = None) -> DataFrame:
    """D1 (+ B5, C6, L1): statements per property over the characters'
    statements -- a property with two values counts twice, a repeated
    character row counts again.  Sorted by count desc, then id."""
    s = st if prefix is None else st.where(F.col("p").startswith(prefix))
    # one join of the statements with the distinct characters, each carrying how
    # often it is listed; counts are summed map-side
    who = characters.groupBy(F.col("character_uri").alias("s")).agg(F.count("*").alias("m"))
    cnt = s.join(who, "s").groupBy(uri_tail(F.col("p")).alias("property_id")).agg(F.sum("m").alias("count"))
    # no hint: the label table is data-sized; AQE broadcasts it only on its
    # measured shuffle size
    lt = label_table(labels)
    out = cnt.join(lt, cnt["property_id"] == lt["id"], "left").select("property_id", "count", "label")
    return out


def fold_attributes(st: DataFrame, labels: DataFrame, subjects: DataFrame | None = None,
                    entity_prefixes: Sequence[str] = (), order_col: str | None = None,
                    text_lang_col: str | None = None, lang_props: Sequence[str] = ()) -> DataFrame:
    """D3: ``(s, attributes MAP<label, ARRAY<STRUCT<text, lang>>>)`` -- per
    subject and property label the values deduplicated in first-seen order.
    Entity values show their label (fallback: last URI segment); literals
    show themselves.  ``order_col`` fixes "first seen"; without one the value
    order is the value itself.  The language of ``text_lang_col`` is kept for the
    properties ``lang_props`` only; elsewhere equal texts of two languages are one value."""
    lt = label_table(labels)
    s = st if subjects is None else st.join(subjects.select(F.col("character_uri").alias("s")).distinct(), "s",
                                            "left_semi")
    is_ent = F.lit(False)
    for pre in entity_prefixes:
        is_ent = is_ent | F.col("o").startswith(pre)
    s = s.withColumn("_ord", F.col(order_col) if order_col else F.col("o"))
    keeps_lang = F.col("p").isin(list(lang_props)) if text_lang_col and lang_props else F.lit(False)
    s = s.withColumn("_lang", F.when(keeps_lang, F.col(text_lang_col)) if text_lang_col else F.lit(None).cast("string"))
    # properties are few: label each once; only entity values need a label join,
    # literals (long, and most rows) never move by their text
    props = with_label(st.select("p").distinct(), "p", lt, "prop")
    is_ent = F.coalesce(is_ent, F.lit(False))
    ents = with_label(s.where(is_ent), "o", lt, "_text")
    lits = s.where(~is_ent).withColumn("_text", F.col("o"))
    s = ents.unionByName(lits).join(props, "p")
    s = s.select("s", "prop", "_ord", F.struct(F.col("_text").alias("text"), F.col("_lang").alias("lang")).alias("v"))
    # all aggregations group on the subject first: one shuffle on s; repeated
    # values are merged (first-seen order kept) before anything is collected
    s = s.repartition("s")
    s = s.groupBy("s", "prop", "v").agg(F.min("_ord").alias("_ord"))
    per = s.groupBy("s", "prop").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_ord", "v"))), lambda x: x["v"]).alias("values"),
        F.min("_ord").alias("_first"),
    )
    return per.groupBy("s").agg(
        F.map_from_entries(
            F.transform(F.array_sort(F.collect_list(F.struct("_first", "prop", "values"))),
                        lambda x: F.struct(x["prop"], x["values"]))
        ).alias("attributes")
    )


def attribute_coverage(docs: DataFrame) -> DataFrame:
    """Characters having each attribute key (unlike D1, once per character)."""
    return docs.select(F.explode(F.map_keys("attributes")).alias("attribute")).groupBy("attribute").agg(
        F.count("*").alias("count"))


def basic_info(st: DataFrame, alias_p: str = "alias", desc_p: str = "description",
               order_col: str | None = None) -> DataFrame:
    """Per subject the sorted alias set and the first description."""
    al = st.where(F.col("p") == alias_p).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("also_known_as"))
    ordc = F.col(order_col) if order_col else F.col("o")
    ds = st.where(F.col("p") == desc_p).groupBy("s").agg(F.min_by("o", ordc).alias("description"))
    return al.join(ds, "s", "full_outer").select(
        "s", F.coalesce("also_known_as", F.array().cast("array<string>")).alias("also_known_as"), "description")


def flatten_value(values: Column) -> Column:
    """D5 cell: list -> ', '-joined texts; a single {text, lang} -> its text."""
    return F.array_join(F.transform(values, lambda v: v["text"]), ", ")


def flatten_characters(docs: DataFrame, columns: Sequence[str], native_name_label: str | None = None) -> DataFrame:
    """One row per character, one column per listed attribute label
    (explicit list bounds the pivot), values ', '-joined; missing -> null.
    Attribute columns carry an ``attr_`` prefix so a label cannot overwrite a
    base column.  With ``native_name_label`` a single-valued native name
    yields a text and a language column."""
    ex = docs.select("s", F.explode("attributes").alias("k", "vals"))
    ex = ex.where(F.col("k").isin(list(columns)))
    cell = flatten_value(F.col("vals"))
    wide = ex.groupBy("s").pivot("k", list(columns)).agg(F.first(cell))
    for c in columns:
        wide = wide.withColumnRenamed(c, f"attr_{c}")
    if native_name_label:
        nn = docs.select(
            "s",
            F.when(F.size(F.col("attributes")[native_name_label]) == 1,
                   F.col("attributes")[native_name_label][0]["lang"]).alias("native_language_from_name"))
        wide = wide.join(nn, "s", "left")
    return wide
