"""Passage selection and prompt assembly.

Scoring joins queries and passages on the entity key (a character of one
book), so the work is attributes x mentions per entity -- linear in the
mentions, never all pairs of a global group.  Top-k uses ``row_number`` with
a limit filter, which Spark plans as a partial WindowGroupLimit before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from charlens.functions.text import underscore_to_blank
from charlens.functions.vectors import dot

#: task line of every attribute query
RETRIEVAL_TASK = "Find the parts of a book that tell what is asked about one of its characters"

#: attribute -> (what it means, what its JSON value is); queries and prompts derive from it
ATTRIBUTES: dict[str, tuple[str, str]] = {
    "age": ("stage of life", "string, a stage: child, teenager, adult, senior"),
    "gender": ("gender", "string"),
    "origin": ("birthplace or homeland", "list of place names, widest first"),
    "native_language": ("mother tongue", "string"),
    "residence": ("home", "list of place names, widest first"),
    "spoken_languages": ("languages understood or used", "list of strings"),
    "type": ("species", "object with is_human (boolean) and character_type (string, empty for humans)"),
    "occupation": ("trades, offices and ranks held", "list of strings"),
    "physical_health": ("bodily condition", "string"),
}


def all_passages(mentions: DataFrame, keys: Sequence[str] = ("url", "character")) -> DataFrame:
    """G3 (+ G8 in the same aggregation): every passage of an entity in text
    order and the number of mentions; from rows of mentions, or of entities with
    ``pieces`` (``mentions.cut_pieces``), which keep their columns."""
    if "pieces" in mentions.columns:
        rows = mentions.withColumn("passages", _from_pieces(F.col("pieces"))).drop("pieces")
        return rows.withColumn("mentions_counter", F.size("passages").cast("bigint"))
    return mentions.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "passage"))), lambda s: s["passage"]).alias(
            "passages"
        ),
        F.count("*").alias("mentions_counter"),
    )


def _from_pieces(pieces: Column) -> Column:
    def cut(p: Column) -> Column:
        # the text is bound once a piece: as a field it would be copied for each passage
        each = lambda text: F.transform(F.arrays_zip(p["place"], p["low"], p["high"]), lambda m: F.struct(
            m["place"].alias("pos"), F.substring(text, m["low"] + 1, m["high"] - m["low"]).cast("string").alias("passage")))
        return F.flatten(F.transform(F.array(p["text"]), each))

    return F.transform(F.array_sort(F.flatten(F.transform(pieces, cut))), lambda m: m["passage"])


def attribute_queries(spark: SparkSession, entities: DataFrame, attrs: Sequence[str],
                      questions: Mapping[str, str] | None = None, name_col: str = "character") -> DataFrame:
    """One query text per (entity, known attribute); unknown attributes are
    skipped (and never shift other rows).  Templates are a literal array
    exploded per entity (no join)."""
    q = {a: f"{what} of {{name}}" for a, (what, _) in ATTRIBUTES.items()} | dict(questions or {})
    known = F.array(*[
        F.struct(F.lit(i).alias("attr_no"), F.lit(a).alias("attr"), F.lit(q[a]).alias("question"))
        for i, a in enumerate(attrs) if a in q
    ])
    ex = entities.select("*", F.explode(known).alias("_t"))
    text = F.concat(
        F.lit("Instruct: " + RETRIEVAL_TASK + "\nQuery: "),
        F.replace(F.col("_t.question"), F.lit("{name}"), F.col(name_col)),
    )
    return ex.select(*entities.columns, F.col("_t.attr_no").alias("attr_no"), F.col("_t.attr").alias("attr"),
                     text.alias("query"))


def top_passages(passages: DataFrame, queries: DataFrame, keys: Sequence[str], k: int = 10,
                 pvec: str = "embedding", qvec: str = "embedding", passage_id: str = "passage_no") -> DataFrame:
    """G2 + E2: score = 100 * dot(unit vectors) per (entity, attribute query,
    passage); keep the k best per query, equal scores -> later passage first."""
    p = passages.select(*keys, passage_id, F.col(pvec).alias("_pv"))
    q = queries.select(*keys, "attr_no", F.col(qvec).alias("_qv"))
    j = q.join(p, list(keys))
    scored = j.select(*keys, "attr_no", passage_id, (dot("_qv", "_pv") * 100.0).alias("score"))
    w = Window.partitionBy(*keys, "attr_no").orderBy(F.col("score").desc(), F.col(passage_id).desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ordered_union(top: DataFrame, keys: Sequence[str], passage_id: str = "passage_no") -> DataFrame:
    """Passages of all attributes without repeats, each at its first
    appearance in (attribute order, rank order)."""
    first = top.groupBy(*keys, passage_id).agg(F.min(F.struct("attr_no", "rank")).alias("f"))
    w = Window.partitionBy(*keys).orderBy("f")
    return first.select(*keys, passage_id, (F.row_number().over(w) - 1).alias("sel_order"))


def excerpts(passages: Column) -> Column:
    """Joined excerpts text handed to the model."""
    return F.array_join(passages, "\n\n ")


def build_prompt(name: Column, excerpt: Column, attrs: Sequence[str],
                 formats: Mapping[str, str] | None = None) -> Column:
    """One prompt per entity: the task with the attributes named in text ('_'
    -> blank, joined by ' and '), the excerpts, then one line per attribute with
    its JSON value; null stands for what the excerpts leave open."""
    fm = {a: value for a, (_, value) in ATTRIBUTES.items()} | dict(formats or {})
    readable = F.array_join(F.transform(F.array(*[F.lit(a) for a in attrs]), underscore_to_blank), " and ")
    keys = "".join(f"\n- {a}: {fm[a]}" for a in attrs)
    return F.concat(
        F.lit("Character: "), name, F.lit("\nWanted: "), readable, F.lit("\n\nExcerpts:\n\n"), excerpt,
        F.lit("\n\nAnswer with a JSON object (null = the excerpts leave it open), keys:" + keys + "\n"),
    )
