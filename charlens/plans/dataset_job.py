"""K1: the dataset build -- from a statement dump to one wide row per character.

    with-id books (C1 + C2)                     -> characters (C5)  --+
    without-id books (C1 + C3) -> E1 (title, author) -> C7 -> B7 -> C5 -+-> G0a
    G0a -> E1 (name, uri) -> D3 fold + D4 basic info -> D5 flatten

The with-id branch is not deduplicated by (title, author) (a book with two
authors repeats its characters there); the final E1 removes the repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.operators import graph as G
from charlens.operators.catalog import flag_in_catalog
from charlens.operators.relational import dedup_first
from charlens.session import checkpoint_root


def build_dataset(st: DataFrame, labels: DataFrame, catalog: DataFrame, cutoff: str, genre: str,
                  wide_columns: Sequence[str] | None = None,
                  entity_prefixes: Sequence[str] = ("char/", "person/", "book/"),
                  alias_p: str = "alias", desc_p: str = "description") -> tuple[DataFrame, DataFrame | None]:
    """Returns (characters, wide table or None).  ``catalog(title, authors)``."""
    # one pass over the statements serves both branches
    checkpoint_root(st.sparkSession)
    books = G.star_books(st, labels, cutoff, genre).checkpoint()
    no_id = dedup_first(books.where(~F.col("has_id")).select("title", "author", "book"), ["title", "author"], ["book"])
    found = flag_in_catalog(no_id, catalog).where(F.col("found")).drop("found")
    both = found.withColumn("_br", F.lit(0)).unionByName(books.where("has_id").select("title", "author", "book", F.lit(1).alias("_br")))
    chars = dedup_first(G.characters_of(both, st, labels, keep=("_br",)), ["character_name", "character_uri"],
                        ["_br", "book_title", "book_author"]).drop("_br")
    if wide_columns is None:
        return chars, None
    # the character table feeds three branches (fold, basic info, final join):
    # written once to the shared checkpoint folder instead of re-running both
    # book branches and the catalogue match for each
    chars = chars.checkpoint()
    docs = G.fold_attributes(st, labels, chars, entity_prefixes=entity_prefixes)
    info = G.basic_info(st.join(chars.select(F.col("character_uri").alias("s")), "s", "left_semi"),
                        alias_p=alias_p, desc_p=desc_p)
    wide = G.flatten_characters(docs, wide_columns)
    base = chars.join(info, chars["character_uri"] == info["s"], "left").drop("s")
    base = base.withColumn("also_known_as", F.array_join(
        F.coalesce("also_known_as", F.array().cast("array<string>")), ", "))
    out = base.join(wide, base["character_uri"] == wide["s"], "left").drop("s")
    return chars, out
