"""Registered catalogue-match queries (C7, B7, D8, L3) on wanted/catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.operators.catalog import flag_in_catalog, found_share
from charlens.operators.relational import top_n
from charlens.plans.registry import register
from charlens.sources.fixtures import view, with_clause

_SQL = with_clause("wanted", "catalog") + """,
w AS (select title, author, lower(trim(title)) t,
   coalesce(lower(list_last(string_split_regex(trim(author), '\\s+'))), '') ln from wanted),
f AS (select title, author, coalesce(t is not null and exists (select 1 from catalog c
   where contains(lower(trim(coalesce(c.title, ''))), w.t) and contains(lower(c.author), w.ln)), false) found from w)
"""


def _flags(spark, sf):
    wanted = view(spark, sf, "wanted")
    cat = view(spark, sf, "catalog").select("title", F.array("author").alias("authors"))
    return flag_in_catalog(wanted, cat)


@register("catalog_flags", _SQL + "select * from f")
def catalog_flags(spark, sf):
    """Title containment + author last name, as an n-gram-blocked exists join."""
    return _flags(spark, sf)


@register("catalog_found_share", _SQL + "select cast(count_if(found) as bigint) found, count(*) total from f")
def catalog_found_share(spark, sf):
    """Found / total."""
    return found_share(_flags(spark, sf))


@register(
    "catalog_heads",
    _SQL + """select * from (select 'found' part, title, author from f where found order by title, author limit 5)
union all select * from (select 'missing', title, author from f where not found order by title, author limit 5)""",
)
def catalog_heads(spark, sf):
    """B7 flag filter and its negation, each with an ordered head (L3)."""
    f = _flags(spark, sf)
    hit = top_n(f.where(F.col("found")).select(F.lit("found").alias("part"), "title", "author"), 5, "title", "author")
    miss = top_n(f.where(~F.col("found")).select(F.lit("missing").alias("part"), "title", "author"), 5,
                 "title", "author")
    return hit.unionByName(miss)
