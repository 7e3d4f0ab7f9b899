"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.operators import graph as G
from charlens.operators.relational import dedup_first, top_n
from charlens.plans.dataset_job import build_dataset
from charlens.plans.registry import register
from charlens.session import checkpoint_root, scratch_path
from charlens.sources import io
from charlens.sources.fixtures import VIEWS, view, with_clause

GENRE = "1-URGENT"
CUTOFF = "1999-01-01"
WIDE_COLUMNS = ["brand label", "kind label", "alias"]


def _st(spark, sf):
    return view(spark, sf, "triples"), view(spark, sf, "graph_labels")


def _books(spark, sf, has_id=True):
    st, lb = _st(spark, sf)
    return G.match_books(st, lb, CUTOFF, GENRE, has_catalog_id=has_id)


_TAIL = "string_split({x}, '/')[-1]"

_GRAPH = with_clause("triples", "graph_labels") + f""",
lt AS (select id, min(label) label from graph_labels where lang='en' group by id),
gb AS (select s book from triples where p='genre' and o='{GENRE}'),
gd AS (select s book, o date from triples where p='date' and cast(o as date) < date '{CUTOFF}'),
ga AS (select s book, o author from triples where p='author'),
gj AS (select gb.book, gd.date, ga.author from gb join gd on gb.book=gd.book join ga on gb.book=ga.book
       where gb.book in (select s from triples where p='character')),
bw AS (select distinct gj.book, coalesce(l1.label, {_TAIL.format(x='gj.book')}) title,
         coalesce(l2.label, {_TAIL.format(x='gj.author')}) author, gj.date
       from gj left join lt l1 on l1.id=gj.book left join lt l2 on l2.id=gj.author
       where gj.book in (select s from triples where p='catalog_id')),
bn AS (select distinct gj.book, coalesce(l1.label, {_TAIL.format(x='gj.book')}) title,
         coalesce(l2.label, {_TAIL.format(x='gj.author')}) author, gj.date
       from gj left join lt l1 on l1.id=gj.book left join lt l2 on l2.id=gj.author
       where gj.book not in (select s from triples where p='catalog_id')),
bc AS (select coalesce(l.label, {_TAIL.format(x='t.o')}) character_name, t.o character_uri, bw.title book_title,
         bw.author book_author from bw join triples t on t.s=bw.book and t.p='character'
       left join lt l on l.id=t.o),
pf AS (select {_TAIL.format(x='t.p')} property_id, count(*) count from bc join triples t on t.s=bc.character_uri
       group by {_TAIL.format(x='t.p')})
"""


@register("books_with_id", _GRAPH + "select * from bw")
def books_with_id(spark, sf):
    """C1 + C2 (exists catalogue id) + B4 + C4 labels + G0c distinct."""
    return _books(spark, sf, True)


@register("books_without_id", _GRAPH + "select * from bn")
def books_without_id(spark, sf):
    """C1 + C3 (not exists catalogue id)."""
    return _books(spark, sf, False)


@register(
    "books_with_id_first",
    _GRAPH + "select * from bw order by book, title, author, date limit 1500",
)
def books_with_id_first(spark, sf):
    """L2: the source query's row limit, with a deterministic order."""
    return top_n(_books(spark, sf, True), 1500, "book", "title", "author", "date")


@register("book_characters", _GRAPH + "select * from bc")
def book_characters(spark, sf):
    """Book -> characters with labels."""
    st, lb = _st(spark, sf)
    return G.characters_of(_books(spark, sf, True), st, lb)


@register(
    "property_frequency",
    _GRAPH + """select pf.property_id, pf.count, l.label from pf left join lt l on l.id=pf.property_id""",
)
def property_frequency(spark, sf):
    """D1 + C6: statements per property over the characters."""
    st, lb = _st(spark, sf)
    ch = G.characters_of(_books(spark, sf, True), st, lb)
    return G.property_frequency(ch, st, lb)


@register(
    "property_top",
    _GRAPH + """select pf.property_id, pf.count from pf order by count desc, property_id limit 5""",
)
def property_top(spark, sf):
    """L1 + L3: the most frequent properties (ties by id)."""
    st, lb = _st(spark, sf)
    ch = G.characters_of(_books(spark, sf, True), st, lb)
    pf = G.property_frequency(ch, st, lb)
    return top_n(pf.select("property_id", "count"), 5, F.col("count").desc(), F.col("property_id"))


_FOLD = _GRAPH + f""",
subj AS (select distinct character_uri s from bc),
vals AS (select t.s, coalesce(lp.label, {_TAIL.format(x='t.p')}) prop,
   case when t.o like 'char/%' or t.o like 'person/%' or t.o like 'book/%'
        then coalesce(lo.label, {_TAIL.format(x='t.o')}) else t.o end v, t.o ord
   from triples t join subj on t.s=subj.s left join lt lp on lp.id=t.p left join lt lo on lo.id=t.o),
fv AS (select s, prop, list(v order by ord) vs from (select s, prop, v, min(ord) ord from vals group by s, prop, v) x
       group by s, prop)
"""


def _docs(spark, sf):
    st, lb = _st(spark, sf)
    ch = G.characters_of(_books(spark, sf, True), st, lb)
    return G.fold_attributes(st, lb, ch, entity_prefixes=["char/", "person/", "book/"])


@register(
    "character_attributes",
    _FOLD + "select s, prop, array_to_string(vs, ' | ') vals, len(vs) n_values from fv",
)
def character_attributes(spark, sf):
    """D3: per character and property label the deduplicated values in
    first-seen order (long form of the attribute map)."""
    d = _docs(spark, sf).select("s", F.explode("attributes").alias("prop", "values"))
    return d.select("s", "prop", F.array_join(F.transform("values", lambda v: v["text"]), " | ").alias("vals"),
                    F.size("values").cast("bigint").alias("n_values"))


@register(
    "attribute_coverage",
    _FOLD + "select prop attribute, count(distinct s) count from fv group by prop",
)
def attribute_coverage(spark, sf):
    """Characters having each attribute."""
    return G.attribute_coverage(_docs(spark, sf))


@register(
    "basic_info",
    _GRAPH + """, subj AS (select distinct character_uri s from bc)
select subj.s, array_to_string(coalesce(a.al, []::varchar[]), ' | ') also_known_as, d.description
from subj left join (select s, list_sort(list(distinct o)) al from triples where p='alias' group by s) a on a.s=subj.s
left join (select s, min(o) description from triples where p='kind' group by s) d on d.s=subj.s""",
)
def basic_info(spark, sf):
    """Sorted alias set and first description (the 'kind' statement plays
    the description here)."""
    st, lb = _st(spark, sf)
    ch = G.characters_of(_books(spark, sf, True), st, lb)
    subj = ch.select(F.col("character_uri").alias("s")).distinct()
    bi = G.basic_info(st.join(subj, "s", "left_semi"), alias_p="alias", desc_p="kind")
    out = subj.join(bi, "s", "left")
    return out.select("s", F.array_join(F.coalesce("also_known_as", F.array().cast("array<string>")), " | ")
                      .alias("also_known_as"), "description")


@register(
    "characters_wide",
    _FOLD + """select s,
  max(case when prop='brand label' then array_to_string(vs, ', ') end) attr_brand_label,
  max(case when prop='kind label' then array_to_string(vs, ', ') end) attr_kind_label,
  max(case when prop='alias' then array_to_string(vs, ', ') end) attr_alias
from fv group by s""",
)
def characters_wide(spark, sf):
    """One row per character, one column per listed attribute label."""
    w = G.flatten_characters(_docs(spark, sf), WIDE_COLUMNS)
    return w.select("s", *[F.col(f"`attr_{c}`").alias("attr_" + c.replace(" ", "_")) for c in WIDE_COLUMNS])


_K1 = (_GRAPH + f""",
bk AS (select * from book_catalog),
bnd AS (select title, author, first(book order by book) book from bn group by title, author),
want AS (select bnd.*, lower(trim(title)) t,
   coalesce(lower(list_last(string_split_regex(trim(author), '\\s+'))), '') ln from bnd),
fnd AS (select * from want w where t is not null and exists (select 1 from bk c
   where contains(lower(trim(c.title)), w.t) and contains(lower(c.author), w.ln))),
bc2 AS (select coalesce(l.label, {_TAIL.format(x='t.o')}) character_name, t.o character_uri, fnd.title book_title,
         fnd.author book_author from fnd join triples t on t.s=fnd.book and t.p='character'
       left join lt l on l.id=t.o),
allc AS (select 0 br, * from bc2 union all select 1 br, * from bc),
dc AS (select character_name, character_uri,
   first(book_title order by br, book_title, book_author) book_title,
   first(book_author order by br, book_title, book_author) book_author
   from allc group by character_name, character_uri)
""").replace("WITH ", "WITH book_catalog AS (" + VIEWS["book_catalog"] + "),\n", 1)


@register("dataset_characters", _K1 + "select * from dc")
def dataset_characters(spark, sf):
    """K1 characters: with-id branch (C1/C2, not deduplicated) united with the
    without-id branch (C3 -> E1 on (title, author) -> C7 catalogue match ->
    B7 found) -> C5, then E1 keep-first on (name, uri)."""
    st, lb = _st(spark, sf)
    cat = view(spark, sf, "book_catalog").select("title", F.array("author").alias("authors"))
    chars, _ = build_dataset(st, lb, cat, CUTOFF, GENRE, wide_columns=None)
    return chars


@register("dataset_found_books", _K1 + "select title, author, book from fnd")
def dataset_found_books(spark, sf):
    """C3 -> E1 -> C7 -> B7: books without catalogue id found in the catalogue."""
    from charlens.operators.catalog import flag_in_catalog

    checkpoint_root(spark)
    st, lb = _st(spark, sf)
    cat = view(spark, sf, "book_catalog").select("title", F.array("author").alias("authors"))
    bn = dedup_first(G.match_books(st, lb, CUTOFF, GENRE, has_catalog_id=False).select("title", "author", "book"),
                     ["title", "author"], ["book"]).checkpoint()  # read twice by the match
    return flag_in_catalog(bn, cat).where(F.col("found")).select("title", "author", "book")





@register(
    "dataset_wide",
    _K1 + f""",
subj AS (select distinct character_uri s from dc),
vals AS (select t.s, coalesce(lp.label, {_TAIL.format(x='t.p')}) prop,
   case when t.o like 'char/%' or t.o like 'person/%' or t.o like 'book/%'
        then coalesce(lo.label, {_TAIL.format(x='t.o')}) else t.o end v, t.o ord
   from triples t join subj on t.s=subj.s left join lt lp on lp.id=t.p left join lt lo on lo.id=t.o),
fv AS (select s, prop, list(v order by ord) vs from (select s, prop, v, min(ord) ord from vals group by s, prop, v) x
       group by s, prop),
wide AS (select s,
  max(case when prop='brand label' then array_to_string(vs, ', ') end) attr_brand_label,
  max(case when prop='kind label' then array_to_string(vs, ', ') end) attr_kind_label,
  max(case when prop='alias' then array_to_string(vs, ', ') end) attr_alias
  from fv group by s)
select dc.character_name, dc.character_uri, dc.book_title, dc.book_author,
  array_to_string(coalesce(a.al, []::varchar[]), ', ') also_known_as, d.description,
  w.attr_brand_label, w.attr_kind_label, w.attr_alias
from dc left join (select s, list_sort(list(distinct o)) al from triples where p='alias' group by s) a on a.s=dc.character_uri
left join (select s, min(o) description from triples where p='kind' group by s) d on d.s=dc.character_uri
left join wide w on w.s=dc.character_uri""",
)
def dataset_wide(spark, sf):
    """K1 end to end: characters -> D3 fold + D4 basic info -> D5 wide table."""
    st, lb = _st(spark, sf)
    cat = view(spark, sf, "book_catalog").select("title", F.array("author").alias("authors"))
    _, wide = build_dataset(st, lb, cat, CUTOFF, GENRE, wide_columns=WIDE_COLUMNS, desc_p="kind")
    return wide.select(
        "character_name", "character_uri", "book_title", "book_author", "also_known_as", "description",
        *[F.col(f"`attr_{c}`").alias("attr_" + c.replace(" ", "_")) for c in WIDE_COLUMNS])


_FACTS = with_clause("person_facts") + """,
v AS (select s, p, o, min(lang) lang from person_facts group by s, p, o)
"""


@register(
    "native_names",
    _FACTS + """select s,
  string_agg(o, ', ' order by o) filter (where p='native_name') attr_native_name,
  case when count(*) filter (where p='native_name') = 1 then max(lang) filter (where p='native_name') end native_language_from_name,
  string_agg(o, ', ' order by o) filter (where p='motto') attr_motto
from v group by s""",
)
def native_names(spark, sf):
    """D3 + D5: the native name keeps its language and gives two columns; a text
    that another property holds in two languages is one value."""
    st = view(spark, sf, "person_facts")
    no_labels = view(spark, sf, "graph_labels").where(F.lit(False))
    docs = G.fold_attributes(st, no_labels, text_lang_col="lang", lang_props=["native_name"])
    return G.flatten_characters(docs, ["native_name", "motto"], native_name_label="native_name")


@register(
    "statement_dump",
    with_clause("triples") + """select t.p property_id, count(*) count, cast(null as varchar) label from triples t
where t.p like 'a%' and t.s in (select o from triples where p='character') group by t.p""",
)
def statement_dump(spark, sf):
    """A5 + B5: statements written as a dump partitioned by property, read back; the
    property prefix prunes folders."""
    path = scratch_path(spark, "statements")
    io.write_statements(view(spark, sf, "triples"), path)
    st = io.read_statements(spark, path)
    chars = st.where("p = 'character'").select(F.col("o").alias("character_uri")).distinct()
    no_labels = view(spark, sf, "graph_labels").where(F.lit(False))
    return G.property_frequency(chars, st, no_labels, prefix="a")
