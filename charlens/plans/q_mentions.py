"""Registered mention queries (G1, C12, C13, E4, G3, G8, S1, S2, B3) on corpus/cast_list."""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.functions.text import WS_CLASS
from charlens.operators import mentions as MN
from charlens.plans.registry import register
from charlens.session import scratch_path
from charlens.sources import io
from charlens.sources.fixtures import table, view, with_clause

WINDOW = 200


def books_and_cast(spark, sf):
    books = view(spark, sf, "corpus").select("url", "text")
    cast = view(spark, sf, "cast_list")
    chars = cast.select("url", "name", MN.normalize_aliases(cast, "aliases", r"\|").alias("aliases"))
    return books, chars


def mentions_df(spark, sf, window=WINDOW):
    books, chars = books_and_cast(spark, sf)
    return MN.extract_mentions(books, chars, window)


# ---- DuckDB twin (token sequences of at most two tokens, as in cast_list) -------
W = WS_CLASS


def _strip(x):
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _split(x):
    return f"case when {_strip(x)}='' then []::varchar[] else string_split_regex({_strip(x)}, '{W}+') end"


_BASE = with_clause("corpus", "cast_list") + f""",
ch AS (select url, name character, list_prepend(name, list_filter(list_transform(string_split(aliases, '|'),
        lambda a: {_strip('a')}), lambda a: a <> '')) names from cast_list),
al0 AS (select url, character, unnest(names) alias, unnest(range(len(names))) alias_no from ch),
al AS (select url, character, alias_no, toks, len(toks) alias_len from (
   select url, character, alias_no, {_split('strip_accents(lower(alias))')} toks from al0
   where alias is not null and {_strip('alias')} <> '') x where len(toks) > 0),
bk AS (select url, {_split('text')} tokens from corpus where url in (select url from al)),
ps AS (select url, pos, tok, lead(tok, 1) over (partition by url order by pos) nxt from (
   select url, unnest(list_transform(tokens, lambda t: strip_accents(lower(t)))) tok,
          unnest(range(len(tokens))) pos from bk) y),
cand AS (select ps.url, al.character, ps.pos, al.alias_no, al.alias_len from ps join al
   on ps.url=al.url and ps.tok=al.toks[1]
   where al.alias_len=1 or (al.alias_len=2 and ps.nxt=al.toks[2])),
best AS (select url, character, pos, arg_min(alias_len, alias_no) l from cand group by url, character, pos),
fl AS (select *, case when lag(pos) over w = pos-1 and lag(l) over w = 2 then 0 else 1 end st from best
   window w as (partition by url, character order by pos)),
cl AS (select *, sum(st) over (partition by url, character order by pos rows unbounded preceding) cid from fl),
m AS (select url, character, pos, l from (
   select *, row_number() over (partition by url, character, cid order by pos) - 1 off from cl) z where off%2=0),
pass AS (select m.url, m.character, m.pos, m.l len,
   row_number() over (partition by m.url, m.character order by m.pos) - 1 mention_no,
   least(len(b.tokens), m.pos+m.l+{WINDOW // 2}) - greatest(m.pos-{WINDOW // 2}, 0) passage_tokens,
   array_to_string(b.tokens[greatest(m.pos-{WINDOW // 2},0)+1 : least(len(b.tokens), m.pos+m.l+{WINDOW // 2})], ' ') passage
   from m join bk b on m.url=b.url)
"""


@register(
    "mentions",
    _BASE + "select url, character, mention_no, pos, len, passage_tokens, md5(passage) passage_md5 from pass",
)
def q_mentions(spark, sf):
    return _mentions_out(mentions_df(spark, sf))


def _mentions_out(m):
    return m.select(
        "url", "character", F.col("mention_no").cast("bigint").alias("mention_no"),
        F.col("pos").cast("bigint").alias("pos"), F.col("len").cast("bigint").alias("len"),
        # tokens of a passage are joined by one blank
        (F.length("passage") - F.length(F.replace("passage", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("passage_tokens"),
        F.md5("passage").alias("passage_md5"),
    )


@register(
    "mention_candidates",
    _BASE + "select url, character, pos, alias_no, alias_len from cand",
)
def q_mention_candidates(spark, sf):
    books, chars = books_and_cast(spark, sf)
    c = MN.candidates(books, MN.alias_table(chars))
    return c.select("url", "character", F.col("pos").cast("bigint").alias("pos"),
                    F.col("alias_no").cast("bigint").alias("alias_no"),
                    F.col("alias_len").cast("bigint").alias("alias_len"))


@register(
    "mention_counts",
    _BASE + """select c.url, c.character, coalesce(n, 0) mentions_counter
 from (select distinct url, character from ch) c
 left join (select url, character, count(*) n from m group by url, character) k
 on c.url=k.url and c.character=k.character""",
)
def q_mention_counts(spark, sf):
    books, chars = books_and_cast(spark, sf)
    m = MN.extract_mentions(books, chars, WINDOW)
    return MN.mention_counts(chars, m)


@register(
    "all_passages",
    _BASE + """select url, character, count(*) n_passages,
  md5(string_agg(passage, chr(10) || chr(10) || ' ' order by pos)) excerpts_md5 from pass group by url, character""",
)
def q_all_passages(spark, sf):
    """Every mention passage in text order, joined as the model excerpt."""
    from charlens.operators.retrieval import all_passages

    m = mentions_df(spark, sf)
    ap = all_passages(m)
    return ap.select("url", "character", F.size("passages").cast("bigint").alias("n_passages"),
                     F.md5(F.array_join("passages", "\n\n ")).alias("excerpts_md5"))


#: sources as books: all texts of a source, one after the other, and one cast for all of them
SOURCE_CAST = {"the": ["of the", "and"], "un": ["and the", "la"], "de la": ["la"]}
_SOURCE_NAMES = ", ".join(f"('{name}', ['" + "', '".join([name, *aliases]) + "'])" for name, aliases in SOURCE_CAST.items())
_SHELF = _BASE.replace(with_clause("corpus", "cast_list"), f"""with corpus AS (
   select 'source/' || source url, string_agg(text, chr(10) order by doc_id) "text" from documents where text is not null group by source)
""").replace("ch AS (select url, name character, list_prepend(name, list_filter(list_transform(string_split(aliases, '|'),\n        "
             f"lambda a: {_strip('a')}), lambda a: a <> '')) names from cast_list)",
             f"ch AS (select url, n.character, n.names from corpus, (values {_SOURCE_NAMES}) n(character, names))")


@register(
    "book_file_mentions",
    _SHELF + "select url, character, mention_no, pos, len, passage_tokens, md5(passage) passage_md5 from pass",
)
def q_book_file_mentions(spark, sf):
    """A6 + G1 on large books: each source is a book of several text files, read in
    chunks by byte range and dealt to blocks, so that no book is one cell or one task."""
    docs = table(spark, sf, "documents").where("text is not null")
    path = scratch_path(spark, "shelf")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the texts of a source in order over the files of its folder
    docs.repartitionByRange(n, "source", "doc_id").sortWithinPartitions("source", "doc_id").select(
        "source", "text").write.partitionBy("source").option("compression", "none").text(path)
    books = io.read_book_chunks(spark, path, F.concat(F.lit("source/"), F.col("source")))
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, aliases)).alias("aliases")) for name, aliases in SOURCE_CAST.items()])
    cast = docs.select(F.concat(F.lit("source/"), "source").alias("url")).distinct().select("url", F.inline(names))
    return _mentions_out(MN.extract_mentions(books, cast, WINDOW))


@register(
    "token_stats",
    with_clause("corpus") + f"""select url, len(toks) n_tokens,
  len(list_filter(toks, lambda t: strip_accents(lower(t)) <> lower(t))) n_accented
 from (select url, {_split('text')} toks from corpus) x""",
)
def q_token_stats(spark, sf):
    """S1 + S2 per book: token count and tokens changed by accent folding."""
    from charlens.functions.text import folded_tokens, tokens

    b = view(spark, sf, "corpus").select("url", tokens(F.col("text")).alias("t"), folded_tokens(F.col("text")).alias("f"))
    changed = F.aggregate(
        F.zip_with("t", "f", lambda a, b: F.when(F.lower(a) != b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x
    )
    return b.select("url", F.size("t").cast("bigint").alias("n_tokens"),
                    changed.cast("bigint").alias("n_accented"))

