"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlens.llm import align, ctw, decontam, hilbert, jaccard, langid, quality, credentials, spelling, substring, toolcalls, unigram, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string"))


@query
def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ctw.scored(docs, train=id_crc() % 7 != 2)
    return scored.withColumn("held_out", F.coalesce(id_crc() % 7 == 2, F.lit(False)))


#: arguments of the tools that ``tool_tables`` derives: (tool, argument, kind, required)
TOOL_ARGUMENTS = [
    (tool, argument, kind, required) for tool in ("search", "translate", "count", "setup")
    for argument, kind, required in (("lang", "string", True), ("limit", "integer", True), ("strict", "boolean", False), ("text", "string", True))
]


def tool_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas from all rows of ``conversations``.

    Each turn that is not the assistant's is a call, each of the assistant's turns is
    the result of the turn before.  A call waits for the one at half its turn.  Some
    calls, by a checksum of their text, break the schema or are cut short.  A row
    without a conversation or turn has no call id.
    """
    talk = table(spark, sf_dir, "conversations")
    crc = F.crc32(F.coalesce("text", F.lit("")))
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).cast("string")
    fields = [
        F.concat(F.lit('"text": '), toolcalls.quoted(F.col("text"))),
        F.when(crc % 5 == 0, F.concat(F.lit('"limit": "'), words, F.lit('"'))).otherwise(F.concat(F.lit('"limit": '), words)),
        F.when(crc % 7 != 0, F.lit('"lang": "en"')),
        F.when(crc % 3 == 0, F.lit('"strict": true')),
        F.when(crc % 11 == 0, F.lit('"extra": [1, 2]')),
    ]
    body = F.concat(F.lit("{ "), F.concat_ws(", ", *fields), F.when(crc % 13 == 0, F.lit("")).otherwise(F.lit(" }")))
    tool = (F.when(F.col("role") == "system", "setup").when(crc % 3 == 0, "search").when(crc % 3 == 1, "translate").otherwise("count"))
    mine = F.coalesce(F.col("role") != "assistant", F.lit(True))
    calls = talk.where(mine).select(
        name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), tool.alias("tool"), body.alias("arguments"),
        F.when(F.col("turn") > 0, F.array(name(F.expr("turn div 2")))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = talk.where(~mine).select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOL_ARGUMENTS, "tool string, argument string, kind string, required boolean")
    return calls, results, schemas


@query
def op2_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(*tool_tables(spark, sf_dir)).withColumn("errors", F.array_join("errors", "; "))


@query
def op3_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(F.coalesce(id_crc() % 3 != 1, F.lit(False))))
    held = F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, ("doc_id", held))


@query
def op4_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op5_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(table(spark, sf_dir, "documents"))


@query
def op6_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "cls")


@query
def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), texts=False)
    return found.select(
        "doc_id", "n_words", decontam.hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query
def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=id_crc() % 5 != 0)
    return scored.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query
def op9_hilbert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    return hilbert.sharded(rows, ["lang", "source", "size"], shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op10_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = substring.remove_repeats(table(spark, sf_dir, "documents"), emit="digest")
    return gone.withColumnRenamed("kept", "kept_sha256")


@query
def op11_credential_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.spans(table(spark, sf_dir, "documents"))
    base = credentials.base_of(F.col("spans"))
    return found.select(
        "doc_id", *[credentials.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in credentials.BASE_KINDS],
        F.sha2(credentials.named(base), 256).alias("base_sha256"), credentials.named(F.col("spans")).alias("spans"))


@query
def op12_spilled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"))


@query
def op13_letter_count_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.words(table(spark, sf_dir, "documents"), damaged=spelling.lost_letter)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE["op4_vantage_points"] = """
with good as (
  select vec_id, embedding::double[] v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v) score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from pairs qualify rank <= 20"""

ORACLE["op7_benchmark_windows"] = rf"""
with word as (select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' re),
items as (
  select distinct coalesce(item_id::varchar, '') item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, (select re from word)) w from benchmark),
sized as (select item, w, least(10, len(w)) k from items where len(w) > 0),
grams as (select distinct item, k, w[i:i + k - 1] g from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from sized)),
docs as (
  select doc_id, row_number() over () r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, (select re from word)) w from documents),
spots as (select r, k, i, w[i:i + k - 1] g from (
  select r, w, k, unnest(range(1, len(w) - k + 2)) i from docs, (select distinct k from grams) where len(w) >= k)),
hits as (select s.r, s.i, s.k, g.item from spots s join grams g on s.k = g.k and s.g = g.g),
words as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + k)) p from hits) group by r),
named as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join words using (r) left join named using (r)"""

ORACLE["op10_block_anchors"] = rf"""
with docs as (select doc_id, row_number() over () r, {_SPACED.format("coalesce(text, '')")} w from documents where doc_id is not null),
spots as (select doc_id, r, i, w[i:i + 12] g from (select doc_id, r, w, unnest(range(1, len(w) - 11)) i from docs)),
least_id as (select g, min(doc_id) m from spots group by g),
gone as (select distinct r, unnest(range(i, i + 13)) p from spots join least_id using (g) where m < doc_id),
lost as (select r, count(*) n, list(p) ps from gone group by r)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: not coalesce(list_contains(ps, i), false)), ' ')) kept_sha256
from docs left join lost using (r)"""


def _places(kind: str, pattern: str, group: int) -> str:
    """SQL of (r, kind, s, e, m): code point intervals of all matches of ``pattern``."""
    quoted = pattern.replace("'", "''")
    return f"""
  select r, {kind} kind, e - n s, e, n, m from (
    select r, m, length(m) n, sum(gap + length(m)) over (partition by r order by i) e from (
      select r, unnest(range(1, len(ms) + 1)) i, unnest(ms) m, unnest(list_transform(gs[:len(ms)], lambda g: length(g))) gap from (
        select r, regexp_extract_all(t, '{quoted}') ms, string_split_regex(t, '{quoted}') gs from docs)))"""


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in credentials.KINDS) + "]"
ORACLE["op11_credential_parts"] = f"""
with docs as (select doc_id, row_number() over () r, coalesce(text, '') t from documents),
every as ({_places("'assign'", credentials.ASSIGN, 0)} union all {_places("'access'", credentials.ACCESS, 1)} union all {_places("'hex'", credentials.HEX, 2)}
  union all {_places("'named'", credentials.NAMED, 3)} union all {_places("'loose'", credentials.LOOSE, 4)}),
parts as (
  select r, s, e, case when kind = 'loose' then case when contains(m, '://') then 'endpoint' when contains(m, '@') then 'mail' else 'run' end
    when kind = 'named' then case when regexp_full_match(regexp_extract(m, {_sql_text(credentials.NAMED)}, 1), {_sql_text(credentials._LOGIN)}) then 'login'
      when regexp_full_match(regexp_extract(m, {_sql_text(credentials.NAMED)}, 1), {_sql_text(credentials._PHRASE)}) then 'phrase' else 'endpoint' end else kind end kind
  from every where kind not in ('assign', 'named')
    or (kind = 'assign' and length(regexp_extract(m, {_sql_text(credentials.ASSIGN)}, 2)) >= 6)
    or (kind = 'named' and length(regexp_extract(m, {_sql_text(credentials.NAMED)}, 2)) >= 4)),
near as (
  select w.r, w.kind, w.s, w.e, p.kind k, greatest(w.s, p.s) - least(w.e, p.e) gap from parts w join parts p on w.r = p.r
  where w.kind not in ('assign', 'access', 'hex') and greatest(w.s, p.s) - least(w.e, p.e) <= {credentials.REACH} and not (w.kind = p.kind and w.s = p.s)),
flags as (
  select r, kind, s, e, bool_or(gap < 0 and k in ('assign', 'access', 'hex')) same, bool_or(gap >= 0 and k = 'access') base_id,
    bool_or(gap >= 0 and k in ('assign', 'hex')) base_secret, bool_or(gap >= 0 and k in ('access', 'login', 'mail')) any_id,
    bool_or(gap >= 0 and k in ('assign', 'hex', 'phrase', 'run')) any_secret, bool_or(gap >= 0 and k = 'endpoint') place
  from near group by all),
weak as (
  select distinct r, kind, s, e from flags where not same and case when kind in ('login', 'mail') then base_secret or (any_secret and place)
    when kind in ('phrase', 'run') then base_id or (any_id and place) else any_id and any_secret end),
spans as (
  select r, kind, s, concat_ws(':', kind, s, e) span, list_position({_KIND_LIST}, kind) place, kind in ('assign', 'access', 'hex') base
  from (select r, kind, s, e from parts where kind in ('assign', 'access', 'hex') union all select * from weak)),
told as (
  select r, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    string_agg(span, ',' order by s, place) filter (base) base, string_agg(span, ',' order by s, place) spans from spans group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from docs left join told using (r)"""

#: crc32 of a text as an exclusive or over its bytes: each byte's share depends on its value and its distance from the end
ORACLE["op13_letter_count_trees"] = rf"""
with recursive docs as (select coalesce(doc_id::varchar, '') id, text from documents),
runs as (
  select id, {_LOWER.format("run")} run, count(*) times from (
    select id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) run from docs) group by all),
asked as (select *, id || ':' || run msg, row_number() over () r from runs),
bytes as (
  select r, length(hx) // 2 n, unnest(range(length(hx) // 2)) i, hx from (select r, hex(encode(msg)) hx from asked)),
byte as (select r, n - 1 - i back, ('0x' || hx[2 * i + 1:2 * i + 2])::bigint b from bytes),
step(b, k, c) as (
  select range, 0, range from range(256)
  union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
one as (select b, c from step where k = 8),
share(back, b, c) as (
  select 0, b, c from one
  union all select s.back + 1, s.b, xor(s.c >> 8, o.c) from share s join one o on o.b = s.c & 255
  where s.back < (select max(back) from byte)),
start(n, c) as (
  select 0, 4294967295::bigint
  union all select n + 1, xor(s.c >> 8, o.c) from start s join one o on o.b = s.c & 255 where n <= (select max(back) from byte)),
crc as (
  select r, xor(xor(x, s.c), 4294967295) h from (
    select r, max(back) + 1 n, bit_xor(c) x from byte join share using (back, b) group by r) join start s using (n)),
counted as (
  select word, sum(times)::bigint n from (
    select times, case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word from asked join crc using (r))
  where length(word) >= {spelling.LEAST_LENGTH} group by word having sum(times) >= {spelling.LEAST_COUNT}),
holes as (select word, n, unnest(range(1, length(word) + 1)) i from counted),
cut as (select word, n, i, word[:i - 1] front, word[i + 1:] back from holes),
near as (
  select a.word, b.word near, b.n near_n from cut a join cut b on a.i = b.i and a.front = b.front and a.back = b.back and a.word <> b.word
  union select a.word, b.word, b.n from cut a join counted b on b.word = a.front || a.back
  union select b.word, a.word, a.n from cut a join counted b on b.word = a.front || a.back),
best as (select word, count(*) n_near, arg_min(near, (-near_n, near)) near, max(near_n) near_n from near group by word),
forms as (
  select c.word, c.n, coalesce(n_near, 0) n_near, case when near_n >= 2 * n then near end form, case when near_n >= 2 * n then near_n end form_n
  from counted c left join best using (word)),
climb(word, goal, depth) as (
  select word, word, 0 from forms union all select word, form, depth + 1 from climb join (select word goal, form from forms where form is not null) using (goal))
select f.word, form, root, n, n_near, form_n from forms f join (select word, arg_max(goal, depth) root from climb group by word) using (word)"""
