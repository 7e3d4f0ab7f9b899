"""Registered inference-job queries (K2, G4-G8, B11, U1, U2) on corpus/cast_list."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from charlens.functions.text import py_strip
from charlens.operators import mentions as MN
from charlens.operators import retrieval as R
from charlens.operators.inference import MOCK_VALUES, letter_embed, mock_model, mock_output
from charlens.plans.inference_job import run_inference
from charlens.plans.q_mentions import _BASE, books_and_cast
from charlens.plans.registry import register

ATTRS = ["age", "gender", "spoken_languages"]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(name: str, exc: str) -> str:
    """The prompt for ATTRS, spelt out by hand."""
    tail = """

Answer with a JSON object (null = the excerpts leave it open), keys:
- age: string, a stage: child, teenager, adult, senior
- gender: string
- spoken_languages: list of strings
"""
    wanted = """
Wanted: age and gender and spoken languages

Excerpts:

"""
    return " || ".join([_sql_lit("Character: "), name, _sql_lit(wanted), exc, _sql_lit(tail)])


_EXC_SQL = _BASE + """,
ex AS (select url, character, string_agg(passage, chr(10) || chr(10) || ' ' order by pos) exc, count(*) n
       from pass group by url, character),
cc AS (select c.url, c.character, coalesce(ex.n, 0) mentions_counter, coalesce(ex.exc, '') exc
       from (select distinct url, character from ch where url in (select url from corpus)) c
       left join ex on c.url=ex.url and c.character=ex.character)
"""


def _rows(spark, sf):
    books, chars = books_and_cast(spark, sf)
    m = MN.extract_mentions(books, chars)
    # passages and mention counts come from one aggregation over the mentions
    sel = R.all_passages(m)
    ch = chars.join(books.select("url"), "url", "left_semi").select(
        "url", F.col("name").alias("character")).distinct()
    rows = ch.join(sel, ["url", "character"], "left").select(
        "url", "character",
        F.coalesce("mentions_counter", F.lit(0)).cast("bigint").alias("mentions_counter"),
        F.coalesce("passages", F.array().cast("array<string>")).alias("passages"))
    exc = R.excerpts(F.col("passages"))
    return rows.withColumn("prompt", F.when(py_strip(exc) != "", R.build_prompt(F.col("character"), exc, ATTRS)))


@register(
    "prompts",
    _EXC_SQL + f"""select url, character, mentions_counter,
  case when trim(exc) <> '' then md5({_prompt_sql('character', 'exc')}) end prompt_md5 from cc""",
)
def q_prompts(spark, sf):
    """G5 + B11: the prompt per character; no excerpts -> no prompt."""
    r = _rows(spark, sf)
    return r.select("url", "character", "mentions_counter", F.md5("prompt").alias("prompt_md5"))


_MOCK_SQL = _sql_lit(json.dumps({a: MOCK_VALUES.get(a) for a in ATTRS}, ensure_ascii=False))


@register(
    "mock_outputs",
    _EXC_SQL + f"""select url, character, mentions_counter,
  case when trim(exc) <> '' then {_MOCK_SQL} end output from cc""",
)
def q_mock_outputs(spark, sf):
    """Native mock answer column where a prompt exists."""
    r = _rows(spark, sf)
    return r.select("url", "character", "mentions_counter",
                    F.when(F.col("prompt").isNotNull(), mock_output(ATTRS)).alias("output"))


@register(
    "model_outputs",
    _EXC_SQL + f"""select url book, character, mentions_counter,
  case when trim(exc) <> '' then {_MOCK_SQL} end output,
  case when trim(exc) <> '' then 'ok' else 'skipped' end status,
  md5(exc) excerpts_md5 from cc""",
)
def q_model_outputs(spark, sf):
    """K2 with the all-mentions strategy; the model plug-in (G6/U2) is the mock."""
    books, chars = books_and_cast(spark, sf)
    out = run_inference(spark, books, chars, ATTRS, "all_mentions", mock_model(ATTRS))
    return out.select("book", "character", "mentions_counter", "output", "status",
                      F.md5(R.excerpts(F.col("selected_passages"))).alias("excerpts_md5"))


LETTERS = "aeinorst"
TOP = 3


def _letters_sql(text: str) -> str:
    """How often each of LETTERS occurs, as a DuckDB list."""
    return "[" + ", ".join(f"length({text}) - length(replace({text}, '{x}', ''))" for x in LETTERS) + "]"


_EMBED_SQL = _EXC_SQL + f""",
qs AS (select url, character, attr_no, 'Instruct: ' || {_sql_lit(R.RETRIEVAL_TASK)} || chr(10) || 'Query: ' || what || ' of ' || character q
       from cc, (values (0, 'stage of life'), (1, 'gender'), (2, 'languages understood or used')) t(attr_no, what)),
sc AS (select qs.url, qs.character, attr_no, mention_no, passage,
         list_dot_product({_letters_sql('q')}::double[], {_letters_sql('passage')}::double[]) s
       from qs join pass on qs.url=pass.url and qs.character=pass.character),
tk AS (select *, row_number() over (partition by url, character, attr_no order by s desc, mention_no desc) rk from sc),
sel AS (select url, character, mention_no, any_value(passage) passage, min(attr_no * 1000 + rk) fk from tk where rk <= {TOP}
        group by url, character, mention_no),
se AS (select url, character, count(*) n, string_agg(passage, chr(10) || chr(10) || ' ' order by fk) x from sel group by url, character)
select cc.url book, cc.character, cc.mentions_counter, case when trim(coalesce(x, '')) <> '' then {_MOCK_SQL} end output,
  case when trim(coalesce(x, '')) <> '' then 'ok' else 'skipped' end status, coalesce(n, 0) n_selected, md5(coalesce(x, '')) excerpts_md5
from cc left join se on cc.url=se.url and cc.character=se.character"""


@register("embedding_strategy_outputs", _EMBED_SQL)
def q_embedding_strategy(spark, sf):
    """K2 with the embedding strategy: query texts (G4), embedder plug-in (U1), passages
    chosen per attribute (G2, E2) and united (E3), prompts and model calls (G5, G6)."""
    books, chars = books_and_cast(spark, sf)
    out = run_inference(spark, books, chars, ATTRS, "embedding", mock_model(ATTRS), embed=letter_embed(LETTERS), k=TOP)
    return out.select("book", "character", "mentions_counter", "output", "status",
                      F.size("selected_passages").cast("bigint").alias("n_selected"),
                      F.md5(R.excerpts(F.col("selected_passages"))).alias("excerpts_md5"))
