"""Registered queries that go through files: the whole evaluation job from gold and
prediction files (K3, A1, A2, A8, B1, B14), appended runs and reports (A9-A11), the
catalogue as CSV (A3), and list and value texts (S7-S9, S12, D17).

Each writes data derived from the given tables to a fresh folder under the shared
checkpoint folder and reads it back through the library's sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from charlens.functions.text import instruct_text, parse_list_literal, split_comma_blank, split_list
from charlens.operators import metrics as M
from charlens.operators.catalog import flag_in_catalog
from charlens.operators.inference import letter_embed, letter_token_embed
from charlens.plans.evaluation_job import evaluate_files, report_with_run
from charlens.plans.q_catalog import _SQL as _CATALOG_SQL
from charlens.plans.registry import register, rounded
from charlens.plans.sql_oracle import report_sql
from charlens.session import scratch_path
from charlens.sources import io
from charlens.sources.fixtures import table, view, with_clause
from charlens.sources.json_arrays import read_json_array, write_json_arrays
from charlens.streaming.jobs import file_stream, stream_predictions

ATTRS = {"lang": "closed", "age": "ordinal", "tags": "set", "occupation": "open", "type": "type"}
TASKS = {"occupation": "Name the trades.", "type": "Name the species."}
LETTERS = "aeinorst"


def _files(spark, sf):
    """Gold JSON Lines and a predictions CSV from the given documents."""
    gold = view(spark, sf, "file_gold").select(
        "name", F.array("name").alias("aliases"),
        F.struct(F.col("url").alias("gutenberg_url"), F.col("name").alias("book_title")).alias("book"),
        F.struct("lang", "age", F.when(F.col("tag1").isNotNull(), F.array("tag1", "tag2")).alias("tags"),
                 F.concat("occupation", F.lit(", baker")).alias("occupation"), F.col("kind").alias("type")).alias("attributes"))
    gold_path = scratch_path(spark, "gold-jsonl")
    io.write_json(gold, gold_path)
    pred = view(spark, sf, "file_pred").select(
        F.col("url").alias("Book"), F.col("name").alias("Character"), F.col("output").alias("Output"),
        F.lit(1).cast("bigint").alias("Mentions_counter"), F.array("name").alias("Selected_passages"))
    pred_path = scratch_path(spark, "pred-csv")
    io.write_csv(pred, pred_path, sep=";")
    return gold_path, pred_path


def _letters_sql(text: str, plus: str = "0") -> str:
    return "[" + ", ".join(f"({plus} + length({text}) - length(replace({text}, '{x}', '')))::double" for x in LETTERS) + "]"


def _cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _text_sql(task: str, value: str) -> str:
    return f"('Instruct: {task}' || chr(10) || 'Query: ' || coalesce({value}, ''))"


# predicted values by output form (file_pred), derived by hand: forms 3 and 4 give nothing
_JOINED = with_clause("file_gold", "file_pred") + f""",
a AS (select g.name, g.url, lower(g.lang) lg, lower(case form when 0 then g.lang when 1 then 'EN' when 5 then g.lang end) lp,
   age ag, case form when 0 then 'adult' when 1 then 'teenager' when 2 then 'Senior ' when 5 then 'child' end ap,
   case when tag1 is not null then [tag1, tag2] end tg,
   case form when 0 then [d.source, 'x'] when 1 then [d.source] when 2 then ['a', 'b'] when 5 then [d.lang, d.source] end tp,
   occupation || ', baker' og,
   case form when 0 then d.lang || ', baker' when 1 then d.source when 5 then d.lang end op,
   kind yg, coalesce(lower(kind) = 'human', false) hg,
   case form when 0 then true when 1 then false when 2 then false when 5 then true end hp,
   case form when 0 then '' when 1 then d.source when 2 then 'spirit' when 5 then '' end yp
  from file_gold g join file_pred p on g.name=p.name and g.url=p.url join documents d on 'doc/' || d.doc_id = g.url),
w AS (select i, j, wg, wp from (values ('child',0),('teenager',1),('adult',2),('senior',3)) x(wg,i),
  (values ('child',0),('teenager',1),('adult',2),('senior',3)) y(wp,j)),
b AS (select a.*, case when lg is not null and lp is not null then (lg=lp)::int::double end s_lang,
   case when ag is not null and ap is not null then (lower(ag)=lower(ap))::int::double end s_age,
   case when ag is not null and ap is not null then case abs(i-j) when 0 then 1.0 when 1 then 0.8 else 0.0 end::double end s_soft,
   len(list_distinct(coalesce(tg, []))) ng, len(list_distinct(coalesce(tp, []))) np,
   len(list_filter(list_distinct(coalesce(tg, [])), lambda x: list_contains(coalesce(tp, []), x))) ntp,
   (hg = hp)::int::double s_human, not hg and coalesce(not hp, false) nonhuman
  from a left join w on lower(trim(ag))=wg and lower(trim(ap))=wp),
e AS (select *, {_letters_sql(_text_sql(TASKS["occupation"], "og"))} og_v, {_letters_sql(_text_sql(TASKS["occupation"], "op"))} op_v,
   {_letters_sql(_text_sql(TASKS["type"], "yg"))} yg_v, {_letters_sql(_text_sql(TASKS["type"], "yp"))} yp_v,
   list_transform(string_split(og, ' '), lambda t: {_letters_sql("t", "1")}) og_t,
   list_transform(string_split(op, ' '), lambda t: {_letters_sql("t", "1")}) op_t from b),
k AS (select *, case when og is not null and op is not null then {_cos_sql("og_v", "op_v")} else 0.0 end c_occ,
   case when nonhuman then case when yg is not null and yp is not null then {_cos_sql("yg_v", "yp_v")} else 0.0 end end c_type,
   case when og is not null and op is not null then list_avg(list_transform(op_t, lambda p: list_max(list_transform(og_t, lambda g: {_cos_sql("g", "p")})))) end tpr,
   case when og is not null and op is not null then list_avg(list_transform(og_t, lambda g: list_max(list_transform(op_t, lambda p: {_cos_sql("g", "p")})))) end trc
  from e),
s AS (select *, 2 * tpr * trc / (tpr + trc) t_occ, case when ng > 0 then 2.0 * ntp / (ng + np) end s_tags from k)
"""


def _evaluate(spark, sf):
    gold_path, pred_path = _files(spark, sf)
    return evaluate_files(spark, gold_path, pred_path, ATTRS, datatype="raw", embed=letter_embed(LETTERS),
                          token_embed=letter_token_embed(LETTERS), tasks=TASKS)


@register(
    "eval_files_scores",
    _JOINED + """select name, url, round(s_lang, 6) score_lang, round(s_age, 6) score_age, round(s_soft, 6) soft_score_age,
 round(s_tags, 6)::double score_tags, round(c_occ, 6) cos_sim_occupation, round(t_occ, 6) token_f1_occupation,
 round(s_human, 6) score_is_human, round(c_type, 6) cos_sim_type from s""",
)
def eval_files_scores(spark, sf):
    """K3 from files, all five kinds: one score row per entity."""
    return rounded(_evaluate(spark, sf)[1])


_REPORTS = ", ".join(
    f"{name} AS (with " + report_sql(f"select {g} g, {p} p from s", "select * from report_rows") + ")"
    for name, g, p in (("r_lang", "lg", "lp"), ("r_age", "lower(ag)", "lower(ap)"),
                       ("r_type", "hg::varchar", "hp::varchar")))


@register(
    "eval_files_report",
    _JOINED + ", " + _REPORTS + """, cells AS (
 select 'lang' attribute, unnest(['precision','recall','f1']) metric, label, unnest(["precision",recall,f1]) v, support n from r_lang
 union all select 'age', unnest(['precision','recall','f1']), label, unnest(["precision",recall,f1]), support from r_age
 union all select 'type', unnest(['is_human_precision','is_human_recall','is_human_f1']), label, unnest(["precision",recall,f1]), support from r_type
 union all select unnest(['lang','age','tags','occupation','type']), 'gold_count', null,
   unnest([count(lg), count(ag), count(tg), count(og), count(yg)]), count(*) from s
 union all select 'age', 'soft_f1', null, avg(s_soft), count(s_soft) from s
 union all select 'tags', 'micro_f1', null, 2.0*sum(ntp)/sum(ng+np), count(*) from s where ng > 0
 union all select 'occupation', 'mean_cos', null, avg(c_occ), count(*) from s where og is not null
 union all select 'occupation', 'token_f1', null, avg(t_occ), count(t_occ) from s
 union all select 'type', 'pct_human', null, 100.0 * sum(hp::int) / count(hp), count(hp) from s
 union all select 'type', 'mean_cos', null, avg(c_type), count(*) from s where nonhuman and yg is not null)
select 'run-1' run_id, attribute, metric, label, round(v::double, 6) "value", n::bigint support from cells where v is not null""",
)
def eval_files_report(spark, sf):
    """K3 from files: the report, appended under two runs and one read back."""
    report, _ = _evaluate(spark, sf)
    checked = report.checkpoint()
    path = scratch_path(spark, "reports")
    for run in ("run-0", "run-1"):
        io.append_report(report_with_run(checked, run, sf), path)
    return rounded(io.read_run(spark, path, "run-1").drop("source", "evaluated_at"))


@register(
    "appended_predictions",
    with_clause("file_pred") + """select url book, name character, output, 'run-b' run_id, 'mock' model, 'all_mentions' strategy,
 'lang,age' attributes from file_pred""",
)
def appended_predictions(spark, sf):
    """A9 + A11: chunks of predictions appended under run ids; one run read back."""
    pred = view(spark, sf, "file_pred").select(F.col("url").alias("book"), F.col("name").alias("character"), "form", "output")
    path = scratch_path(spark, "runs")
    io.append_predictions(pred.drop("form"), path, "run-a", "other")
    for odd in (0, 1):  # two chunks of one run
        io.append_predictions(pred.where(F.col("form") % 2 == odd).drop("form"), path, "run-b", "mock", "all_mentions",
                              ["lang", "age"])
    return io.read_run(spark, path, "run-b")


@register(
    "replayed_predictions",
    with_clause("file_pred") + """select url book, name character, output, 'run-b' run_id, 'mock' model, 'all_mentions' strategy,
 'lang,age' attributes from file_pred""",
)
def replayed_predictions(spark, sf):
    """A9, exactly once: the chunks of a run arrive as a stream of files, then a job that
    believes itself lost hands out two of them again; no row is added."""
    pred = view(spark, sf, "file_pred").select(F.col("url").alias("book"), F.col("name").alias("character"), "form", "output")
    base = scratch_path(spark, "replayed")
    path, sent = f"{base}/runs", f"{base}/sent"
    chunk = lambda odd: pred.where(F.col("form") % 2 == odd).drop("form")
    io.append_predictions(pred.drop("form"), path, "run-a", "other", batch=0)
    tags = ("run-b", "mock", "all_mentions", ["lang", "age"])
    for odd in (0, 1):  # each run of the stream is one batch
        chunk(odd).write.mode("append").parquet(sent)
        stream_predictions(file_stream(spark, sent, chunk(odd).schema), path, f"{base}/ckpt", *tags)
    for number in (1, 0, 1):
        io.append_predictions(chunk(number), path, *tags, batch=number)
    return io.read_run(spark, path, "run-b").drop("batch")


@register(
    "gold_files",
    with_clause("file_gold") + """select name, url gutenberg_url, name book_title, lang, age,
 case when tag1 is not null then tag1 || '|' || tag2 end tags, cast(null as varchar) origin from file_gold""",
)
def gold_files(spark, sf):
    """A8 + A1 + B1: gold written as JSON Lines, read with VARIANT fields and flattened."""
    gold = io.flatten_gold(io.read_gold(spark, _files(spark, sf)[0]),
                           {"lang": "string", "age": "string", "tags": "array<string>", "origin": "string"})
    return gold.drop("aliases").withColumn("tags", F.array_join("tags", "|"))


@register(
    "json_array_documents",
    "select doc_id, lang, source, n_chars, md5(text) text_md5 from documents",
)
def json_array_documents(spark, sf):
    """A4: the documents as large JSON arrays, each read back by byte ranges."""
    path = scratch_path(spark, "arrays")
    write_json_arrays(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    back = read_json_array(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@register("catalog_csv", _CATALOG_SQL + "select title, author, found in_catalog from f")
def catalog_csv(spark, sf):
    """A7 + A3: the catalogue as a comma CSV (commas in its fields), read with its
    schema and matched (C7)."""
    path = scratch_path(spark, "catalog-csv")
    io.write_csv(view(spark, sf, "catalog"), path)
    books = io.read_csv(spark, path, "title string, author string")
    flagged = flag_in_catalog(view(spark, sf, "wanted"), books.select("title", F.array("author").alias("authors")))
    return flagged.select("title", "author", F.col("found").alias("in_catalog"))


@register(
    "list_texts",
    """with d as (select doc_id, lang || ' , ' || source || ',,' || lang as t, '["' || lang || '", "' || source || '"]' as l from documents)
select doc_id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') items,
  len(string_split(t, ', '))::bigint n_blank_split, lang_ || '|' || source_ literal,
  'Instruct: T' || chr(10) || 'Query: ' || lang_ || ', ' || source_ instruct
from d join (select doc_id, lang lang_, source source_ from documents) using (doc_id)""",
)
def list_texts(spark, sf):
    """S7, S8, S9, S12 on texts derived from each document."""
    d = view(spark, sf, "doc_gold")
    t = F.concat("lang", F.lit(" , "), "source", F.lit(",,"), "lang")
    literal = parse_list_literal(F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]')))
    return d.select("doc_id", F.array_join(split_list(t), "|").alias("items"),
                    F.size(split_comma_blank(t)).cast("bigint").alias("n_blank_split"),
                    F.array_join(literal, "|").alias("literal"), instruct_text(F.lit("T"), literal).alias("instruct"))


@register(
    "value_kinds",
    with_clause("file_gold") + """select 'STRING' kind, count(*) n from file_gold where tag1 is not null
union all select null, count(*) from file_gold where tag1 is null having count(*) > 0""",
)
def value_kinds(spark, sf):
    """D17, the type half: what kinds of value the gold file's tags hold."""
    gold = io.read_gold(spark, _files(spark, sf)[0])
    return M.type_profile(gold.select(F.try_variant_get("attributes", F.lit("$.tags[0]"), "variant").alias("v")), "v")
