"""Test views derived from the driver tables.

Each view is plain SQL that runs unchanged in Spark SQL and in DuckDB, so the
Spark jobs and the DuckDB oracle read identical inputs.  Views only reshape the
driver tables; every one grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # graph statements (subject, property, value)
    "triples": """
select concat('book/',o_orderkey) s,'genre' p,o_orderpriority o from orders
union all select concat('book/',o_orderkey),'author',concat('person/',o_custkey) from orders
union all select concat('book/',o_orderkey),'date',substr(cast(o_orderdate as varchar(30)),1,10) from orders
union all select concat('book/',o_orderkey),'catalog_id',cast(o_orderkey as varchar(30)) from orders where o_orderstatus='F'
union all select concat('book/',l_orderkey),'character',concat('char/',l_partkey) from lineitem
union all select concat('char/',p_partkey),'brand',p_brand from part
union all select concat('char/',p_partkey),'kind',p_type from part
union all select concat('char/',p_partkey),'kind','PROMO' from part where p_partkey%5=0
union all select concat('char/',p_partkey),'alias',p_name from part""",
    # entity and property labels; some entities carry a second, non-English label
    "graph_labels": """
select concat('char/',p_partkey) id, p_name label, 'en' lang from part
union all select concat('char/',p_partkey), upper(p_name), 'fr' from part where p_partkey%3=0
union all select concat('person/',c_custkey), c_name, 'en' from customer where c_custkey%7<>0
union all select concat('book/',o_orderkey), concat('Title ',cast(o_orderkey as varchar(30))), 'en' from orders where o_orderkey%4<>0
union all select p, concat(p,' label'), 'en' from (select distinct p from (
  select 'genre' p union all select 'author' union all select 'date' union all select 'catalog_id'
  union all select 'character' union all select 'brand' union all select 'kind') x) y""",
    "wanted": "select distinct p_name title, concat('A. ',p_brand) author from part",
    "catalog": (
        "select distinct case when p_partkey%2=0 then concat('The ',upper(p_name),' Stories') "
        "else concat('Unlisted ',cast(p_partkey as varchar(30))) end title, concat(p_brand,', someone') author from part"
    ),
    # catalogue entries for the dataset build: titles that contain some book labels
    "book_catalog": (
        "select distinct concat(case when o_orderkey%3=0 then 'The Complete Title ' else 'Other Volume ' end,"
        "cast(o_orderkey as varchar(30))) title, "
        "concat('Edited by ',c_name) author from orders join customer on o_custkey=c_custkey"
    ),
    # texts with a language; some persons have a second native name, every motto is
    # given in two languages
    "person_facts": """
select concat('person/',c_custkey) s, 'native_name' p, c_name o, case when c_nationkey%2=0 then 'fr' else 'de' end lang from customer
union all select concat('person/',c_custkey), 'native_name', concat('Also ',c_name), 'it' from customer where c_custkey%4=0
union all select concat('person/',c_custkey), 'motto', c_mktsegment, 'en' from customer
union all select concat('person/',c_custkey), 'motto', c_mktsegment, 'fr' from customer""",
    "corpus": "select concat('doc/',doc_id) url, text, lang from documents",
    "cast_list": """
select concat('doc/',doc_id) url, case lang when 'en' then 'the' when 'fr' then 'eque' when 'de' then 'fur' else 'cion' end name,
 case lang when 'en' then 'of the|and' when 'fr' then 're|le' when 'de' then 'die|in' else 'de la|la' end aliases from documents
union all select concat('doc/',doc_id), 'un', 'and the|la' from documents where doc_id%3=0
union all select concat('lost/',doc_id), 'the', 'of' from documents where doc_id%10=0""",
    "closed": """
select doc_id, lang gold, case when doc_id%13=0 then null when doc_id%7=0 then 'en' when doc_id%3=0 then upper(lang) else lang end pred from documents""",
    "ordinal": """
select doc_id, case when n_chars<300 then 'child' when n_chars<900 then 'teenager' when n_chars<3000 then 'adult' else 'senior' end gold,
 case when n_chars+(doc_id%5)*300<300 then 'child' when n_chars+(doc_id%5)*300<900 then 'Teenager' when n_chars+(doc_id%5)*300<3000 then 'adult ' when doc_id%11=0 then null else 'senior' end pred from documents""",
    "sets_gold": (
        "select distinct user_id, concat(event_type,'-',cast(event_id%40 as varchar(30))) v from events"
    ),
    "sets_pred": (
        "select distinct user_id, concat(event_type,'-',cast((event_id+case when event_id%3=0 then 1 else 0 end)%40 as varchar(30))) v from events"
    ),
    "set_users": "select distinct user_id from events",
    "raw_outputs": """
select doc_id, case doc_id%8
 when 0 then concat('<think>{hm}',chr(10),'</think>',repeat('`',3),'json',chr(10),'{"lang": "',lang,'", "tags": ["',source,'"]}',chr(10),repeat('`',3))
 when 1 then concat('{"lang": None, "tags": ["',source,', x"]}')
 when 2 then concat('Sure: {"lang": "',lang,'", "tags": []}')
 when 3 then concat('{"lang": "',lang,'", "tags": ["country: ',source,'", city]}')
 when 4 then concat('{"lang": "',lang,'"} trailing words')
 when 5 then concat('{"lang": "',lang,'"')
 when 6 then concat('{"type": {"is_human": ',case when doc_id%3=0 then 'true' else 'false' end,', "character_type": "',lang,'"}}')
 else null end raw from documents""",
    # gold per document for the evaluation job: language, source as a one-item
    # list, and a nested type where every fifth document is non-human
    "doc_gold": """
select doc_id, lang, source, case when doc_id%5=0 then lang else 'human' end type_gold from documents""",
    # gold and model outputs of one character per document, for the job from files
    "file_gold": """
select concat('c',doc_id) name, concat('doc/',doc_id) url, lang,
 case when n_chars<300 then 'child' when n_chars<900 then 'teenager' when n_chars<3000 then 'adult' else 'senior' end age,
 case when doc_id%7<>0 then source end tag1, case when doc_id%7<>0 then lang end tag2,
 case when doc_id%4<>0 then lang end occupation,
 case when doc_id%11<>0 then case when doc_id%5=0 then source else 'human' end end kind from documents""",
    "file_pred": """
select concat('c',doc_id) name, concat('doc/',doc_id) url, doc_id%6 form, case doc_id%6
 when 0 then concat('{"lang": "',lang,'", "age": "adult", "tags": ["',source,'", "x"], "occupation": ["',lang,'", "baker"], "type": {"is_human": true, "character_type": ""}}')
 when 1 then concat('{"lang": "EN", "age": "teenager", "tags": ["',source,'"], "occupation": ["',source,'"], "type": {"is_human": false, "character_type": "',source,'"}}')
 when 2 then '{"lang": null, "age": "Senior ", "tags": ["a", "b"], "type": {"is_human": false, "character_type": "spirit"}}'
 when 3 then null
 when 4 then 'no object; here'
 else concat('Answer:',chr(10),'{"lang": "',lang,'", "age": "child", "tags": ["',lang,'", "',source,'"], "occupation": ["',lang,'"], "type": {"is_human": true, "character_type": ""}}') end output
from documents""",
    # outputs damaged in the rare ways, one template each (see repair_damaged)
    "damaged_outputs": """
select doc_id, source, case doc_id%8
 when 0 then concat('{"origin": ["country": "',source,'", "city": "Lima"], "age": "adult"}')
 when 1 then concat('{"origin": ["x"]: ["',source,'", "Arica"], "age": "adult"}')
 when 2 then concat('{"residence": ["',source,'"], ''null'', "age": "adult"}')
 when 3 then concat('{"residence": ["Pa',chr(10),'ris"],',chr(10),'"age": "',source,'"}')
 when 4 then concat('{"residence": ["',source,'"]],',' "age": "adult"}')
 when 5 then concat('{"residence": ["',source,'"]',chr(10),'"age": "adult"}')
 when 6 then concat('{"age": "child", "age": "',source,'"}')
 else concat('{"age": ',source) end raw from documents""",
    "vector_pairs": (
        "select a.vec_id, a.embedding ea, b.embedding eb from embeddings a "
        "join embeddings b on b.vec_id=a.vec_id+1"
    ),
    "vector_gold": "select vec_id, embedding ea from embeddings",
    "vector_pred": "select vec_id - 1 vec_id, case when vec_id%9<>4 then embedding end eb from embeddings",
    # retrieval: a group of 50 consecutive vectors plays one character of one
    # book; its first three vectors are the attribute queries, the rest passages
    "vector_queries": (
        "select cast(floor(vec_id/50) as bigint) grp, vec_id%50 attr_no, embedding from embeddings "
        "where vec_id%50<3"
    ),
    "vector_passages": (
        "select cast(floor(vec_id/50) as bigint) grp, vec_id passage_no, embedding from embeddings "
        "where vec_id%50>=3"
    ),
    # token vectors of short texts: 8 consecutive vectors form a text; text 2k is
    # the gold side, text 2k+1 the predicted side of pair k
    "token_vectors": (
        "select cast(floor(vec_id/16) as bigint) pair_id, case when vec_id%16<8 then 'gold' else 'pred' end side, "
        "vec_id tok_no, embedding from embeddings"
    ),
}

# base tables read once per (session, folder); the views are resolved eagerly,
# so re-pointing the base names at another folder never changes a built view
_TABLES: dict[tuple[str, int, str, str], DataFrame] = {}
_REGISTERED: dict[tuple[str, int], str] = {}


def _session_key(spark: SparkSession) -> tuple[str, int]:
    # the application id changes with every new context, so a stopped and
    # recreated session never sees cached plans of the old one
    try:
        return spark.sparkContext.applicationId, id(spark)
    except Exception:  # no SparkContext handle (e.g. a Connect session)
        return "", id(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The driver files are single row groups, which Spark
    cannot split; such a scan is spread over the default parallelism once, so
    per-row work downstream does not run in one task.  A large, many-file
    dump already has enough splits and is left as read."""
    key = (*_session_key(spark), sf_dir, name)
    if key not in _TABLES or _TABLES[key].sparkSession is not spark:
        path = f"{sf_dir}/{name}.parquet"
        df = spark.read.parquet(path)
        try:
            par = spark.sparkContext.defaultParallelism
            few = df.rdd.getNumPartitions() < par
        except Exception:  # no RDD access: leave the scan as read
            par, few = 0, False
        if few:
            df = df.repartition(par)
        _TABLES[key] = df
    return _TABLES[key]


def register_base(spark: SparkSession, sf_dir: str, names=None) -> None:
    sk = _session_key(spark)
    if names is None and _REGISTERED.get(sk) == sf_dir and spark.catalog.tableExists(BASE_TABLES[0]):
        return
    for t in names or BASE_TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    if names is None:
        _REGISTERED[sk] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame (analysed now, so later
    re-registrations of the base names do not change it)."""
    register_base(spark, sf_dir)
    return spark.sql(VIEWS[name])


def with_clause(*names: str) -> str:
    """DuckDB WITH clause defining the named views over the registered tables."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
