"""Bulk repair of malformed model outputs (H1-H10, B10) as one DataFrame job.

Every stage is a native column expression (regexp_replace / regexp_extract /
split / transform / try_parse_json), so the whole repair runs inside the
executor JVM with no Python per row.  Regex patterns follow Python ``re``
semantics: ``\\s`` is spelled as the explicit Python whitespace class, ``.``
never crosses a line feed unless DOTALL is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.functions.text import WS_CLASS, py_strip

S = WS_CLASS  # Python's \s

# --- fixed values -----------------------------------------------------------
# Location labels removed from list items, each followed by optional blanks
# and ": " (the last one by ":" alone), in this order:
LOCATION_KEYS = ["continent", "country", "state", "city"]
LOCATION_CATCH_ALL = "any other available location information"
# What counts as noise around an object (H1): reasoning blocks, the head of a code
# fence, a null written as in Python.
THINK_BLOCK = r"(?s)<think>.*?</think>"
FENCE_HEAD = r"```json" + S + "*"
PYTHON_NULL = ":" + S + r"*None\b"
# A list value in text that does not parse (H8): to the first bracket that a comma or a
# line feed follows; the attribute's name stands for %s.
LIST_VALUE = '(?s)"%s"' + S + "*:" + S + r"*\[(.*?)\](,|\n)"
# ---------------------------------------------------------------------------

STATUS_OK = "ok"
STATUS_REPAIRED = "repaired"
STATUS_UNPARSABLE = "unparsable"
STATUS_MISSING = "missing"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_noise(t: Column) -> Column:
    """H1: think blocks, code fences, ``: None`` -> ``: null``, outer blanks."""
    t = F.regexp_replace(t, THINK_BLOCK, "")
    t = F.regexp_replace(t, FENCE_HEAD, "")
    t = F.replace(t, F.lit("```"), F.lit(""))
    t = F.regexp_replace(t, PYTHON_NULL, ": null")
    return py_strip(t)


def tail_object(t: Column) -> Column:
    """H2: from the first '{' to a '}' that ends the text ('' when none)."""
    return F.regexp_extract(t, r"(?d)(\{[\s\S]*\})" + S + "*$", 1)


def collapse_origin(j: Column, key: str = "origin") -> Column:
    """H3: ``"origin": ["k": "v", ...]`` -> list of the values, and
    ``"origin": [..]: [..]`` -> the second list."""
    # the list's body is cut first and then read pair by pair: a repeated group
    # would recurse once per pair
    p1 = f'"{key}"' + S + "*:" + S + r"*\[" + S + r'*("[^\]]*)\]'
    pair = '"[^"]+"' + S + "*:" + S + '*"[^"]+",?' + S + "*"
    body = F.regexp_extract(j, p1, 1)
    only_pairs = (body != "") & (F.regexp_replace(body, pair, "") == "")
    whole = F.when(only_pairs, F.regexp_extract(j, p1, 0)).otherwise(F.lit(""))
    inner = body
    vals = F.regexp_extract_all(inner, F.lit(":" + S + '*"([^"]+)"'), F.lit(1))
    rep = F.concat(
        F.lit(f'"{key}": ['),
        F.array_join(F.transform(vals, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "),
        F.lit("]"),
    )
    j = F.when(whole != "", F.replace(j, whole, rep)).otherwise(j)
    p2 = f'(?s)"{key}"' + S + "*:" + S + r"*\[[^\[\]]+\]" + S + "*:" + S + r"*(\[[^\[\]]+\])"
    return F.regexp_replace(j, p2, f'"{key}": $1')


def _map_brackets(j: Column, dotall: bool, fix_item) -> Column:
    """Apply ``fix_item`` to every comma item of every ``[...]`` group (lazy,
    leftmost, non-overlapping, like ``re.sub(r'\\[(.*?)\\]', ...)``)."""
    body = r"[\s\S]*?" if dotall else r"[^\n]*?"
    contents = F.regexp_extract_all(j, F.lit(r"\[(" + body + r")\]"), F.lit(1))
    gaps = F.split(j, r"\[" + body + r"\]", -1)
    fixed = F.transform(
        contents,
        lambda c: F.concat(
            F.lit("["), F.array_join(F.transform(F.split(c, ",", -1), fix_item), ", "), F.lit("]")
        ),
    )
    pieces = F.zip_with(gaps, F.concat(fixed, F.array(F.lit(""))), lambda g, f: F.concat(g, f))
    return F.when(F.size(contents) == 0, j).otherwise(F.array_join(pieces, ""))


def _quote_item(x: Column) -> Column:
    xs = py_strip(x)
    return F.when(xs.rlike(r'(?d)^"[^"]*"$'), xs).otherwise(F.concat(F.lit('"'), xs, F.lit('"')))


def _sanitize_item(x: Column) -> Column:
    it = py_strip(x)
    nq = F.length(it) - F.length(F.replace(it, F.lit('"'), F.lit("")))
    return (
        F.when(nq > 2, F.concat(F.lit('"'), py_strip(F.replace(it, F.lit('"'), F.lit(""))), F.lit('"')))
        .when(~it.startswith('"'), F.concat(F.lit('"'), it, F.lit('"')))
        .otherwise(it)
    )


def quote_lists(j: Column) -> Column:
    """H4: quote every list item once (numbers and null become strings,
    ``[]`` becomes ``[""]``); then the DOTALL sanitising pass."""
    j = _map_brackets(j, False, _quote_item)
    return _map_brackets(j, True, _sanitize_item)


def drop_location_keys(j: Column) -> Column:
    """H5: strip location labels, then bracket typo fixes."""
    for k in LOCATION_KEYS:
        j = F.regexp_replace(j, k + S + "*: ", "")
    j = F.regexp_replace(j, LOCATION_CATCH_ALL + S + "*:", "")
    j = F.replace(j, F.lit('" ['), F.lit('"'))
    j = F.replace(j, F.lit("]],"), F.lit("],"))
    j = F.regexp_replace(j, r"\]" + S + r"*\],", "],")
    j = F.replace(j, F.lit('[""] '), F.lit('[""],'))
    return F.regexp_replace(j, r'("\])' + S + '*(")', "$1,\n$2")


def bracket_fixes(j: Column) -> Column:
    """H6: doubled opening bracket, stray 'null' items."""
    j = F.regexp_replace(j, r'\["\["([^"]+)"+"', '["$1"')
    return F.replace(j, F.lit("'null',"), F.lit(""))


def _normalise(j: Column) -> Column:
    return bracket_fixes(drop_location_keys(quote_lists(j)))


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _json_object(entries: Column, value) -> Column:
    """JSON text of (key, value) entries, of repeated keys the last."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda e: F.concat(name(e["key"]), F.lit(":"), value(e["value"]))), ","), F.lit("}"))


def _loose(j: Column) -> Column:
    """The texts of a JSON object's values by key, repeated keys included; null if it is none."""
    return F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<map<string,string>>", _STRICT)


def last_keys(j: Column, loose: Column, depth: int = 2) -> Column:
    """The JSON object ``j`` (``loose`` as from ``_loose``) without repeated keys, the last
    of each kept; null if it is none.

    Values keep their kind; only where a nested object repeats keys too (down to
    ``depth`` levels) is a text that reads as a number or a truth value taken for one."""
    typed = F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<map<string,variant>>", _STRICT)
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)

    def text(t: Column) -> Column:
        plain = F.when(t.isNull(), "null").when(F.try_parse_json(t).isNotNull(), t)
        return F.coalesce(plain, F.when(t.startswith("{"), last_keys(t, _loose(t), depth - 1)) if depth > 1 else plain, quoted(t))

    whole = lambda m: F.when(F.size(m) == 1, F.map_entries(m[0]))
    return F.coalesce(_json_object(whole(typed), lambda v: F.coalesce(F.to_json(v), F.lit("null"))), _json_object(whole(loose), text))


def with_object(df: DataFrame, j: str, out: str) -> DataFrame:
    """H7: strict single-object parse of the text column ``j`` -> VARIANT column ``out`` or null.

    Wrapping in [...] rejects trailing text, which the variant parser would otherwise
    accept.  Of repeated keys the last counts, whatever the session's own setting: the
    texts that the parser refuses though they are objects are read key by key, in steps
    of their own, so that the others pay nothing for it."""
    wrapped = lambda t: F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    df = df.withColumn("_strict", wrapped(F.col(j)))
    df = df.withColumn("_loose", F.when(F.col("_strict").isNull() & F.col(j).startswith("{"), _loose(F.col(j))))
    df = df.withColumn("_again", F.when(F.col("_loose").isNotNull(), last_keys(F.col(j), F.col("_loose"))))
    df = df.withColumn("_strict", F.coalesce("_strict", F.when(F.col("_again").isNotNull(), wrapped(F.col("_again")))))
    v = F.col("_strict")
    first = F.try_variant_get(v, "$[0]", "variant")
    good = v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull() & F.schema_of_variant(first).startswith("OBJECT")
    return df.withColumn(out, F.when(good, first)).drop("_strict", "_loose", "_again")


def _fallback_list(j: Column, attr: str) -> Column:
    """H8: rebuild the ``attr`` list from its key/value items."""
    pat = LIST_VALUE % attr
    whole = F.regexp_extract(j, pat, 0)
    raw = F.regexp_extract(j, pat, 1)
    vals = F.regexp_extract_all(
        raw, F.lit('"[^"]+"' + S + "*:" + S + r'*(\[[^\]]+\]|"[^"]*"|None)'), F.lit(1)
    )
    cleaned = F.transform(vals, lambda v: F.regexp_replace(py_strip(v), r'^["\x{20}]+|["\x{20}]+$', ""))
    parts = F.transform(
        cleaned,
        lambda v: F.when(
            v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))
        ).otherwise(F.array(v)),
    )
    items = F.flatten(parts)
    as_json = F.to_json(items)
    literal = F.regexp_replace(F.regexp_replace(as_json, r"\\", r"\\\\"), r"\$", r"\\\$")
    rebuilt = F.regexp_replace(
        j,
        F.lit(f'(?s)"{attr}"' + S + r"*:" + S + r"*\[.*?\](,|\n)"),
        F.concat(F.lit(f'"{attr}": '), literal, F.lit("$1")),
    )
    return F.when(whole != "", _normalise(rebuilt))


def repair_outputs(
    raw: DataFrame,
    attrs: Mapping[str, str] | Sequence[str],
    output_col: str = "output",
    repair_attr: str = "residence",
    origin_key: str = "origin",
) -> DataFrame:
    """H1-H10 + B10: add ``parsed`` (VARIANT), ``status`` and one typed column
    per requested attribute (``{name: spark_type}``; a plain list means
    ``string``).  Rows are never dropped: unparsable or missing outputs give
    null in every attribute column."""
    if not isinstance(attrs, Mapping):
        attrs = {a: "string" for a in attrs}
    t = _c(output_col)
    out = raw.withColumn("_obj", tail_object(strip_noise(t)))
    out = out.withColumn("_j1", _normalise(collapse_origin(F.col("_obj"), origin_key)))
    out = with_object(out, "_j1", "_p1")
    out = out.withColumn("_j2", F.when(F.col("_p1").isNull() & (F.col("_obj") != ""), _fallback_list(F.col("_j1"), repair_attr)))
    out = with_object(out, "_j2", "_p2")
    status = (
        F.when(t.isNull(), F.lit(STATUS_MISSING))
        .when(F.col("_p1").isNotNull(), F.lit(STATUS_OK))
        .when(F.col("_p2").isNotNull(), F.lit(STATUS_REPAIRED))
        .otherwise(F.lit(STATUS_UNPARSABLE))
    )
    out = out.withColumn("parsed", F.coalesce("_p1", "_p2")).withColumn("status", status)
    out = out.drop("_obj", "_j1", "_j2", "_p1", "_p2")
    for name, typ in attrs.items():
        out = out.withColumn(name, F.try_variant_get(F.col("parsed"), f"$.{name}", typ))
    return out


def repair_summary(repaired: DataFrame) -> DataFrame:
    """Count of rows per repair status."""
    return repaired.groupBy("status").agg(F.count("*").alias("n"))
