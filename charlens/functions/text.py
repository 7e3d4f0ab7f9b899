"""Scalar text functions (S1-S12) as Spark column expressions.

Everything here is a JVM-side expression except accent folding, which has no
built-in (no Unicode NFD in Spark SQL) and runs as an Arrow-batched pandas UDF
doing whole-document string operations (no per-token Python loop).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The characters Python's ``str.split()`` treats as whitespace, written as a
# Java/RE2 character class: tab, line feed, vertical tab, form feed, carriage
# return, the four separators U+001C..U+001F, space, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (
    r"[\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}-\x{1F}\x{20}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ---------------------------------------------------------------------------

# the same characters for Java: told apart from printable ASCII by one range first
WS_RUN = r"[\x{00}-\x{20}\x{7F}-\x{10FFFF}&&" + WS_CLASS + "]+"
_EDGE_WS = f"^{WS_RUN}|{WS_RUN}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(x), _EDGE_WS, "")


def tokens(x) -> Column:
    """Python ``str.split()`` as a column: split on whitespace runs; only
    a leading or trailing run can leave an empty piece, and those are removed
    (one regex pass, no trim pass)."""
    return F.array_remove(F.split(_c(x), WS_RUN, -1), "")


# ---- S1 accent folding -------------------------------------------------------
_MARKS: re.Pattern | None = None


def _marks() -> re.Pattern:
    """Runs of non-spacing marks (Unicode category Mn), ranges built by rule."""
    global _MARKS
    if _MARKS is None:
        runs: list[list[int]] = []
        for cp in range(0x110000):
            if unicodedata.category(chr(cp)) == "Mn":
                if runs and runs[-1][1] == cp - 1:
                    runs[-1][1] = cp
                else:
                    runs.append([cp, cp])
        _MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")
    return _MARKS


def fold_str(s: str) -> str:
    """lower-case, NFD, drop non-spacing marks (same result as per-character folding)."""
    low = s.lower()
    if low.isascii():
        return low
    return _marks().sub("", unicodedata.normalize("NFD", low))


def _fold_joined_batch(text: pd.Series) -> pd.Series:
    # tokens joined by one blank, then folded as a whole string: whitespace is
    # untouched by lower/NFD/mark removal, so split(' ') keeps token positions
    # (a token made only of marks becomes '' and still holds its place).
    # A text without tokens gives null (told apart from one empty token).
    def one(t):
        if t is None:
            return None
        toks = t.split()
        return fold_str(" ".join(toks)) if toks else None

    return text.map(one)


def _fold_plain_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold_str(t))


_UDFS: dict = {}


def arrow_udf(fn, rtype=T.StringType(), kind=F.pandas_udf):
    """Arrow UDFs, on pandas Series or (``F.arrow_udf``) on Arrow arrays, are built on first
    use (no session needed at import).

    They are pure, but flagged non-deterministic so the optimizer never
    copies the Python call into an inferred filter (it would run twice)."""
    if fn not in _UDFS:
        _UDFS[fn] = kind(fn, rtype).asNondeterministic()
    return _UDFS[fn]


def _fold_joined(c: Column) -> Column:
    return arrow_udf(_fold_joined_batch)(c)


def _fold_plain(c: Column) -> Column:
    return arrow_udf(_fold_plain_batch)(c)


def folded_tokens(text) -> Column:
    """S1+S2+S3 on a book: folded token i corresponds to original token i.
    (Column form; ``with_folded_tokens`` keeps the Python call to one per row.)"""
    return _split_folded(_fold_joined(_c(text)), _c(text))


def _split_folded(folded: Column, text: Column) -> Column:
    return (F.when(text.isNull(), F.lit(None).cast("array<string>"))
            .when(folded.isNull(), F.array().cast("array<string>"))
            .otherwise(F.split(folded, " ", -1)))


def with_folded_tokens(df, text_col: str, out_col: str):
    """DataFrame form of ``folded_tokens``: the fold runs in its own
    projection, so it is evaluated exactly once per row."""
    tmp = f"_{out_col}_folded"
    return df.withColumn(tmp, _fold_joined(F.col(text_col))).withColumn(
        out_col, _split_folded(F.col(tmp), F.col(text_col))).drop(tmp)


def fold(x) -> Column:
    """S1+S3 on short strings (names, aliases): fold first, tokenise after."""
    return _fold_plain(_c(x))


# ---- other scalar functions --------------------------------------------------
def last_token_lower(x) -> Column:
    """Last whitespace token, lower case; blank or null -> ''."""
    t = tokens(x)
    return F.coalesce(F.lower(F.try_element_at(t, F.lit(-1))), F.lit(""))


def uri_tail(x) -> Column:
    """Last URI segment."""
    return F.substring_index(_c(x), "/", -1)


def list_to_text(x) -> Column:
    """List -> ', '-joined text."""
    return F.array_join(_c(x), ", ")


def split_list(x) -> Column:
    """Comma text -> list of stripped, non-blank items; null -> []."""
    parts = F.transform(F.split(_c(x), ","), lambda e: py_strip(e))
    return F.coalesce(F.filter(parts, lambda e: e != ""), F.array().cast("array<string>"))


def split_comma_blank(x) -> Column:
    """Text -> list on ', ' without trimming ('' -> [''])."""
    return F.split(_c(x), ", ", -1)


def parse_list_literal(x) -> Column:
    """S9: '[...]' list literal (single or double quotes) -> array; else []."""
    c = _c(x)
    parsed = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )


def to_bool(x) -> Column:
    """S10: 'true'/'false' in any case and padding -> boolean, else null."""
    v = F.lower(py_strip(_c(x).cast("string")))
    return F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False))


def underscore_to_blank(x) -> Column:
    """S11."""
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def instruct_text(task, values) -> Column:
    """Instruction-conditioned value text 'Instruct: <task>\\nQuery: <v1, v2>'."""
    vals = F.coalesce(_c(values), F.array().cast("array<string>"))
    return F.concat(F.lit("Instruct: "), _c(task), F.lit("\nQuery: "), F.array_join(vals, ", "))
