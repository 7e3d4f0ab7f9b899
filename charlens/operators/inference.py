"""Model plug-ins: batch inference (G6, U2), mock model (G7), embedder.

Only the model call itself leaves the JVM: distinct prompts are handed in
Arrow batches to a user ``model_fn(list[str]) -> list[str]`` inside
``mapInArrow`` (the model is loaded once per Python worker by the plug-in),
and the results are joined back by a prompt hash -- never by the prompt text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlens.session import checkpoint_root

# --- fixed values -----------------------------------------------------------
# Mock model answer per attribute (JSON values); other attributes answer null.
#   age "adult", gender "female", spoken_languages ["English"],
#   origin ["France"], residence ["Paris"], occupation ["teacher"],
#   physical_health "good", type {"is_human": true, "character_type": ""}
MOCK_VALUES: dict[str, object] = {
    "age": "adult",
    "gender": "female",
    "spoken_languages": ["English"],
    "origin": ["France"],
    "residence": ["Paris"],
    "occupation": ["teacher"],
    "physical_health": "good",
    "type": {"is_human": True, "character_type": ""},
}
# ---------------------------------------------------------------------------

#: bytes of prompts that are Python strings at once: a batch of long ones goes to the model in parts
PART = 1 << 23

STATUS_OK = "ok"
STATUS_ERROR = "error"


def mock_output(attrs: Sequence[str]) -> Column:
    """The mock answer as a native literal column (``json.dumps`` layout:
    ', ' between items, ': ' after keys, non-ASCII kept)."""
    return F.lit(json.dumps({a: MOCK_VALUES.get(a) for a in attrs}, ensure_ascii=False))


def mock_model(attrs: Sequence[str]) -> Callable[[list[str]], list[str]]:
    """The same mock as a ``model_fn`` plug-in (for G6 end-to-end runs)."""
    text = json.dumps({a: MOCK_VALUES.get(a) for a in attrs}, ensure_ascii=False)
    return lambda prompts: [text for _ in prompts]


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def infer(prompts: DataFrame, model_fn: Callable[[list[str]], list[str]], prompt_col: str = "prompt",
          output_col: str = "output", make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One output per input row; rows with a null prompt get a null output
    and no model call; every distinct prompt is sent once.  A failing batch
    is halved down to single prompts; one that still fails yields an ``Error: ...``
    string with status ``error`` (the row is kept).

    With ``make`` the rows hold the keys of their prompts (``prompt_key``) as ``prompt_col``,
    and ``make`` gives (pkey, prompt) for the one row of each key that asks: texts many
    times what they are made from are made where they are sent and never move."""

    part = PART  # as set where the plan is made

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("prompt")).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // part, prepend=0)).tolist()
            for a, z in zip([0, *cuts], [*cuts, len(size)]):
                answers = attempt(batch.column("prompt").slice(a, z - a).to_pylist())
                outs, states = [[x[i] for x in answers] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("pkey").slice(a, z - a), pa.array(outs, pa.string(), from_pandas=True),
                                                  pa.array(states, pa.string())], ["pkey", "out", "status"])

    def attempt(texts: list[str]) -> list[tuple[str, str]]:
        if not texts:
            return []
        try:
            outs = list(model_fn(texts))
            if len(outs) != len(texts):
                raise ValueError(f"model returned {len(outs)} outputs for {len(texts)} prompts")
            return [(o, STATUS_OK) for o in outs]
        except Exception as e:  # noqa: BLE001 - surfaced as data
            if len(texts) == 1:
                return [(f"Error: {e}", STATUS_ERROR)]
            half = len(texts) // 2
            return attempt(texts[:half]) + attempt(texts[half:])

    if make is None:
        keyed = prompts.withColumn("_pkey", prompt_key(F.col(prompt_col)))
        distinct = (
            keyed.where(F.col(prompt_col).isNotNull())
            .groupBy(F.col("_pkey").alias("pkey"))
            .agg(F.first(prompt_col).alias("prompt"))
        )
    else:
        keyed = prompts.withColumn("_pkey", F.col(prompt_col))
        asks = keyed.where(F.col(prompt_col).isNotNull()).groupBy(F.col("_pkey").alias("pkey")).agg(
            F.min(F.struct(*[c for c in prompts.columns if c != prompt_col])).alias("f"))
        distinct = make(asks.select("pkey", "f.*"))
    answers = distinct.select("pkey", "prompt").mapInArrow(call, "pkey string, out string, status string").withColumnRenamed("pkey", "_asked")
    out = keyed.join(answers, keyed["_pkey"] == answers["_asked"], "left")
    return out.select(
        *[F.col(c) for c in prompts.columns],
        F.col("out").alias(output_col),
        # by the key, so that a prompt the caller drops does not move in the join
        F.when(F.col("_pkey").isNull(), F.lit("skipped")).otherwise(F.col("status")).alias("status"),
    )


# ---- U1 embedder plug-in ------------------------------------------------------------
def text_key(text) -> Column:
    """SHA-256 of a text: what texts are shuffled and joined by, never the text itself."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def embed_distinct(texts: DataFrame, embed: Callable[[pd.Series], pd.Series], text_col: str = "text") -> DataFrame:
    """(key, vec) of every distinct text, each embedded once; nulls are left out.

    Texts meet by their key, and the table is checkpointed, so that several readers do
    not run the plug-in again."""
    checkpoint_root(texts.sparkSession)
    each = texts.where(F.col(text_col).isNotNull()).groupBy(text_key(text_col).alias("key")).agg(F.first(text_col).alias("text"))
    return embed_keyed(each, embed)


def embed_keyed(each: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(key, vec) of ``each`` (key, text), whose texts are distinct; checkpointed."""
    checkpoint_root(each.sparkSession)
    udf = F.pandas_udf(embed, "array<float>")
    return each.select("key", udf("text").alias("vec")).checkpoint()


def hashing_embed(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Deterministic stand-in embedder for tests: signed hashed character
    trigrams (vectorised with numpy), L2-normalised.  Not a model; it only
    makes similarity runs reproducible without model weights."""
    mult = np.array([2654435761, 40503, 2246822519], dtype=np.uint64)

    def one(t: str | None) -> list[float]:
        v = np.zeros(dim, dtype=np.float64)
        if t:
            cps = np.frombuffer(f"  {t.lower()}  ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            h = cps[:-2] * mult[0] + cps[1:-1] * mult[1] + cps[2:] * mult[2]
            h ^= h >> np.uint64(15)
            idx = (h % np.uint64(dim)).astype(np.int64)
            sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
            np.add.at(v, idx, sign)
            n = float(np.linalg.norm(v))
            if n > 0:
                v /= n
        return v.astype(np.float32).tolist()

    def embed(s: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in s])

    return embed


def letter_embed(letters: str) -> Callable[[pd.Series], pd.Series]:
    """Stand-in embedder that any engine can compute: how often each letter
    occurs in the text (lower case counts only)."""

    def embed(s: pd.Series) -> pd.Series:
        return pd.Series([[float(t.count(x)) for x in letters] for t in s], dtype=object)

    return embed


def letter_token_embed(letters: str) -> Callable[[pd.Series], pd.Series]:
    """The same per token: one vector of letter counts, each plus 1, for every word."""

    def embed(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [[1.0 + w.count(x) for x in letters] for w in t.split()] for t in s], dtype=object)

    return embed
