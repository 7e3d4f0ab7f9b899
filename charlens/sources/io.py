"""Sources and sinks.

Schemas are fixed at the edges; polymorphic JSON fields are read as VARIANT
and typed later with ``try_variant_get``.  Inside the system Parquet is the
format; CSV/JSON readers and writers exist for exchange with the outside.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Field names of the gold JSON Lines file and of the ';' predictions CSV, as
# the input formats define them: name, aliases, book.gutenberg_url,
# book.book_title, attributes; Book, Character, Output, Mentions_counter,
# Selected_passages.
GOLD_SCHEMA = (
    "name STRING, aliases VARIANT, "
    "book STRUCT<gutenberg_url: STRING, book_title: STRING>, attributes VARIANT"
)

PRED_SCHEMA = T.StructType([
    T.StructField("Book", T.StringType()),
    T.StructField("Character", T.StringType()),
    T.StructField("Output", T.StringType()),
    T.StructField("Mentions_counter", T.LongType()),
    T.StructField("Selected_passages", T.StringType()),
])
# ---------------------------------------------------------------------------


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A1: gold JSON Lines, one object per line; polymorphic fields as VARIANT."""
    return spark.read.schema(GOLD_SCHEMA).json(path)


def flatten_gold(gold: DataFrame, attrs: Mapping[str, str]) -> DataFrame:
    """B1: nested ``book`` and ``attributes`` to top-level columns; an absent
    key gives null.  ``attrs`` maps attribute name -> Spark type."""
    cols = [F.col("name"), F.col("aliases"), F.col("book.*")]
    cols += [F.try_variant_get(F.col("attributes"), f"$.{a}", t).alias(a) for a, t in attrs.items()]
    return gold.select(*cols)


def lower_columns(df: DataFrame) -> DataFrame:
    """B2: lower-case column names (Spark also resolves names case-insensitively)."""
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, *names: str) -> None:
    """B2: an unknown attribute is an error, not a silent null."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise KeyError(f"unknown column(s): {missing}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A2: ';'-separated predictions whose outputs hold newlines, ';' and
    doubled quotes; ``escape='"'`` keeps a quoted field in one row."""
    df = (spark.read.schema(PRED_SCHEMA)
          .option("header", True).option("sep", ";").option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    df = lower_columns(df)
    # JSON as it is (the reader takes single-quoted strings too); swapped quotes only where that fails
    raw = F.col("selected_passages")
    swapped = F.replace(raw, F.lit("'"), F.lit('"'))
    return df.withColumn("selected_passages", F.coalesce(F.from_json(raw, "array<string>"), F.from_json(swapped, "array<string>")))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """A3: comma CSV with header and an explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A4: a JSON array of documents (multiLine); JSON Lines when ``multiLine``
    is not needed."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """A5: statement dump ``(s, p, o, ...)`` stored as Parquet partitioned by
    ``p`` -- a pattern's filter on ``p`` prunes whole partitions."""
    return spark.read.parquet(path)


def write_statements(st: DataFrame, path: str, files: int = 8) -> None:
    """A5: each property in up to ``files`` files, dealt by the subject, so that no
    property is one task."""
    part = F.pmod(F.xxhash64("s"), F.lit(files))
    st.repartition("p", part).write.mode("overwrite").partitionBy("p").parquet(path)


def read_books(spark: SparkSession, path: str, url_prefix: str | None = None) -> DataFrame:
    """One book per file (``wholetext``) -> ``(url, text)``; the url is the
    file path (or ``url_prefix`` + file name).  A book that cannot be read
    simply has no row, so its characters drop out of the inner join."""
    df = spark.read.text(path, wholetext=True)
    src = F.input_file_name()
    url = F.concat(F.lit(url_prefix), F.substring_index(src, "/", -1)) if url_prefix else src
    return df.select(url.alias("url"), F.col("value").alias("text"))


#: characters of a chunk of a book
CHUNK_CHARS = 1 << 18


def _pieces(line: str, most: int) -> Iterator[str]:
    """The line in pieces of at most ``most`` characters, cut after white space (a longer run without any stays whole)."""
    at = 0
    while len(line) - at > most:
        blank = next((i for i in range(at + most, at, -1) if line[i - 1].isspace()), None)
        if blank is None:
            blank = next((i + 1 for i in range(at + most, len(line)) if line[i].isspace()), len(line))
        yield line[at:blank]
        at = blank
    yield line[at:]


def read_book_chunks(spark: SparkSession, path: str, url: Column | None = None, chunk_chars: int = CHUNK_CHARS,
                     line_sep: str = "\n") -> DataFrame:
    """A6 for books of any size: ``(url, chunk_no, text)``, a book as rows of at most
    about ``chunk_chars`` characters that rejoin in the order of ``chunk_no``.

    The text reader splits a file into byte ranges on its own, each read by its own
    task from line to line; lines are gathered into chunks, longer ones cut at white
    space, and a chunk is named by its file, the start of its byte range and its number
    therein.  A cell of the reader is one line: for books without line breaks give
    another ``line_sep``, such as a blank.  ``url`` names the book of a row, by default
    its file; with a column of the path (``book=.../``) a book can be many files, in
    the order of their names."""
    lines = spark.read.option("lineSep", line_sep).text(path)
    book = F.col("_metadata.file_path") if url is None else url
    rows = lines.select(book.cast("string").alias("url"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("start"), "value")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            name, file, start = of
            no = pa.array([{"file": file, "start": start, "number": number}], pa.struct([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([name]), no, pa.array([line_sep.join(held)])], ["url", "chunk_no", "text"])

        for batch in batches:
            for *key, line in zip(*(c.to_pylist() for c in batch.columns)):
                if key != of:
                    if held:
                        yield chunk()
                    of, number, held, size = key, 0, [], 0
                for piece in _pieces(line, chunk_chars):
                    if held and size + len(piece) > chunk_chars:
                        yield chunk()
                        number, held, size = number + 1, [], 0
                    held.append(piece)
                    size += len(piece) + 1
        if held:
            yield chunk()

    return rows.mapInArrow(gather, "url string, chunk_no struct<file: string, start: bigint, number: bigint>, text string")


def _textify(df: DataFrame) -> DataFrame:
    """Arrays/structs/maps/variants -> JSON text so CSV can hold them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.VariantType):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with header, no index column; nested values as JSON text."""
    (_textify(df).write.mode(mode).option("header", True).option("sep", sep)
     .option("quote", '"').option("escape", '"').csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).json(path)


def append_predictions(df: DataFrame, path: str, run_id: str, model: str | None = None,
                       strategy: str | None = None, attributes: list[str] | None = None,
                       batch: int | str | None = None) -> None:
    """A9 + A11: append predictions under ``run_id=...``; every task commits
    atomically, so a lost executor loses nothing that was committed and a
    re-run of a failed task does not duplicate rows.

    With ``batch``, the identity of a chunk within its run, the append is exactly once:
    the chunk has a folder of its own (``run_id=.../batch=...``) and a job that is run
    again puts its rows in the place of the first ones, whole or torn.  A table is
    written with batches throughout or without."""
    tagged = df.select(
        "*",
        F.lit(run_id).alias("run_id"),
        F.lit(model).cast("string").alias("model"),
        F.lit(strategy).cast("string").alias("strategy"),
        F.lit(",".join(attributes or [])).alias("attributes"),
    )
    if batch is None:
        tagged.write.mode("append").partitionBy("run_id").parquet(path)
        return
    (tagged.withColumn("batch", F.lit(str(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch").parquet(path))


def append_report(report: DataFrame, path: str) -> None:
    """A10: append report rows (with run identity) to the report table."""
    report.write.mode("append").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run's rows, by partition pruning on ``run_id``."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)
