"""A4: one large JSON array of documents, read by many tasks.

Spark's JSON reader takes a file of one array as one record, in one task.  Here the text
reader cuts the file into byte ranges by itself, its rows ending at each ``}`` (in any
store that Spark reads).  Where a range starts inside the array, and whether inside a
string, is not known to its task, so three steps follow:

  1. each range is summed up for both cases, started outside a string and inside one:
     by how much the depth changes, how low it gets, and where it ends;
  2. the short sums of a file, a row per range, are composed in order, which gives every
     range its true start and the range in which the document open there began;
  3. the ranges are read again from their true starts.  Documents that lie in one range
     come out whole; pieces of one that spans several meet by the range it began in.

No task holds more than its range and one document.  What is broadcast is one short row
per range.  Elements of the array that are not objects are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a string, to its end or to the end of the text, or a bracket
_MARK = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(")?|[{}\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def marks(text: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """(place, +1 or -1) of the brackets outside strings, and whether the text ends inside a
    string; ``inside``: it starts in one."""
    at, found = 0, []
    if inside:
        rest = _REST.match(text)
        if rest is None:
            return found, True
        at = rest.end()
    for m in _MARK.finditer(text, at):
        if m[0][0] != '"':
            found.append((m.start(), 1 if m[0] in "{[" else -1))
        elif m[1] is None:
            return found, True
    return found, False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator[str]]]:
    """(key, text) row by row: the key is all but the last column, the text ends with its ``}``."""
    for batch in batches:
        for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
            yield key, text + "}"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: a row per range, with (change, low, ends inside a string) for both starts."""
    names = ["file", "start", *(f"{n}{h}" for h in (0, 1) for n in ("change", "low", "inside"))]
    of, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, [*of, *state[0], *state[1]]))], schema=pa.schema(
            [("file", pa.string()), ("start", pa.int64()), *((f"{n}{h}", t) for h in (0, 1) for n, t in (("change", pa.int64()), ("low", pa.int64()), ("inside", pa.bool_())))]))

    for key, text in _ranges(batches):
        if key != of:
            if of is not None:
                yield row()
            of, state = key, [[0, 0, False], [0, 0, True]]
        for s in state:
            found, s[2] = marks(text, s[2])
            for _, step in found:
                s[0] += step
                s[1] = min(s[1], s[0])
    if of is not None:
        yield row()


def composed(ranges: pa.Table) -> pa.Table:
    """Step 2: for each range of a file its depth and string state at the start, and the start
    of the range in which the document that is open there began."""
    out, depth, inside, since = [], 0, False, None
    for r in sorted(ranges.to_pylist(), key=lambda r: r["start"]):
        out.append({"file": r["file"], "start": r["start"], "depth": depth, "inside": inside, "since": since})
        h = int(inside)
        closed = depth < 2 or depth + r[f"low{h}"] < 2
        depth, inside = depth + r[f"change{h}"], r[f"inside{h}"]
        since = None if depth < 2 else r["start"] if closed else since
    return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("depth", pa.int64()), ("inside", pa.bool_()), ("since", pa.int64())]))


_PIECES = pa.schema([("file", pa.string()), ("since", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("json", pa.string())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: whole documents, and pieces of those that span ranges."""
    of, depth, inside, since, held = None, 0, False, None, []

    def piece(whole: bool) -> pa.RecordBatch:
        text = "".join(held)
        held.clear()
        return pa.RecordBatch.from_pylist([{"file": of[0], "since": since if since is not None else of[1], "start": of[1], "whole": whole, "json": text}], schema=_PIECES)

    for (file, start, *at_start), text in _ranges(batches):
        if [file, start] != of:
            if held:
                yield piece(False)
            of, (depth, inside, since) = [file, start], at_start
        opened = 0 if depth >= 2 else None
        found, inside = marks(text, inside)
        for at, step in found:
            depth += step
            if step > 0 and depth == 2 and text[at] == "{":
                opened, since = at, None
            elif step < 0 and depth == 1 and opened is not None:
                held.append(text[opened:at + 1])
                yield piece(since is None or since == start)
                opened, since = None, None
        if opened is not None:
            held.append(text[opened:])
    if held:
        yield piece(False)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The documents of JSON arrays in the files of ``path``, one row each, by ``schema``."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    sums = ", ".join(f"change{h} long, low{h} long, inside{h} boolean" for h in (0, 1))
    starts = rows.mapInArrow(_sums, f"file string, start long, {sums}").groupBy("file").applyInArrow(
        composed, "file string, start long, depth long, inside boolean, since long")
    # one short row per byte range; the rows of a range keep their order in a broadcast join
    known = rows.join(F.broadcast(starts), ["file", "start"]).select("file", "start", "depth", "inside", "since", "value")
    pieces = known.mapInArrow(_documents, "file string, since long, start long, whole boolean, json string")
    torn = pieces.where("not whole").groupBy("file", "since").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "json"))), lambda p: p["json"]), "").alias("json"))
    texts = pieces.where("whole").select("json").unionByName(torn.select("json"))
    return texts.select(F.from_json("json", schema).alias("d")).select("d.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one array a file, a document a line."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield line(["["])
        last: list[str] = []
        for batch in batches:
            texts = last + batch.column(0).to_pylist()
            last = texts[-1:]
            yield line([t + "," for t in texts[:-1]])
        yield line([*last, "]"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(lines, "value string").write.text(path)
