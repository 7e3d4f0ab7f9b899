"""Chunks of documents and the shared checkpoint folder.

Corpus-wide lookups (which n-grams occur elsewhere, how often) go in three steps:
documents are dealt to chunks by a hash of their id; each chunk sends its distinct
keys, packed, to buckets of the key space; buckets answer each chunk about its own
keys.  Nothing is broadcast, a hot key costs one entry per chunk, and no task holds
more than a chunk or a bucket.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text per chunk, at most and at least
CHUNK_BYTES, LEAST_BYTES = 16 << 20, 2 << 20
#: rows of a few numbers that a partition holds before a second one is used
ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only for a local master without one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: results are computed once and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def gathered(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """Short rows, written once as Parquet and read again in as few partitions as hold ``rows`` each.

    Up to ``rows`` there is one partition, and as Spark knows the size of the files, it
    groups and joins such results among themselves without an exchange; a larger result
    keeps several, never more than its files give.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    return done.coalesce(max(1, -(-done.count() // rows)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES, per_partition: int = 2) -> int:
    """Chunks for a corpus by its bytes; down to ``LEAST_BYTES`` each to occupy the shuffle partitions."""
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    wide = min(per_partition * shuffle_partitions(docs.sparkSession), -(-total // LEAST_BYTES))
    return max(1, wide, -(-total // chunk_bytes))


def chunked(docs: DataFrame, chunks: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, doc_id, text): documents dealt by a hash of their id, one shuffle."""
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))


def bucket_bits(chunks: int) -> int:
    """Bits of a key that name its bucket: 8 at least, growing with the corpus."""
    return max(8, int(chunks).bit_length())


def pack(chunk: int, bits: int, key_bits: int, keys: np.ndarray, **cols: np.ndarray) -> pa.Table:
    """Rows (bucket, chunk, keys, ...) of sorted keys below ``2**key_bits``.

    The leading ``bits`` name the bucket.  The rest is kept as 4 bytes where it
    fits in them; other columns are packed beside the keys.
    """
    rest = key_bits - bits
    bounds = np.searchsorted(keys >> np.uint64(rest), np.arange((1 << bits) + 1, dtype=np.uint64))
    at = np.flatnonzero(np.diff(bounds))
    low = (keys & np.uint64((1 << rest) - 1)).astype(np.uint32 if rest <= 32 else np.uint64)
    out = {"bucket": pa.array(at, pa.int32()), "chunk": pa.array(np.full(len(at), chunk), pa.int32())}
    for name, v in {"keys": low, **cols}.items():
        out[name] = pa.array([v[bounds[b]:bounds[b + 1]].tobytes() for b in at], pa.binary())
    return pa.table(out)


def unpack(table: pa.Table, **cols) -> tuple[np.ndarray, ...]:
    """The packed columns joined over all rows, and for each entry its row."""
    parts = []
    length = None
    for name, kind in cols.items():
        blobs = [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        length = [len(b) for b in blobs] if length is None else length
        parts.append(np.concatenate(blobs) if blobs else np.zeros(0, kind))
    return (*parts, np.repeat(np.arange(table.num_rows), length or []))


def unpack_keys(table: pa.Table, bits: int, key_bits: int) -> np.ndarray:
    """Sorted whole keys of rows (bucket, keys), each bucket's keys sorted."""
    rest = key_bits - bits
    kind = np.uint32 if rest <= 32 else np.uint64
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist()))
    parts = [np.frombuffer(k, kind).astype(np.uint64) | np.uint64(b << rest) for b, k in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def answers(table: pa.Table, row: np.ndarray, **cols: np.ndarray) -> pa.Table:
    """Rows (chunk, bucket, ...) that carry each entry back to the chunk of its row.

    ``row`` (the row of ``table`` an entry came from) may be in any order; the
    order of a row's entries is kept.
    """
    order = np.argsort(row, kind="stable")
    row = row[order]
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(row))
    which = row[at]
    out = {"chunk": table.column("chunk").combine_chunks().take(pa.array(which)) if len(at) else pa.array([], pa.int32()),
           "bucket": table.column("bucket").combine_chunks().take(pa.array(which)) if len(at) else pa.array([], pa.int32())}
    for name, v in cols.items():
        v = v[order]
        out[name] = pa.array([v[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
    return pa.table(out)
