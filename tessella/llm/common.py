"""Helpers that several corpus operators share: the shared scratch folder, word splitting on Arrow
buffers, and connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder (a folder for each value of `by`) and reads it again, so
    that lost executors cost no recomputation of what led to it and later steps see its true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile passes rows to Python about `most` bytes at a time (one row at least). By default it is 10,000 rows,
    of which the JVM holds two copies and the worker two batches: over 30 MB each for texts of 3 KB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc32_sql(digits: str) -> str:
    """DuckDB for the crc32 of a text of ASCII characters."""
    bits = "list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, b))"
    return f"xor(4294967295::bigint, list_reduce(list_transform(string_split({digits}, ''), lambda s: ascii(s)::bigint), lambda crc, b: {bits}, 4294967295::bigint))"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the text column of each part has about `most` bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


#: Byte classes for splitting: 0 white space (\x20 \x09-\x0D), 1 anything else.
WHITE = np.ones(256, np.uint8)
WHITE[[0x20, 9, 10, 11, 12, 13]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def split_words(data: np.ndarray, off: np.ndarray, kinds: np.ndarray = WHITE) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows one after another, and how many each row has. A word is a run of bytes of one
    kind; kind 0 separates, and where kinds has 3 (joins with any neighbour) no word ends."""
    k = kinds[data]
    cut = np.ones(len(k) + 1, bool)
    if len(k):
        a, b = k[:-1], k[1:]
        cut[1:-1] = (a != b) & ((a == 0) | (b == 0) | ((a != 3) & (b != 3)))
        cut[off[(off > 0) & (off < len(k))]] = True
    solid = k > 0
    where = np.flatnonzero(cut[:-1] & solid)
    size = np.flatnonzero(cut[1:] & solid) + 1 - where
    ends = np.append(0, np.cumsum(size))
    words = pa.Array.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    return words, np.diff(np.searchsorted(where, off))


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of an edge table (a, b): component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their roots and
    contracts the edges; the pointers of all rounds are composed at the end. Rounds and pointer steps
    are logarithmic, nothing but a row count reaches the driver, and each round is kept in the
    shared folder."""
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("u", "v")
        p = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        while True:
            q = p.toDF("u2", "p2")
            p = materialise(p.join(q, F.col("p") == F.col("u2"), "left").select("u", F.coalesce("p2", "p").alias("p"), (F.coalesce("p2", "p") != F.col("p")).alias("moved")), "parents")
            moved = not p.where("moved").isEmpty()
            p = p.select("u", "p")
            if not moved:
                break
        rounds.append(p)
        for side in ("a", "b"):
            e = e.join(p.toDF("u", "p"), F.col(side) == F.col("u")).withColumn(side, F.col("p")).select("a", "b")
        e = materialise(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = rounds[-1]
    for p in reversed(rounds[:-1]):
        label = p.join(label.toDF("u2", "p2"), F.col("p") == F.col("u2"), "left").select("u", F.coalesce("p2", "p").alias("p"))
    return label.toDF("id", "component")
