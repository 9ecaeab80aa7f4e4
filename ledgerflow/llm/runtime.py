"""Shared plumbing of the training-data operators: shared storage, lineage cuts, streams of grouped Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a local one on a local
    master, as in tests, and an error on any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="ledgerflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_root(spark)}/ledgerflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back, for loops of joins: what follows is planned by the size of the files.

    A checkpoint keeps the size that Spark estimated before it, and a join multiplies those of its sides, so in a loop that
    number itself grows, fourfold in length with each round, until the driver has neither time nor memory for it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that one portion of documents holds, at most by half again.
PORTION_BYTES = 64 << 20


def portions_of(docs: DataFrame) -> int:
    """How many portions to deal ``docs`` (text) in: as many as shuffle partitions, more where texts are more than 64 MiB each."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).collect()[0]["size"] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // PORTION_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def rows_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut a stream sorted by ``keys`` into tables that hold whole groups (several groups each)."""
    held: list[pa.RecordBatch] = []

    def change(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            out |= v[1:] != v[:-1]
        return np.flatnonzero(out) + 1

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        at = change(batch)
        if len(at):
            held.append(batch.slice(0, at[-1]))
            yield pa.Table.from_batches(held)
            held = [batch.slice(at[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


#: Bits of the membership filter; its size is fixed, so a large membership only lets more rows through.
FILTER_BITS = 1 << 23
_BUCKET = 8 * 4096


def membership_filter(ids: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A fixed-size (1 MB) filter without false negatives over ``column``; takes positions made by ``filter_position``."""
    at = filter_position(F.col(column))
    rows = (
        ids.select(at.alias("p"))
        .groupBy(F.floor(F.col("p") / _BUCKET).cast("int").alias("b"))
        .agg(F.bitmap_construct_agg((F.col("p") % _BUCKET)).alias("m"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits[r["b"] * 4096 : r["b"] * 4096 + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits.tobytes())

    def test(positions: np.ndarray) -> np.ndarray:
        table = np.frombuffer(shared.value, np.uint8)
        return (table[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1

    return test


def filter_position(column):
    """Ids and hashes alike are spread by their remainder, which numpy computes as well."""
    return F.pmod(column, F.lit(FILTER_BITS))
