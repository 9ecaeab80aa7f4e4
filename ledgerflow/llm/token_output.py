"""Token ids of whole documents as Parquet list columns, in ascending doc_id order.

Layout of the files: ``ids`` is a list of int32 with dictionary pages (a vocabulary's ids are few), the other columns
are delta-encoded (data page version 2); row groups and pages have set sizes and carry column and offset indexes, so a
reader of some columns, documents or id ranges touches little else.  ``part`` and ``local_start`` (ids before the
document in its part) make every document's global start a sum with one number per part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.bpe import text_encoder
from ledgerflow.llm.runtime import shuffle_partitions

_STEP = 512
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}
COLUMNS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """A list<int32> array from the ids' bytes, without a copy per value."""
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int | None) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_id column, ids as little-endian uint32 bytes) in small steps; a null text is empty, ``end`` is appended."""
    encode = text_encoder(tokenizer).encode
    last = b"" if end is None else np.array([end], np.uint32).tobytes()
    for whole in batches:
        for low in range(0, whole.num_rows, _STEP):
            batch = whole.slice(low, _STEP)
            yield batch.column("doc_id"), [encode(t) + last for t in batch.column("text").to_pylist()]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files to ``path``.

    Rows are dealt by ranges of doc_id and sorted in each (nulls first; equal ids by text), then encoded, so only texts
    are shuffled.  A null or empty text has only the end id.  Repeated rows are written as often as they occur; other
    columns are not read; an empty table gives files without rows.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for ids, found in encode_batches(batches, tokenizer, end):
            sizes = np.array([len(b) // 4 for b in found], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), pa.array(sizes), id_lists(found)],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )

    ordered.mapInArrow(encode, COLUMNS).write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files with each document's global ``start``: one number per part is summed and broadcast, not per row."""
    files = spark.read.schema(COLUMNS).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # as many rows as files
    rows, before = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "part int, part_start long")
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(df: DataFrame, column: str = "ids") -> DataFrame:
    """Replace the list ``column`` by ``ids_crc32``: the unsigned crc32 of its ids as little-endian uint32."""
    keep = [f for f in df.schema.fields if f.name != column]
    names = [f.name for f in keep]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy()).view(np.uint8))
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", ids_crc32 long"
    return df.mapInArrow(digest, schema)
