"""A corpus pipeline over ``documents``: drop toxic texts, drop near-duplicates, cut repeated passages, pack the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import minhash_dedup, suffix_dedup, toxicity
from ledgerflow.llm.queries import pack_documents
from ledgerflow.llm.runtime import table, table_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model, fitted on the labels of those at hand, scores below one half.

    Each row is scored by itself: repeated rows, and rows of one id, have one fate if their texts are equal.  A null or
    empty text and a null id stay; without labels of both classes all rows stay or go by the class there is, and
    without any all stay.  Texts are read whole; columns of any other name pass through; an empty table gives no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of each group of near-duplicates, of the smallest doc_id: five-word shingles, Jaccard similarity 0.8 or more.

    Rows stand or fall one by one, so of rows of one id with different texts only the duplicates go, also those of each
    other; of rows of one id and text, null ids included, one stays.  Other rows of a null id and rows without words stay.  Columns of any other
    name pass through; an empty table gives no rows.
    """
    gone = minhash_dedup.near_duplicates(docs, k=5, percent=80, with_row=True).filter("not first").select("row_hash").distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name of the table meets one used here
    row = F.xxhash64(F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}"))
    left = plain.withColumn("row_hash", row).join(gone, "row_hash", "left_anti").dropDuplicates(["row_hash"])
    return left.drop("row_hash").toDF(*names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document holds; ``n_chars`` follows the text.

    All rows stay; null texts stay null, a text of nothing but repeats becomes empty; a null id comes last.  Repeats
    between rows of one id are none.  Columns of any other name pass through; an empty table gives no rows.
    """
    left = suffix_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of all documents into sequences of 1024; a null text is empty, repeated rows are each packed,
    and an empty table gives no rows."""
    return pack_documents(spark, docs)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack_sequences)]

#: The stages are not expressible in SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
