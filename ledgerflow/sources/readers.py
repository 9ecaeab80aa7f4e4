"""Sources: CSV and JSON ledgers, page texts, positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.canonical import RAW_ROWS
from ledgerflow.operators.layout import WORDS
from ledgerflow.sources.restore import backup_lines, restored


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw statement rows of CSV files with a header; malformed lines are left out, all values stay text."""
    return spark.read.options(header=True, mode="DROPMALFORMED", enforceSchema=False).schema(RAW_ROWS).csv(path)


def json_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger backup; ``restore.rejected`` has the records that do not fit, and why (SNK2)."""
    return restored(backup_lines(spark, path))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of text files, pages parted by form feeds: doc_id, page_number, text, has_text (SRC1-2, SRC9)."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), "value")
    pages = files.select("doc_id", F.posexplode(F.split("value", "\f")).alias("n", "text"))
    return pages.select("doc_id", (F.col("n") + 1).alias("page_number"), "text", (F.length(F.trim("text")) > 0).alias("has_text"))


def words(spark: SparkSession, path: str, least_confidence: float | None = None) -> DataFrame:
    """Positioned words of Parquet files; blanks and impossible boxes are left out, and words read with less confidence
    than asked for (SRC3, SRC7-8, SRC14)."""
    rows = spark.read.parquet(path)
    if least_confidence is not None and "confidence" in rows.columns:
        rows = rows.filter(F.col("confidence") >= least_confidence)
    names = [c.split()[0] for c in WORDS.split(", ")]
    return rows.select(*names).filter("nullif(trim(text), '') is not null and x1 >= x0 and bottom >= top")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of HTML pages as page texts."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", "\n")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), plain.alias("text"))
