"""Page texts to a validated ledger with categories, in one plan (ETL1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import canonical, layout, memory, validate


def ledger_of_pages(pages: DataFrame) -> DataFrame:
    """The ledger of text statements (doc_id, page_number, text): rows of all pages with their statement's kind and currency,
    a category by rule, and the issues that validation finds.

    Pages meet their document's metadata by id, so nothing of a statement but its rows is in one place.  A document
    without a transaction line has no rows; a null text is an empty page.
    """
    kinds = layout.document_metadata(pages).select("doc_id", F.col("statement_type").alias("statement_kind"), F.col("currency").alias("statement_currency"))
    raw = layout.raw_text_rows(pages).join(kinds.withColumnRenamed("doc_id", "statement_id"), "statement_id")
    ledger = canonical.build_ledger(raw).withColumn("exchange_rate", F.lit(None).cast("decimal(18,8)")).withColumn("statement_amount", F.col("original_amount"))
    kept = tuple(c for c in ledger.columns if c not in ("statement_id", "position"))
    return memory.classified(validate.issues(ledger, kept))
