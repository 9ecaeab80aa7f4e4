"""From raw statement rows to the canonical ledger, and its projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import classify, text, values
from ledgerflow.functions.dialect import SPARK as S

RAW_ROWS = (
    "statement_id string, page_number int, position long, transaction_date string, posting_date string, value_date string, description string, amount string,"
    " debit string, credit string, balance string, transaction_id string, source_file string"
)

#: Weights of what a raw row has, added to 0.50.
EXTRACTION_WEIGHTS = [
    ("transaction_date", 10), ("posting_date", 5), ("value_date", 5), ("description", 10), ("amount", 10), ("coalesce(debit, credit)", 10), ("transaction_id", 5), ("balance", 5),
]


def normalised_merchants(rows: DataFrame, description: str = "description_raw") -> DataFrame:
    """Add ``merchant_name`` and ``merchant_score`` (TXT3-5); each step is a projection of its own, which Catalyst merges."""
    names = rows.columns
    for name, expression in text.merchant_columns(S, description):
        rows = rows.withColumn(name, F.expr(expression))
    return rows.select(*names, "merchant_name", "merchant_score")


def extraction_confidence() -> Column:
    """ETL15, in hundredths so that it is exact."""
    points = sum((F.when(F.expr(f"nullif(trim({name}), '') is not null"), w).otherwise(0) for name, w in EXTRACTION_WEIGHTS), F.lit(50))
    return F.least(points, F.lit(100)).cast("double") / 100


def build_ledger(raw: DataFrame, currency: str = "UNKNOWN", statement_type: str = "unknown") -> DataFrame:
    """The ledger of raw rows (``RAW_ROWS``): ids, dates, amounts, direction, type, channel, merchant, confidence (ETL2-15, ETL17).

    A row without a date, an amount, or both a description and an id is no transaction; ids count raw rows, dropped ones
    included.  A date without a year takes the first year printed in the statement's dates.
    Dates and amounts are worked out below the window that counts, so the rows are chosen by their values: above a plain
    projection the optimiser would write the rules out once more in the filter.  Only rows that stay get the other fields.
    Where ``raw`` has ``statement_currency`` or ``statement_kind``, they go before the arguments (ETL9-10).
    """
    order = Window.partitionBy("statement_id").orderBy("position")
    known = lambda c, other: F.coalesce(F.expr(f"nullif(trim({c}), '')"), F.lit(other)) if c in raw.columns else F.lit(other)
    printed = F.expr(f"try_cast(nullif({S.extracted('transaction_date', r'(?:19|20)[0-9]{2}')}, '') as int)")
    year = F.first(printed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = raw.withColumn("_year", year).withColumn("transaction_id", F.coalesce(F.expr("nullif(trim(transaction_id), '')")))
    for name in ("transaction_date", "posting_date", "value_date"):
        rows = rows.withColumn(f"_{name}", F.expr(values.parsed_date(S, name, "_year")))
    for name in ("amount", "debit", "credit", "balance"):
        rows = rows.withColumn(f"_{name}", F.expr(values.signed_decimal(S, name)))
    description = F.coalesce(F.expr("nullif(trim(description), '')"), F.lit(""))
    rows = rows.withColumn("description_raw", description).withColumn("_dated", F.coalesce("_transaction_date", "_value_date", "_posting_date"))
    rows = rows.withColumn("_posted", F.coalesce("_posting_date", "_value_date")).withColumn("_value", F.abs(F.coalesce("_debit", "_credit", "_amount")))
    rows = rows.withColumn("_side", F.when(F.col("_debit").isNotNull(), "debit").when(F.col("_credit").isNotNull(), "credit")).withColumn("_n", F.row_number().over(order))
    whole = F.col("_dated").isNotNull() & F.col("_value").isNotNull() & ((F.col("description_raw") != "") | F.col("transaction_id").isNotNull())
    # all rows are counted from 1: naming the count keeps its window where ids are not asked for
    rows = rows.filter((F.col("_n") > 0) & whole & ~F.expr(classify.is_metadata(S, "description_raw")))
    reward = F.expr(classify.transaction_type(S, "description_raw", "'debit'")) == "cashback"
    direction = (
        F.when(reward, "credit").when(F.col("_side").isNotNull(), F.col("_side"))
        .when(F.expr(values.marked_credit(S, "amount")), "credit").otherwise(F.expr(classify.direction(S, "concat(' ', description_raw, ' ')")))
    )
    rows = rows.withColumn("direction", direction)
    return normalised_merchants(rows).select(
        "statement_id",
        "position",
        F.format_string("TXN-%06d", "_n").alias("transaction_id"),
        F.col("_dated").alias("transaction_date"),
        F.col("_posted").alias("posting_date"),
        "description_raw",
        F.col("merchant_name").alias("merchant"),
        F.col("_value").alias("original_amount"),
        known("statement_currency", currency).alias("original_currency"),
        "direction",
        F.expr(classify.transaction_type(S, "description_raw", "direction")).alias("transaction_type"),
        known("statement_kind", statement_type).alias("statement_type"),
        F.expr(classify.channel(S, "description_raw")).alias("transaction_channel"),
        F.col("_balance").alias("running_balance"),
        F.col("transaction_id").alias("bank_transaction_id"),
        extraction_confidence().alias("extraction_confidence"),
        F.col("merchant_score").alias("merchant_confidence"),
        "source_file",
        F.col("page_number").alias("source_page"),
    )


def display_rows(ledger: DataFrame) -> DataFrame:
    """The ten columns of the transaction table (PRJ1-2)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ledger.select(
        "position",
        blank("transaction_date").alias("date"),
        blank("merchant").alias("merchant"),
        blank("description_raw").alias("description"),
        F.coalesce(F.expr("nullif(category, '')"), F.lit("Uncategorized")).alias("category"),
        F.coalesce(F.col("original_amount").cast("double"), F.lit(0.0)).alias("amount"),
        blank("original_currency").alias("currency"),
        blank("direction").alias("direction"),
        F.round(100 * F.coalesce("extraction_confidence", F.lit(0.0)), 1).alias("confidence"),
        F.col("requires_review").alias("review"),
    )


def search(ledger: DataFrame, words: str = "", direction: str | None = None, category: str | None = None, review: bool | None = None, pattern: bool = False) -> DataFrame:
    """Rows whose merchant or description contains ``words`` in any case, as a text or as a ``pattern`` (a regular
    expression), with equal direction, category, status (FLT1-4, FLT8)."""
    rows = ledger
    if words and pattern:
        found = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(f"(?iu){words}")
        rows = rows.filter(found("merchant") | found("description_raw"))
    elif words:
        low = F.lit(words.lower())
        rows = rows.filter(F.contains(F.lower(F.coalesce("merchant", F.lit(""))), low) | F.contains(F.lower(F.coalesce("description_raw", F.lit(""))), low))
    if direction:
        rows = rows.filter(F.lower("direction") == direction)
    if category:
        rows = rows.filter(F.coalesce(F.expr("nullif(category, '')"), F.lit("Uncategorized")) == category)
    if review is not None:
        rows = rows.filter(F.col("requires_review") == review)
    return rows


def focus(ledger: DataFrame, kind: str, value: str) -> DataFrame:
    """Rows of one category or one merchant, in any case; marks before the first letter or digit of a merchant do not count
    (FLT5).  An empty value or another kind keeps all rows."""
    if kind == "category" and value:
        return ledger.filter(F.lower(F.coalesce(F.expr("nullif(category, '')"), F.lit("Uncategorized"))) == value.lower())
    if kind == "merchant" and value:
        plain = F.lower(F.trim(F.regexp_replace(F.coalesce("merchant", F.lit("")), r"(?U)^[^\w]+", "")))
        return ledger.filter(plain == value.lstrip(" :;,-").lower().strip())
    return ledger


def editor_search(ledger: DataFrame, words: str) -> DataFrame:
    """Rows whose merchant, description or transaction id contains ``words`` in any case; blank words keep all rows (FLT7)."""
    low = words.strip().lower()
    if not low:
        return ledger
    names = ("merchant", "description_raw", "transaction_id")
    return ledger.filter(F.contains(F.lower(F.concat_ws("\n", *(F.col(c).cast("string") for c in names))), F.lit(low)))


def review_queue(ledger: DataFrame) -> DataFrame:
    """Rows marked for review or without a real category (FLT6, FLT9)."""
    return ledger.filter(F.col("requires_review") | F.lower(F.trim(F.coalesce("category", F.lit("")))).isin("", "other", "uncategorized", "unknown"))
