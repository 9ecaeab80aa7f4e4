"""Tables of the reports and of the overview export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators import metrics


def overview_export(ledger: DataFrame, currency: str = "AED") -> DataFrame:
    """Summary rows and category rows in one table: section, item, amount, percentage, currency (SNK7)."""
    totals = metrics.report_totals(ledger)
    summary = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).alias("amount")) for n, c in (("Income", "income"), ("Expenses", "expenses"), ("Net", "net"))])).alias("r"))
    rows = summary.select(F.lit("Summary").alias("section"), "r.item", "r.amount", F.lit(None).cast("double").alias("percentage"))
    groups = metrics.by_category(ledger).select(F.lit("Category").alias("section"), F.col("category").alias("item"), F.col("spent").alias("amount"), F.col("share").alias("percentage"))
    return rows.unionByName(groups).withColumn("currency", F.lit(currency))


def merchant_concentration(ledger: DataFrame, limit: int = 12) -> DataFrame:
    """The largest merchants with their share of all that is no credit, in percent (RP4)."""
    rows = ledger.filter(~F.coalesce(metrics.credit(), F.lit(False)))
    groups = rows.groupBy(metrics.merchant_name().alias("name")).agg(F.sum(metrics.amount()).alias("s"), F.count(F.lit(1)).alias("transactions"))
    total = rows.agg(F.sum(metrics.amount()).cast("double").alias("t"))
    top = groups.orderBy(F.desc("s"), "name").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("name", F.col("s").cast("double").alias("spent"), "transactions", F.round(100.0 * F.col("s").cast("double") / F.nullif("t", F.lit(0.0)), 2).alias("share"))


def signals(ledger: DataFrame) -> DataFrame:
    """Counts that a report points out (RP5)."""
    return ledger.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if("requires_review").alias("to_review"),
        F.count_if(F.expr("nullif(trim(category), '') is null")).alias("without_category"),
        F.count_if(F.col("transaction_date").isNull()).alias("without_date"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )


def ranked_rows(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """Per statement the largest rows with the width of their bars against the largest (WN7)."""
    w = Window.partitionBy("statement_id")
    size = metrics.amount().cast("double")
    rank = F.row_number().over(w.orderBy(F.desc("amount"), "position"))
    rows = ledger.select("statement_id", "position", size.alias("amount"))
    return rows.withColumn("rank", rank).withColumn("width", F.round(F.col("amount") / F.nullif(F.max("amount").over(w), F.lit(0.0)), 4)).filter(F.col("rank") <= limit)
