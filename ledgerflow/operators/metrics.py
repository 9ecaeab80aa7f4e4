"""Aggregates of a ledger: totals under four definitions, breakdowns, series, shares, rankings.

Money is decimal until the output, which is double.  Ties are broken by name or by the first position in the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def credit() -> Column:
    return F.expr("direction = 'credit'")


def debit() -> Column:
    return F.expr("direction = 'debit'")


def amount() -> Column:
    return F.abs(F.coalesce(F.col("original_amount"), F.lit(0).cast("decimal(18,2)")))


def total(test: Column, value: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(test, amount() if value is None else value)), F.lit(0)).cast("double")


def category_name(missing: str) -> Column:
    return F.coalesce(F.expr("nullif(trim(category), '')"), F.lit(missing))


def merchant_name(missing: str = "Unknown merchant") -> Column:
    return F.coalesce(F.expr("nullif(trim(merchant), '')"), F.expr("nullif(trim(description_raw), '')"), F.lit(missing))


def spent() -> Column:
    return F.expr("direction = 'debit' and transaction_type <> 'transfer'")


def earned() -> Column:
    return F.expr("direction = 'credit' and transaction_type not in ('transfer', 'payment', 'refund')")


def analyzer_summary(ledger: DataFrame) -> DataFrame:
    """Income, expenses, transfers, refunds, net and count; income leaves out transfers, payments and refunds (AG1-6, AG10)."""
    signed = F.col("original_amount")
    out = ledger.agg(
        total(earned(), signed).alias("income"),
        total(spent(), signed).alias("expenses"),
        total(F.expr("transaction_type = 'transfer'"), signed).alias("transfers"),
        total(F.expr("transaction_type = 'refund'"), signed).alias("refunds"),
        F.count(F.lit(1)).alias("transactions"),
    )
    return out.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))


def dashboard_totals(ledger: DataFrame) -> DataFrame:
    """Per statement: on a card (any row of the statement says so) income is refunds and cashback and expenses purchases;
    else all credits and all others (AG11).  One aggregate: both readings are summed, the flag picks."""
    both = ledger.groupBy("statement_id").agg(
        F.bool_or(F.expr("statement_type = 'credit_card'")).alias("card"),
        total(F.expr("transaction_type in ('refund', 'cashback')")).alias("card_income"),
        total(F.expr("transaction_type = 'purchase'")).alias("card_expenses"),
        total(F.coalesce(credit(), F.lit(False))).alias("bank_income"),
        total(~F.coalesce(credit(), F.lit(False))).alias("bank_expenses"),
    )
    pick = lambda what: F.when(F.col("card"), F.col(f"card_{what}")).otherwise(F.col(f"bank_{what}"))
    out = both.select("statement_id", "card", pick("income").alias("income"), pick("expenses").alias("expenses"))
    return out.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))


def retrieval_totals(ledger: DataFrame) -> DataFrame:
    """Every credit against every debit (AG18)."""
    return ledger.agg(
        total(credit()).alias("income"),
        total(debit()).alias("expenses"),
        F.count_if("requires_review").alias("to_review"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )


def report_totals(ledger: DataFrame) -> DataFrame:
    """Credits against everything that is no credit (RP1)."""
    received = F.coalesce(credit(), F.lit(False))
    out = ledger.agg(total(received).alias("income"), total(~received).alias("expenses"))
    return out.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))


def spending_by(ledger: DataFrame, name: Column, alias: str, limit: int | None = None) -> DataFrame:
    """Spending (debits but transfers) by a name, largest first, ties by first position (AG7, AG8, TK1, TK2)."""
    out = ledger.filter(spent()).groupBy(name.alias(alias)).agg(F.sum("original_amount").cast("double").alias("spent"), F.min("position").alias("first_position"))
    if limit:
        out = out.filter("spent is not null").orderBy(F.desc("spent"), "first_position").limit(limit)
    return out


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """Income, expenses and net by month; a month whose rows are all left out is absent (AG9)."""
    kept = ledger.filter(F.col("transaction_date").isNotNull() & (spent() | earned()))
    out = kept.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(
        total(earned(), F.col("original_amount")).alias("income"), total(spent(), F.col("original_amount")).alias("expenses")
    )
    return out.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))


def by_category(ledger: DataFrame) -> DataFrame:
    """Debits by category: total, count, average, share of all debits in percent (AG12, AG19, AG24, AG29)."""
    groups = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category")).agg(F.sum(amount()).alias("s"), F.count(F.lit(1)).alias("transactions"))
    whole = F.sum("s").over(Window.partitionBy())  # one row per category by now
    return groups.select(
        "category",
        F.col("s").cast("double").alias("spent"),
        "transactions",
        F.round(F.col("s").cast("double") / F.col("transactions"), 2).alias("average"),
        F.round(100.0 * F.col("s").cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 2).alias("share"),
    )


def merchants_of_categories(ledger: DataFrame) -> DataFrame:
    """Debits by category and merchant with the share of the category in percent (AG22)."""
    groups = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category"), merchant_name().alias("name")).agg(
        F.sum(amount()).alias("s"), F.count(F.lit(1)).alias("transactions")
    )
    whole = F.sum("s").over(Window.partitionBy("category")).cast("double")
    return groups.select("category", "name", F.col("s").cast("double").alias("spent"), "transactions", F.round(100.0 * F.col("s").cast("double") / F.nullif(whole, F.lit(0.0)), 2).alias("share"))


def top_merchants_and_others(ledger: DataFrame, top: int = 5) -> DataFrame:
    """The largest merchants of each category and one row for all others (AG23)."""
    groups = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category"), merchant_name().alias("name")).agg(F.sum(amount()).alias("s"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("s"), "name"))
    named = groups.withColumn("name", F.when(rank <= top, F.col("name")).otherwise(F.lit("Others")))
    return named.groupBy("category", "name").agg(F.sum("s").cast("double").alias("spent"), F.count(F.lit(1)).alias("merchants"))


def monthly_by_category(ledger: DataFrame, last: int = 6) -> DataFrame:
    """Debits by category and month, the last months of each category (AG25)."""
    groups = ledger.filter(debit() & F.col("transaction_date").isNotNull()).groupBy(
        category_name("Uncategorized").alias("category"), F.trunc("transaction_date", "month").alias("month")
    )
    out = groups.agg(F.sum(amount()).cast("double").alias("spent"), F.count(F.lit(1)).alias("transactions"))
    return out.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("month")))).filter(F.col("r") <= last).drop("r")


def weekly_flow(ledger: DataFrame, last: int | None = None) -> DataFrame:
    """Received, spent and net by week from Monday (AG26-28, JN8): conditional sums, so both sides meet without a join."""
    week = F.date_trunc("week", "transaction_date").cast("date").alias("week")
    out = ledger.filter("transaction_date is not null").groupBy(week).agg(total(credit()).alias("received"), total(~F.coalesce(credit(), F.lit(False))).alias("spent"))
    out = out.withColumn("net", F.round(F.col("received") - F.col("spent"), 2))
    return out.orderBy(F.desc("week")).limit(last) if last else out


def repeated_merchants(ledger: DataFrame, limit: int = 8) -> DataFrame:
    """Merchants of two transactions or more, most frequent first (AG30, AG36)."""
    groups = ledger.groupBy(merchant_name().alias("name")).agg(F.count(F.lit(1)).alias("transactions"), F.sum(amount()).cast("double").alias("amount"))
    return groups.filter("transactions >= 2").orderBy(F.desc("transactions"), "name").limit(limit)


def insights(ledger: DataFrame) -> DataFrame:
    """Coverage of categories in percent and the largest and smallest category of debits (AG13, AG31)."""
    covered = ~F.lower(F.trim(F.coalesce("category", F.lit("")))).isin("", "unknown", "uncategorized", "other", "none", "null")
    groups = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category")).agg(
        F.sum(amount()).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("c")
    )
    known = ~F.lower("category").isin("unknown", "uncategorized", "other", "none", "null")
    rank = lambda sign: F.struct((F.col("s") * sign).alias("s"), F.col("category").alias("category"))
    out = groups.agg(
        F.round(100.0 * F.sum("c").cast("double") / F.sum("n").cast("double"), 1).alias("coverage"),
        F.min(F.when(known, rank(-1))).alias("top"),
        F.min(F.when(known, rank(1))).alias("least"),
        F.count_if(known).alias("categories"),
    )
    tenth = F.round(-F.col("top.s").cast("double") * 0.1, 2).alias("saving_of_a_tenth")
    least = F.when(F.col("categories") >= 2, F.col("least.category")).alias("least_category")
    return out.select("coverage", F.col("top.category").alias("top_category"), F.round(-F.col("top.s").cast("double"), 2).alias("top_spent"), tenth, least, "categories")


def modal_currency(ledger: DataFrame) -> DataFrame:
    """The most frequent currency of each statement, the first by name on ties, UNKNOWN without one (AG14, AG15)."""
    known = F.when(F.col("original_currency").isNotNull() & (F.col("original_currency") != "UNKNOWN"), F.col("original_currency"))
    counts = ledger.groupBy("statement_id", known.alias("currency")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("currency").isNotNull(), F.struct((-F.col("n")).alias("n"), "currency")))
    return counts.groupBy("statement_id").agg(F.coalesce(best["currency"], F.lit("UNKNOWN")).alias("currency"))


def largest(ledger: DataFrame, limit: int = 10, debits: bool = False) -> DataFrame:
    """The largest transactions by absolute amount, ties by position (AG35, TK3, TK6)."""
    rows = ledger.filter(debit()) if debits else ledger
    return rows.select("position", "statement_id", "transaction_date", amount().cast("double").alias("amount")).orderBy(F.desc("amount"), "position").limit(limit)


def smallest(ledger: DataFrame, limit: int = 5) -> DataFrame:
    """The smallest debits above zero (TK4)."""
    rows = ledger.filter(debit()).select("position", "statement_id", amount().cast("double").alias("amount")).filter("amount > 0")
    return rows.orderBy("amount", "position").limit(limit)


def smallest_merchant(ledger: DataFrame) -> DataFrame:
    """Per category, the merchant of the smallest positive total (TK10)."""
    totals = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category"), merchant_name().alias("name")).agg(F.sum(amount()).alias("s")).filter("s > 0")
    best = F.min(F.struct("s", "name"))
    return totals.groupBy("category").agg(best["name"].alias("name"), best["s"].cast("double").alias("spent"))


def category_distribution(ledger: DataFrame) -> DataFrame:
    """How many transactions a category has, most first (AG33)."""
    return ledger.groupBy(category_name("Uncategorized").alias("category")).agg(F.count(F.lit(1)).alias("transactions"))


def featured_categories(ledger: DataFrame, preferred: list[str], limit: int = 6) -> DataFrame:
    """Preferred categories first, in their order, then the others by amount (AG21)."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("category"))
    groups = ledger.filter(debit()).groupBy(category_name("Uncategorized").alias("category")).agg(F.sum(amount()).cast("double").alias("spent"))
    shown = groups.filter(~F.lower("category").isin("uncategorized", "other")).withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1)))
    return shown.orderBy("place", F.desc("spent"), "category").limit(limit).drop("place")


def pages(ledger: DataFrame, size: int = 29) -> DataFrame:
    """Page of each row in a statement's report: by date (nulls last), then merchant (TK7-9, WN7)."""
    order = Window.partitionBy("statement_id").orderBy(F.col("transaction_date").asc_nulls_last(), F.lower(merchant_name()), "position")
    row = F.row_number().over(order)
    return ledger.select("statement_id", "position", row.cast("long").alias("row"), (F.floor((row - 1) / size) + 1).cast("long").alias("page"))
