"""Validation: issues, confidence, running balance, duplicates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ledgerflow.functions.vocabulary import ISSUES, UNKNOWN_CURRENCIES

def _order() -> WindowSpec:
    return Window.partitionBy("statement_id").orderBy("position")


def duplicate_key() -> Column:
    """Statement, date, amount, direction and merchant (else description) of a row (WN3)."""
    name = F.upper(F.trim(F.coalesce(F.expr("nullif(merchant, '')"), "description_raw", F.lit(""))))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", part("transaction_date"), part("original_amount"), part("direction"), name)


def duplicates(ledger: DataFrame) -> DataFrame:
    """Add ``duplicate``: an earlier row of the statement has the same key; the first is none (WN2)."""
    row = F.row_number().over(Window.partitionBy("statement_id", "_key").orderBy("position"))
    return ledger.withColumn("_key", duplicate_key()).withColumn("duplicate", row > 1).drop("_key")


def balance_mismatch(ledger: DataFrame) -> DataFrame:
    """Add ``mismatch``: the printed balance is not the previous one moved by the amount, within 0.01 (WN1)."""
    signed = F.expr("case when direction = 'debit' then -abs(original_amount) when direction = 'credit' then abs(original_amount) end")
    off = F.abs(F.col("running_balance") - (F.lag("running_balance").over(_order()) + signed)) > F.lit(0.01).cast("decimal(18,2)")
    return ledger.withColumn("mismatch", F.coalesce(off, F.lit(False)))


def issue_tests() -> dict[str, Column]:
    known = F.upper(F.trim("original_currency"))
    shown = F.trim(F.coalesce("description_raw", F.lit("")))
    tests = {
        "MISSING_TRANSACTION_DATE": F.col("transaction_date").isNull(),
        "POSTING_DATE_BEFORE_TRANSACTION_DATE": F.col("posting_date") < F.col("transaction_date"),
        "MISSING_AMOUNT": F.col("original_amount").isNull(),
        "NEGATIVE_NORMALIZED_AMOUNT": F.col("original_amount") < 0,
        "ZERO_AMOUNT": F.col("original_amount") == 0,
        "MISSING_CURRENCY": F.coalesce("original_currency", F.lit("")) == "",
        "UNKNOWN_CURRENCY": known.isin(*UNKNOWN_CURRENCIES),
        "MISSING_DESCRIPTION": shown == "",
        "SHORT_DESCRIPTION": (F.length(shown) > 0) & (F.length(shown) < 3),
        "MISSING_DIRECTION": F.col("direction").isNull(),
        "AMOUNT_MISMATCH": F.col("exchange_rate").isNull() & (F.abs("statement_amount") != F.abs("original_amount")),
        "BALANCE_MISMATCH": F.col("mismatch"),
        "POSSIBLE_DUPLICATE": F.col("duplicate"),
    }
    assert list(tests) == list(ISSUES)
    return tests


def issues(ledger: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: issue codes in order, errors, warnings, confidence, whether valid, whether to review, and notes (VAL1-10).

    ``ledger`` has ``running_balance``; columns named in ``keep`` stay.  Both windows run on one shuffle by statement; the duplicate key only refines it."""
    checked = balance_mismatch(duplicates(ledger))
    code = lambda c, t: F.when(t, F.lit(c))
    found = F.array_compact(F.array(*[code(c, t) for c, t in issue_tests().items()]))
    errors = [c for c, (severity, _) in ISSUES.items() if severity == "error"]
    rows = checked.withColumn("codes", found).withColumn("errors", F.size(F.array_intersect("codes", F.array(*[F.lit(e) for e in errors]))))
    rows = rows.withColumn("warnings", F.size("codes") - F.col("errors"))
    base = F.coalesce("extraction_confidence", F.lit(0.5))
    mixed = F.when(F.col("merchant_confidence").isNotNull(), base * 0.8 + F.col("merchant_confidence") * 0.2).otherwise(base)
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed - 0.2 * F.col("errors") - 0.05 * F.col("warnings"))), 4)
    notes = F.array_join(F.transform("codes", lambda c: F.concat(c, F.lit(": "), F.element_at(F.create_map(*[F.lit(x) for c, (_, m) in ISSUES.items() for x in (c, m)]), c))), " | ")
    return rows.withColumn("confidence", confidence).select(
        "statement_id", "position", *keep, F.array_join("codes", ",").alias("codes"), "errors", "warnings", "confidence",
        (F.col("errors") == 0).alias("valid"), ((F.col("errors") > 0) | (F.col("warnings") > 0) | (F.col("confidence") < 0.85)).alias("review"), notes.alias("notes"),
    )


def reconciliation(ledger: DataFrame, opening: float = 0.0) -> DataFrame:
    """Per statement: opening balance plus net against the last printed balance (VAL11, VAL12)."""
    signed = F.expr("case when direction = 'credit' then abs(original_amount) else -abs(original_amount) end")
    out = ledger.groupBy("statement_id").agg(
        F.coalesce(F.sum(signed), F.lit(0).cast("decimal(18,2)")).alias("net"),
        F.max_by("running_balance", F.when(F.col("running_balance").isNotNull(), F.col("position"))).alias("closing"),
    )
    expected = (F.lit(opening).cast("decimal(18,2)") + F.col("net")).alias("expected")
    out = out.select("statement_id", expected, F.coalesce("closing", F.lit(opening).cast("decimal(18,2)") + F.col("net")).alias("closing"))
    difference = F.col("closing") - F.col("expected")
    return out.select(
        "statement_id", F.col("expected").cast("double").alias("expected"), F.col("closing").cast("double").alias("closing"), difference.cast("double").alias("difference"), (F.abs(difference) < 0.01).alias("matches")
    )


def derived_balance(ledger: DataFrame, opening: float = 0.0) -> DataFrame:
    """A running balance from the opening one and the movements, where none is printed (WN5)."""
    signed = F.expr("coalesce(case when direction = 'credit' then abs(original_amount) else -abs(original_amount) end, 0)")
    running = F.sum(signed).over(_order().rowsBetween(Window.unboundedPreceding, 0)) + F.lit(opening).cast("decimal(18,2)")
    return ledger.withColumn("derived_balance", running.cast("decimal(18,2)"))


def card_snapshot(statements: DataFrame) -> DataFrame:
    """Used part of each card's limit in percent and what is derived from it (VAL13, RP2).

    ``statements``: statement_id, card_limit, available_limit, current_balance, any of which may be null."""
    used = F.coalesce("current_balance", F.col("card_limit") - F.col("available_limit"))
    free = F.coalesce("available_limit", F.col("card_limit") - F.col("current_balance"))
    return statements.select("statement_id", used.cast("double").alias("used"), free.cast("double").alias("available"), F.round(100.0 * used.cast("double") / F.nullif(F.col("card_limit").cast("double"), F.lit(0.0)), 1).alias("utilisation"))
