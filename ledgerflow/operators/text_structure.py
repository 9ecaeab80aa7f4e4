"""The header of a statement found in page texts alone, without positions of words (STR24-31).

Every four adjacent lines of a page that are not blank are a candidate; its score counts the fields that it names.
Pages are shuffled once, by document; windows are made, scored and compared within a page's row, so only the best one of a
page is ever sorted.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases of a header and the field each names; of phrases of one length the earlier one comes first.
DATE_PHRASES = [
    ("Post Date", "posting_date"), ("Posting Date", "posting_date"), ("Transaction Date", "transaction_date"), ("Trxn. Date", "transaction_date"), ("Trxn Date", "transaction_date"),
    ("Txn Date", "transaction_date"), ("Trans Date", "transaction_date"), ("Value Date", "value_date"), ("Effective Date", "value_date"), ("Booking Date", "transaction_date"),
    ("Entry Date", "transaction_date"), ("Process Date", "transaction_date"), ("Date", "transaction_date"),
]
OTHERS = {
    "description": [
        "Transaction Description", "Transaction Details", "Particulars", "Description", "Narration", "Details", "Remarks", "Merchant", "Payee",
        "Beneficiary", "Memo",
    ],
    "amount": ["Transaction Amount", "Amount", "Value"],
    "debit": ["Withdrawals", "Withdrawal", "Debit", "Debits", "Amount Out", "Money Out", "Paid Out", "Payment Out", "DR", "DR."],
    "credit": ["Deposits", "Deposit", "Credit", "Credits", "Amount In", "Money In", "Paid In", "Payment In", "CR", "CR."],
    "balance": [
        "Effective Available Balance", "Available Balance", "Closing Balance", "Running Balance", "Current Balance", "Account Balance",
        "Ledger Balance", "Book Balance", "Balance",
    ],
    "transaction_id": [
        "Transaction ID", "Transaction Number", "Transaction No", "Transaction #", "Txn ID", "Txn No", "Txn Number", "Tran ID", "Tran No",
        "Reference Number", "Reference No", "Ref No", "Confirmation Number", "Trace Number", "Trace ID",
    ],
}
DATES = ("transaction_date", "posting_date", "value_date")
FIELDS = {field: [name for name, of in DATE_PHRASES if of == field] for field in ("posting_date", "transaction_date", "value_date")} | OTHERS
LINES = 4
LEAST = 4

_BREAK = r"\R|[\x1c-\x1e]"


def phrase(name: str) -> str:
    """A phrase as it stands in a plain text."""
    return name.lower().replace("trxn.", "trxn")


def phrases() -> list[tuple[str, str]]:
    """(name, field), longest name first."""
    others = [(name, field) for field, names in OTHERS.items() for name in names]
    return sorted(DATE_PHRASES + others, key=lambda p: -len(p[0]))


def pattern(names: list[str]) -> str:
    """Matches one of the names with no letter or digit next to it."""
    either = "|".join(phrase(n).replace(".", r"\.") for n in names)
    return f"(^|[^a-z0-9])({either})($|[^a-z0-9])"


def named(text: Column, names: list[str]) -> Column:
    """Whether a plain text has one of the names by itself; the pattern is tried only where one of them stands at all."""
    stems = sorted({phrase(n) for n in names})
    stems = [s for s in stems if not any(o in s for o in stems if o != s)]
    return reduce(or_, (F.contains(text, F.lit(s)) for s in stems)) & text.rlike(pattern(names))


def plain(text: Column) -> Column:
    low = F.replace(F.lower(text), F.lit("trxn."), F.lit("trxn"))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9#./\s-]", " "), r"\s+", " "))


def score(text: Column) -> Column:
    """The number of fields that a plain text names, 3 more for a date with something to book, 1 for each further date (STR26)."""
    has = {field: named(text, names) for field, names in FIELDS.items()}
    booked = has["description"] | has["amount"] | has["debit"] | has["credit"]
    points = lambda test, n=1: F.when(test, n).otherwise(0)
    return sum((points(t) for t in has.values()), F.lit(0)) + points(has["transaction_date"] & booked, 3) + points(has["posting_date"]) + points(has["value_date"])


def _lines(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def _windows(lines: Column) -> Column:
    """The windows of lines, with their places; null where there are no lines."""
    every = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.struct(i.alias("place"), F.slice(lines, i + 1, LINES).alias("lines")))
    return F.when(F.size(lines) > 0, every)


def header_windows(pages: DataFrame) -> DataFrame:
    """Candidates of each page (doc_id, page_number, text): doc_id, page_number, place, lines, plain, score (STR24-25).

    A page without lines gives one row without lines."""
    rows = pages.select("doc_id", "page_number", _lines(F.col("text")).alias("ls"))
    rows = rows.select("doc_id", "page_number", F.explode_outer(_windows(F.col("ls"))).alias("w")).select("doc_id", "page_number", "w.place", "w.lines")
    rows = rows.withColumn("plain", plain(F.array_join("lines", " ")))
    return rows.withColumn("score", score(F.col("plain")))


def best_windows(pages: DataFrame) -> DataFrame:
    """The best candidate of each page, of ``LEAST`` points or more, else null: doc_id, page_number, best (score, the place
    below zero, lines, plain).  The earlier line wins on ties."""
    rows = pages.select("doc_id", "page_number", _lines(F.col("text")).alias("ls"))
    read = F.transform(_windows(F.col("ls")), lambda w: F.struct((-w["place"]).alias("first"), w["lines"].alias("lines"), plain(F.array_join(w["lines"], " ")).alias("plain")))
    rated = F.transform(read, lambda w: F.struct(score(w["plain"]).alias("score"), w["first"].alias("first"), w["lines"].alias("lines"), w["plain"].alias("plain")))
    return rows.select("doc_id", "page_number", F.array_max(F.filter(rated, lambda w: w["score"] >= LEAST)).alias("best"))


def columns(text: Column) -> Column:
    """Columns (name, field) that a plain header text names, longest name first; dates that only adjoin are added (STR27-28, STR30-31)."""
    column = lambda name, field: F.struct(F.lit(name).alias("name"), F.lit(field).alias("field"))
    has = lambda *names: named(text, list(names))
    found = [F.when(has(name), column(name, field)) for name, field in phrases()]
    pair = F.contains(text, F.lit("post date trxn date"))
    known = has("Transaction Date", "Trxn. Date", "Txn Date", "Trans Date")
    found += [
        F.when(F.contains(text, F.lit("date value date")) & ~has("Date"), column("Date", "transaction_date")),
        F.when(pair & ~has("Post Date"), column("Post Date", "posting_date")),
        F.when(pair & ~known, column("Trxn. Date", "transaction_date")),
    ]
    return F.array_compact(F.array(*found))


def structure(pages: DataFrame) -> DataFrame:
    """One row per document of ``pages`` (doc_id, page_number, text): where its header is, its columns and what they tell (STR29).

    The best score wins, on ties the earlier page, then the earlier line.  A document without a candidate of ``LEAST``
    points, or without text, has no header page, no columns and confidence 0.
    """
    best = F.max(F.when(F.col("best").isNotNull(), F.struct("best.score", -F.col("page_number"), "best.first", "page_number", "best.lines", "best.plain")))
    rows = best_windows(pages.repartition("doc_id")).groupBy("doc_id").agg(best.alias("b"))
    rows = rows.select("doc_id", F.col("b.page_number").alias("header_page"), F.array_join("b.lines", " | ").alias("header_text"), F.coalesce(columns(F.col("b.plain")), F.array()).alias("columns"))
    has = lambda *fields: F.exists("columns", lambda c: c["field"].isin(*fields))
    both = has("debit") & has("credit")
    checks = (has(*DATES), has("description"), has("amount", "debit", "credit"))
    return rows.select(
        "doc_id", "header_page", "header_text", "columns",
        has("debit", "credit").alias("has_debit_credit"), both.alias("has_separate_debit_credit"), (has("amount") & ~both).alias("has_single_amount"),
        has("balance").alias("has_balance"), has("transaction_id").alias("has_transaction_id"),
        F.round(sum((F.when(c, 1.0).otherwise(0.0) for c in checks), F.lit(0.0)) / len(checks), 2).alias("confidence"),
    )
