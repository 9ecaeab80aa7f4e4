"""Column headers to canonical fields: exact phrases as an expression, fuzzy ones as a join with the phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases of each field, in order of precedence.
PHRASES = {
    "transaction_date": [
        "date", "transaction date", "transaction_date", "txn date", "txn. date", "trxn date", "trxn. date", "trans date", "trans. date",
        "transaction dt", "txn dt", "trxn dt", "purchase date", "activity date", "activity dt", "trade date", "booking date", "book date",
    ],
    "posting_date": [
        "post date", "posting date", "posted date", "posting_date", "posted dt", "posting dt", "post dt", "booked date", "booking date",
        "accounting date", "accounting dt",
    ],
    "value_date": [
        "value date", "value_date", "value dt", "effective date", "effective dt", "effective value date", "effective value dt",
        "settlement date", "settlement dt",
    ],
    "description": [
        "description", "particulars", "particular", "details", "detail", "transaction details", "transaction description", "txn details",
        "txn description", "trxn details", "trxn description", "merchant", "merchant name", "merchant details", "narration", "narrative",
        "remarks", "remark", "memo", "reference description", "transaction particulars", "payment details", "payment description",
    ],
    "amount": [
        "amount", "transaction amount", "txn amount", "trxn amount", "transaction value", "txn value", "trxn value", "total amount",
        "payment amount", "purchase amount", "value",
    ],
    "debit": [
        "debit", "debits", "debit amount", "debit amt", "debit value", "dr", "dr amount", "dr amt", "withdrawal", "withdrawals",
        "withdrawal amount", "withdrawal amt", "money out", "money paid", "outgoing", "outgoing amount", "spent", "spend", "payments", "payment",
    ],
    "credit": [
        "credit", "credits", "credit amount", "credit amt", "credit value", "cr", "cr amount", "cr amt", "deposit", "deposits",
        "deposit amount", "deposit amt", "money in", "money received", "incoming", "incoming amount", "received", "receipts",
    ],
    "balance": [
        "balance", "closing balance", "closing bal", "available balance", "available bal", "current balance", "current bal",
        "running balance", "running bal", "account balance", "account bal", "ledger balance", "ledger bal", "ending balance", "ending bal",
        "balance after transaction", "balance after txn",
    ],
    "transaction_id": [
        "transaction id", "transaction_id", "txn id", "txn. id", "trxn id", "trxn. id", "tran id", "tran. id", "transaction number",
        "transaction no", "transaction no.", "txn number", "txn no", "txn no.", "trxn number", "trxn no", "reference", "reference number",
        "reference no", "reference no.", "reference id", "reference identifier",
    ],
}
# The words that speak for a field.
SIGNALS = {
    "transaction_date": ["date", "transaction", "txn", "trxn", "trans", "purchase", "activity", "trade", "booking", "book"],
    "posting_date": ["post", "posting", "posted", "accounting", "booked", "booking"],
    "value_date": ["value", "effective", "settlement"],
    "description": ["description", "details", "detail", "particular", "particulars", "narration", "narrative", "merchant", "remarks", "remark", "memo", "payment", "transaction"],
    "amount": ["amount", "value", "total", "payment", "purchase", "transaction", "txn", "trxn"],
    "debit": ["debit", "debits", "dr", "withdrawal", "withdrawals", "outgoing", "spent", "spend", "paid", "payment", "money", "out"],
    "credit": ["credit", "credits", "cr", "deposit", "deposits", "incoming", "received", "receipts", "money", "in"],
    "balance": ["balance", "bal", "closing", "running", "current", "available", "ending", "ledger"],
    "transaction_id": ["transaction", "txn", "trxn", "tran", "reference", "ref", "number", "no", "id"],
}
# Headers that alone say little.
AMBIGUOUS = ["value", "payment", "transaction", "reference", "number", "id", "date", "amount"]

#: Confidence of an exact phrase, of the best fuzzy one, and the least that maps; lead that a doubtful best field needs.
EXACT, MOST, LEAST, SURE, LEAD = 0.99, 0.95, 0.70, 0.82, 0.08
_FOREIGN = "[^" + re.escape("".join(sorted({c for phrases in PHRASES.values() for p in phrases for c in p.replace("_", " ")}))) + "]"


def plain(header: Column) -> Column:
    """A header in lower case with separators and brackets as blanks; full stops stay (HDR8)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(header), r"[ _:/()\[\]{}]", " "), r"\s+", " "))


def exact_role(header: Column) -> Column:
    """The field of a header that is a known phrase, else null (HDR5)."""
    fields: dict[str, str] = {}
    for role, phrases in PHRASES.items():
        for p in phrases:
            fields.setdefault(p.replace("_", " "), role)
    # one constant map, so that the text is made plain once
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]), plain(header))


def mapped(headers: DataFrame, similarity) -> DataFrame:
    """(header, role, confidence) of the distinct values of ``header`` (HDR1-7).

    A known phrase has confidence 0.99.  Any other is compared with every phrase: a field's confidence is 0.65 of its best
    phrase's similarity and 0.35 of the share of the header's words that speak for it.  The best field wins (the last by
    name on ties) unless it is below 0.82 and less than 0.08 ahead; a header that says little alone keeps 0.65 of it, and
    below 0.70 there is no role.  A null or blank header has none, with confidence 0.  ``similarity`` takes two columns and
    goes by common stretches of letters: it sees unknown headers only, with one mark for every character that no phrase has,
    so numbered names of one form are compared with the fixed phrases once.
    """
    distinct = headers.select("header").distinct()
    known = distinct.withColumn("text", F.coalesce(plain(F.col("header")), F.lit(""))).withColumn("exact", exact_role(F.col("header")))
    known = known.withColumn("shape", F.when(F.col("exact").isNull() & (F.col("text") != ""), F.regexp_replace("text", _FOREIGN, "~")))
    fixed = F.array(*[F.struct(F.lit(r).alias("field"), F.lit(p.replace("_", " ")).alias("phrase")) for r, ps in PHRASES.items() for p in ps])
    # few bytes, long comparisons: a number of tasks of its own, so that they are not merged by size
    shapes = known.filter("shape is not null").select("shape").distinct().repartition(2 * headers.sparkSession.sparkContext.defaultParallelism)
    pairs = shapes.select("shape", F.explode(fixed).alias("p")).select("shape", "p.field", similarity(F.col("shape"), F.col("p.phrase")).alias("s"))
    rated = pairs.groupBy("shape", "field").agg(F.max("s").alias("s")).groupBy("shape").agg(F.collect_list(F.struct("field", "s")).alias("fs"))  # nine fields
    out = known.join(rated, "shape", "left")
    tokens = F.array_distinct(F.split("text", " "))
    signals = F.create_map(*[x for r, ws in SIGNALS.items() for x in (F.lit(r), F.array(*[F.lit(w) for w in ws]))])
    share = lambda field: F.size(F.array_intersect(tokens, F.element_at(signals, field))) / F.size(tokens)
    ranked = F.sort_array(F.transform("fs", lambda f: F.struct((f["s"] * 0.65 + share(f["field"]) * 0.35).alias("c"), f["field"].alias("field"))), asc=False)
    out = out.withColumn("r", ranked)
    best, second = F.col("r")[0], F.col("r")[1]
    doubtful = (best["c"] < SURE) & (best["c"] - second["c"] < LEAD)
    found = F.least(best["c"], F.lit(MOST)) * F.when(F.col("text").isin(*AMBIGUOUS), 0.65).otherwise(1.0)
    out = out.select("header", "exact", best["field"].alias("field"), F.when(F.col("r").isNotNull(), F.when(doubtful, 0.0).otherwise(found)).alias("c"))
    confidence = F.when(F.col("exact").isNotNull(), EXACT).otherwise(F.coalesce("c", F.lit(0.0)))
    role = F.coalesce("exact", F.when(F.col("c") >= LEAST, F.col("field")))
    return out.select("header", role.alias("role"), F.round(confidence, 4).alias("confidence"))


@lru_cache(maxsize=1)
def _fields() -> tuple[dict[str, str], list[tuple[str, list[str], set[str]]]]:
    """Exact phrases, and for each field its phrases and signal words."""
    exact: dict[str, str] = {}
    for role, phrases in PHRASES.items():
        for p in phrases:
            exact.setdefault(p.replace("_", " "), role)
    return exact, [(role, [p.replace("_", " ") for p in phrases], set(SIGNALS[role])) for role, phrases in PHRASES.items()]


@lru_cache(maxsize=1 << 16)
def role_of(header: str) -> tuple[str | None, float]:
    """(role, confidence) of one header by the rules of ``mapped``; each worker compares a text once.

    Without a word that speaks for a field a similarity does not suffice, so such texts are not compared at all."""
    exact, fields = _fields()
    text = " ".join(re.sub(r"[ _:/()\[\]{}]", " ", header.lower()).split())
    if text in exact:
        return exact[text], EXACT
    words = set(text.split(" "))
    if not any(words & signals for _, _, signals in fields):
        return None, 0.0
    rated = [(0.65 * max(SequenceMatcher(None, text, p).ratio() for p in phrases) + 0.35 * len(words & signals) / len(words), role) for role, phrases, signals in fields]
    (best, role), (second, _) = sorted(rated, reverse=True)[:2]
    if best < SURE and best - second < LEAD:
        return None, 0.0
    confidence = min(best, MOST) * (0.65 if text in AMBIGUOUS else 1.0)
    return (role if confidence >= LEAST else None), round(confidence, 4)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("confidence", T.DoubleType())])))
def header_roles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The role and confidence of each text of an array."""
    for batch in texts:
        yield batch.map(lambda row: None if row is None else [dict(zip(("role", "confidence"), role_of(t or ""), strict=True)) for t in row])
