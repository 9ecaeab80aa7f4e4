"""Header mapping: goldens, and a plain version of the rules."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from ledgerflow.functions import headers
from ledgerflow.operators.memory import ratio

GOLDEN = {
    "Date": "transaction_date", "Value Date": "value_date", "Particulars": "description", "Tran ID": "transaction_id", "Withdrawals": "debit",
    "Deposits": "credit", "Balance": "balance", "Post Date": "posting_date", "Trxn. Date": "transaction_date", "Description": "description", "Amount": "amount",
    "Booking_Date": "transaction_date", "Closing  Bal": "balance", " Money Out ": "debit", "Narrative": "description", "Reference:": "transaction_id",
}
OTHERS = ["Transaction Amounts", "Descriptions", "Bal.", "Withdrawal (AED)", "Deposit Amount AED", "Running Balances", "Cheque", "Amt", "Number", "Id", "Transaction", "xyz", "Credit Amnt", "Posting Dat", "Value Amount", "", "  ", "الرصيد", "Closing balance total", "Details of payment"]


def expected(header):
    text = header.lower()
    for c in " _:/()[]{}":
        text = text.replace(c, " ")
    text = " ".join(text.split())
    if not text:
        return None, 0.0
    for role, phrases in headers.PHRASES.items():
        if text in [p.replace("_", " ") for p in phrases]:
            return role, 0.99
    scores = []
    for role, phrases in headers.PHRASES.items():
        best = max(SequenceMatcher(None, text, p.replace("_", " ")).ratio() for p in phrases)
        words = set(text.split())
        scores.append((best * 0.65 + len(words & set(headers.SIGNALS[role])) / len(words) * 0.35, role))
    (first, role), (second, _) = sorted(scores, reverse=True)[:2]
    if first < 0.82 and first - second < 0.08:
        return None, 0.0
    confidence = min(first, 0.95) * (0.65 if text in headers.AMBIGUOUS else 1)
    return (role if confidence >= 0.7 else None), round(confidence, 4)


def test_goldens_and_plain_version(spark):
    frame = spark.createDataFrame([(h,) for h in [*GOLDEN, *OTHERS, "Date", None]], "header string")
    got = {r.header: (r.role, r.confidence) for r in headers.mapped(frame, ratio).collect()}
    assert {h: got[h][0] for h in GOLDEN} == GOLDEN and got.pop(None) == (None, 0.0)
    want = {h: expected(h) for h in [*GOLDEN, *OTHERS]}
    assert got.keys() == want.keys()
    for h, (role, confidence) in want.items():
        assert got[h][0] == role and abs(got[h][1] - confidence) < 1e-3, h
    assert headers.mapped(frame.limit(0), ratio).count() == 0


def test_one_header_at_a_time():
    """The memoised mapping of a worker follows the same rules; only texts without a signal word are not compared."""
    for h in [*GOLDEN, *OTHERS]:
        role, confidence = expected(h)
        got = headers.role_of(h)
        assert got[0] == role and (role is None or abs(got[1] - confidence) < 1e-3), h


def test_numbered_names_are_compared_once(spark):
    """Characters that no phrase has are alike for a similarity, not for a header's words."""
    names = [f"Customer#{i:06}" for i in range(300)] + ["Date 17 17", "Date 17 18", "Amount (9) due", "Amount (8) due", "Date \U0001f4c5\U0001f4c5", "Date ~~"]
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    got = {r.header: (r.role, r.confidence) for r in headers.mapped(spark.createDataFrame([(n,) for n in names], "header string"), counted).collect()}
    assert {n: (role, round(c, 3)) for n, (role, c) in got.items()} == {n: (role, round(c, 3)) for n in names for role, c in [expected(n)]}
    assert compared.value <= 10 * sum(map(len, headers.PHRASES.values()))
