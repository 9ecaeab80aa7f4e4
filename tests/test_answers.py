"""Answers in sentences against figures worked out in plain Python."""

import datetime as dt
from decimal import Decimal

from ledgerflow.operators.answers import answered

COLUMNS = (
    "position long, statement_id string, merchant string, description_raw string, category string, transaction_type string, direction string, original_amount decimal(18,2),"
    " original_currency string, transaction_date date, requires_review boolean, notes string, account_holder string"
)
DAY = dt.date(2024, 2, 3)


def row(i, merchant, amount, direction="debit", category=None, review=False, notes=None, day=DAY, currency="aed", holder=None):
    from decimal import Decimal

    return (i, "s", merchant, f"text {i}", category, "purchase", direction, None if amount is None else Decimal(amount), currency, day, review, notes, holder)


ROWS = [
    row(1, "Noon", "1500.50", category="Food & Dining"), row(2, "noon", "10.00", category="food & dining", day=None), row(3, "Keeta", "1510.50", review=True, notes="POSSIBLE_DUPLICATE: x"),
    row(4, None, "3.00", category="Travel", review=True), row(5, "Acme", "4000.00", "credit", holder=" A. Person "), row(6, "", None), row(7, "Zed", "0.00", currency=None), row(8, "Noon", "2.25", currency="USD"),
]
QUESTIONS = {
    "a": "Give me a summary", "b": "Where did I spend the most?", "c": "What were my largest transactions?", "d": "Smallest purchase", "e": "Anything to review?", "f": "net?", "g": "total income",
    "h": "how much was spent", "i": "food?", "j": "health?", "k": "list categories", "l": "whose statement", "m": "what did I pay at keeta", "n": "which shop is qqqqqqqq", "o": "hello", "p": None,
}


def answers(spark, rows, columns=COLUMNS):
    questions = spark.createDataFrame(list(QUESTIONS.items()), "question_id string, question string")
    got = answered(spark.createDataFrame(rows, COLUMNS).select(*[c.split()[0] for c in columns.split(", ")]), questions).collect()
    assert sorted(r.question_id for r in got) == sorted(QUESTIONS)  # one row each
    return {r.question_id: r.answer for r in got}


def test_sentences(spark):
    got = answers(spark, ROWS)
    spent = 1500.50 + 10 + 1510.50 + 3 + 2.25
    assert got["a"] == (
        f"This statement contains **8 transactions**, with **AED 4,000.00 received** and **AED {spent:,.2f} spent**. Net cash flow is **AED {4000 - spent:,.2f}**."
        " Your largest merchant concentration is **Keeta — AED 1,510.50**."
    )
    assert got["b"] == "Your highest-spending merchant is **Keeta**, with **AED 1,510.50** across **1 transaction(s)**."
    assert got["c"].split("\n")[:4] == ["Your largest outgoing transactions are:", "", "- **Keeta** — AED 1,510.50 on 2024-02-03", "- **Noon** — AED 1,500.50 on 2024-02-03"]
    assert got["d"].split("\n")[2:5] == ["- **Noon** — AED 2.25 on 2024-02-03", "- **text 4** — AED 3.00 on 2024-02-03", "- **noon** — AED 10.00 on date unavailable"]
    assert got["e"] == "**2 transaction(s)** are marked for review, including **1 possible duplicate(s)**."
    assert got["f"] == f"Your net cash flow is **AED {4000 - spent:,.2f}** (positive)."
    assert got["g"] == "Total money received in this statement: **AED 4,000.00**." and got["h"] == f"Total money spent in this statement: **AED {spent:,.2f}**."
    assert got["i"].startswith("You spent **AED 1,510.50** on **Food & Dining** across **2 transaction(s)**. This category is present")
    assert got["j"] == "I couldn't identify any transactions that can be attributed to **Healthcare** in this statement."
    assert got["k"].startswith("The largest inferred spending areas are:\n\n- **") and "- **Travel** — AED 3.00 (1 transactions)" in got["k"]
    assert got["l"] == "The statement data identifies the account holder as **A. Person**."
    assert got["m"] == "You spent **AED 1,510.50** at **Keeta** across **1 transaction(s)**."
    assert got["n"] is None and got["o"] is None and got["p"] is None


def test_empty_ledger(spark):
    got = answers(spark, [], ", ".join(c for c in COLUMNS.split(", ") if not c.startswith(("notes", "account_holder"))))
    assert got["a"] == "This statement contains **0 transactions**, with **UNKNOWN 0.00 received** and **UNKNOWN 0.00 spent**. Net cash flow is **UNKNOWN 0.00**."
    assert got["e"] == "No transactions are currently marked for review." and "couldn't find" in got["c"] and "enough account-holder" in got["l"] and "enough category" in got["k"]


def test_retrieval_reads_words_once(spark):
    """Words of rows that no question has are never shuffled; scores are as worked out by hand."""
    from ledgerflow.operators.retrieval import retrieve

    row = lambda p, m, d, a, mw, dw: (p, m, d, a, mw, dw, ["food"], sorted({*mw, *dw, "food"}))
    schema = "position long, merchant string, description string, amount decimal(18,2), merchant_words array<string>, description_words array<string>, category_words array<string>, words array<string>"
    rows = [row(1, "Blue Cafe", "blue lunch", Decimal("9.00"), ["blue", "cafe"], ["blue", "lunch"]), row(2, "Unknown", "tea", Decimal("4.50"), [], ["tea"]), row(3, "Blue Cafe", "Unknown", Decimal("1.00"), ["blue", "cafe"], [])]
    asked = spark.createDataFrame([(0, "blue cafe"), (1, "food for 4.50"), (2, "nothing")], "question_id int, question string")
    found = retrieve(spark.createDataFrame(rows, schema), asked, limit=2)
    got = {(r.question_id, r.rank): (r.position, r.score) for r in found.collect()}
    # 6 + 1.5 for "blue", 6 for "cafe", 10 for the whole name; without the description 1.5 less
    assert got == {(0, 1): (1, 23.5), (0, 2): (3, 22.0), (1, 1): (2, 10.0), (1, 2): (1, 4.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(keys" in plan and "Generate explode(words" not in plan and "Generate explode(merchant_words" not in plan
