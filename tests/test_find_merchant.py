"""Merchant names in questions against a plain version."""

import re
from difflib import SequenceMatcher

from ledgerflow.operators.retrieval import find_merchants

NAMES = ["Spinneys", "Carrefour", "Carrefour City", "Noon", "A", "Al Jood Mandi", "Zoom-Mart", "Keeta", "متجر", "The", "Noon Minutes", "spinneys"]
QUESTIONS = [
    "How much at carrefour city?", "Spineys", "spent at NOON minutes", "carefour cityy", "what about متجر", "zoom mart", "afternoon", "xxxxx", "", None, "keta", "al jod mandi", "!!", "tom",
]


def expected(question, names):
    q = question.lower()
    direct = [(len(m), m) for m in names if m.lower() in q]
    if direct:
        return max(direct)[1]

    def alike(a, b):
        a, b = (re.sub(r"[^a-z0-9 ]", " ", x.lower()).strip() for x in (a, b))
        if not a or not b:
            return 0.0
        return 1.0 if b in a else SequenceMatcher(None, a, b).ratio()

    found = [(alike(question, m), m) for m in names]
    found = [x for x in found if x[0] >= 0.58]
    return max(found)[1] if found else None


def test_equals_plain_version(spark):
    for names in (NAMES, [n for n in NAMES if n not in ("A", "The")]):
        ledger = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "position long, merchant string")
        questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
        got = {r.question_id: r.merchant for r in find_merchants(ledger, questions).collect()}
        distinct = list({n.lower(): n for n in reversed(names)}.values())
        want = {k: m for k, q in enumerate(QUESTIONS) if q is not None and (m := expected(q, distinct))}
        assert got == want
    assert find_merchants(ledger.limit(0), questions).count() == 0
