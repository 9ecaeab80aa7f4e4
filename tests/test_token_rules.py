"""Tests of single words against plain Python."""

import re

from ledgerflow.functions import tokens
from ledgerflow.functions.dialect import SPARK

WORDS = [
    "1", "31", "32", "0", "00", "99", "049", "123", "2026", "1899", "2100", "2101", "12345", "123456", "A12345", "AB1234", "ABCDE1234", "ABC123/XY-1", "TFR", "tfr",
    "31-AUG-2026", "31/Aug/26", "31-08-2026", "2026/8/1", "31.08.2026", "2026-AUG-1", "Aug", "aug.", "SEPT", "August", "Marchioness", "Mayor", "1,250.50CR", "500dr", "(500.00)",
    "-12", "+7", "1,2,3", "12,50", "$5.00", "AED 12.50", "|31-08-2026|", "[12.5]*", "1e5", ".5", "", "abc", "12.345", "(1,000)", "CR", "total 1,234.567 x", "Salary credit", "PAYMENT  RECEIVED fee", "payment-to bob", "ATM", "31/08/2026 SHOP", "١٢",
]


def expected(x):
    full = lambda p, v=x: re.fullmatch(p, v, re.ASCII) is not None
    months = set(tokens.SHORT_MONTHS + tokens.LONG_MONTHS)
    day = full(r"\d\d?") and 1 <= int(x) <= 31
    year = full(r"\d{4}") and 1900 <= int(x) <= 2100
    month = x.lower().rstrip(".") in months
    bare = re.sub(r"(?i)(cr|dr)$", "", x)
    for c in ",()₹$€£":
        bare = bare.replace(c, "")
    for c in ("AED", "INR", "USD", "EUR"):
        bare = bare.replace(c, "")
    simple = x.replace(",", "")
    if simple.startswith("(") and simple.endswith(")"):
        simple = simple[1:-1]
    try:
        float(simple)
        plain = simple.isascii() and simple.lower().strip("+-") not in ("nan", "inf", "infinity")
    except ValueError:
        plain = False
    upper = re.sub("[^A-Z0-9]+", " ", x.upper())
    found = re.search(r"-?[0-9]+(\.[0-9]{1,2})?", x.replace(",", ""))
    scanned = lambda v: re.fullmatch(tokens.SCANNED_DATE, v.strip("|,[]*\\(){}"), re.ASCII) is not None
    return {
        "day": day,
        "month": month,
        "full_date": any(re.match(p, x, re.ASCII) for p in tokens.FULL_DATES),
        "date_start": day or year or month,
        "date_fragment": day or month or (full(r"\d{2,4}") and (1900 <= int(x) <= 2100 or int(x) <= 99)),
        "header_date": day or year or full(r"\d\d") or (x[:3].lower() in tokens.SHORT_MONTHS and len(x) <= 9)
        or any(full(p, x.lower()) for p in (r"\d\d?[-/.]\d\d?[-/.]\d{2,4}", r"\d{4}[-/.]\d\d?[-/.]\d\d?", rf"\d\d?[-/]({'|'.join(tokens.SHORT_MONTHS)})[-/]\d{{2,4}}", rf"\d{{4}}[-/]({'|'.join(tokens.SHORT_MONTHS)})[-/]\d\d?")),
        "number": full(r"[(\-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?(?i:cr|dr)?\)?"),
        "amount": full(r"-?\d+(\.\d+)?", bare.strip()),
        "plain_number": plain,
        "scanned_date": scanned(x),
        "scanned_number": full(r"-?\d[\d,]*(\.\d+)?", x.strip("|[]*\\(){};:").replace("$", "").strip()),
        "begins_with_date": scanned(x.split()[0]) if x.split() else False,
        "identifier": full(r"[A-Za-z]?\d{6,}"),
        "transfer_or_identifier": x.upper() == "TFR" or full(r"[A-Za-z]?\d{6,}"),
        "reference": any(re.match(p, x, re.ASCII) for p in tokens.REFERENCES),
        "late_year": (int(x) + (2000 if int(x) <= 49 else 1900 if int(x) < 100 else 0)) if full(r"\d{1,4}") else None,
        "first_number": float(found.group()) if found else None,
        "credit_wording": any(w in upper for w in tokens.CREDIT_WORDS),
        "debit_wording": not any(w in upper for w in tokens.NOT_DEBIT) and any(w in upper for w in tokens.DEBIT_WORDS),
    }


def test_equals_plain_python(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "word string").selectExpr("word", *(f"{t(SPARK, 'word')} as {n}" for n, t in tokens.TESTS.items()))
    wrong = [(r.word, n, r[n], v) for r in rows.collect() for n, v in expected(r.word).items() if r[n] != v]
    assert not wrong
