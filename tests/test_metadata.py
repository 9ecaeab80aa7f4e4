"""Statement metadata against a plain version of the rules."""

import random
import re

from ledgerflow.functions.vocabulary import BANK_SIGNALS, CARD_SIGNALS
from ledgerflow.operators import metadata as m
from ledgerflow.plans.layouts import STATEMENT_LINES


def told(full):
    text = re.sub(r"[ \t]+", " ", full.replace(" ", " ").replace("​", "")).lower()
    has = lambda terms: any(t in text for t in terms)
    out = dict.fromkeys(m.FIELDS)
    out |= {"document_type": "financial_statement" if has(m.KEYWORDS) else "unknown", "detected_keywords": "|".join(dict.fromkeys(k for k in [*CARD_SIGNALS, *BANK_SIGNALS, *m.KEYWORDS] if k in text))}
    card, bank = (sum(w for k, w in s.items() if k in text) for s in (CARD_SIGNALS, BANK_SIGNALS))
    sure_card, sure_bank = has(m.EXPLICIT_CARD), has(m.EXPLICIT_BANK)
    if sure_card != sure_bank:
        out["statement_type"] = "credit_card" if sure_card else "bank_account"
    else:
        out["statement_type"] = "credit_card" if card > bank else "bank_account" if bank > card else "unknown"
    iso = {c: len(re.findall(rf"\b{c}\b", full, re.I)) for c in m.CURRENCIES}
    words = {c: sum(len(re.findall(p, full, re.I)) for p in ps) for c, ps in m.CURRENCIES.items()}
    best = max(iso, key=iso.get) if any(iso.values()) else max(words, key=words.get) if any(words.values()) else None
    out |= {"currency": best, "currency_symbol": m.SYMBOLS.get(best), "country": m.COUNTRIES.get(best)}
    found = next((x for x in (re.search(p, full) for p in m.PERIODS) if x), None)
    if found:
        out |= {"statement_start_date": found[1], "statement_end_date": found[2]}
        year = re.search(r"(19|20)\d{2}", found[2])
        out["statement_year"] = int(year[0]) if year else None
    out["date_format"] = next((name for p, name in m.DATE_FORMATS if re.search(p, full)), None)
    value = lambda t: float(t.replace(",", ""))
    opening = re.search(m.OPENING, full)
    out["opening_balance"] = value(opening[1]) if opening else None
    at = text.find("card limit")
    row = re.search(m.SUMMARY, full[at : at + m.WINDOW]) if at >= 0 else None
    rest = re.findall(m.MONEY, row[5]) if row else []
    if len(rest) >= 3:
        names = ["card_limit", "available_limit", "minimum_payment_due"]
        out |= {n: value(row[i + 1]) for i, n in enumerate(names)} | {"payment_due_date": row[4]} | dict(zip(["total_payment_due", "profit_other_charges", "current_balance"], map(value, rest)))
    out |= {name: has(terms) for name, terms in m.TERMS.items()}
    out["has_transaction_table"] = out["has_transaction_date"] and has(m.DETAILS)
    out["confidence"] = (int(out["document_type"] != "unknown") + int(out["statement_type"] != "unknown") + int(best is not None) + int(out["has_transaction_table"])) / 4
    return out


def plain(pages):
    out = told("\n".join(pages[: m.FIRST_PAGES]))
    if out["confidence"] < 0.75 or out["document_type"] == "unknown" or out["statement_type"] == "unknown" or out["currency"] is None or not out["has_transaction_table"]:
        out = told("\n".join(pages))
    return out | {"page_count": len(pages)}


def test_against_the_plain_version(spark):
    rnd = random.Random(2)
    docs = {f"d{i}": ["\n".join(rnd.sample(STATEMENT_LINES, rnd.randrange(0, 5))) for _ in range(rnd.choice([1, 2, 7, 9]))] for i in range(250)}
    docs |= {"empty": [""], "tab": ["Card\t\tLimit Statement  AED"]}
    rows = [(d, n + 1, t) for d, pages in docs.items() for n, t in enumerate(pages)] + [("null", 1, None)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {r.doc_id: r.asDict() for r in m.document_metadata(frame).collect()}
    want = {d: plain(pages) | {"doc_id": d} for d, pages in docs.items()} | {"null": plain([""]) | {"doc_id": "null"}}
    wrong = [(d, k, got[d][k], want[d][k]) for d in want for k in want[d] if got[d][k] != want[d][k]]
    assert not wrong and got.keys() == want.keys(), wrong[:5]
    assert sum(v["card_limit"] is not None for v in want.values()) > 5
    assert m.document_metadata(frame.limit(0)).count() == 0


def test_iso_codes_beat_symbols(spark):
    frame = spark.createDataFrame([("d", 1, "$ $ $ 5 ₹ statement AED")], "doc_id string, page_number int, text string")
    row = m.document_metadata(frame).collect()[0]
    assert (row.currency, row.country, row.currency_symbol) == ("AED", "United Arab Emirates", "د.إ")


def test_patterns_see_only_texts_that_can_match():
    """Each count of a currency stands behind a search for the letters that its pattern needs."""
    import re

    from ledgerflow.functions.dialect import SPARK
    from ledgerflow.operators.metadata import CURRENCIES, needed, steps

    assert [needed(p) for p in CURRENCIES["AED"]] == ["aed", "dh", "dirham", "د.إ"] and needed(r"\bUS DOLLARS?\b") == "us dollar" and needed(r"\$") == "$"
    for p in [p for ps in CURRENCIES.values() for p in ps]:
        assert re.search(p, needed(p).upper()) or re.search(p, needed(p))
    counts = " ".join(steps(SPARK)[1].values())
    assert counts.count("regexp_count(") == len(re.findall(r"contains\(low, '[^']+'\) then regexp_count\(", counts)) > 0
