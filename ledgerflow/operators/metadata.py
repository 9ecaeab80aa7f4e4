"""What a statement says about itself: kind, currency, period, balances, card limits, columns (DOC1-5).

The first six pages are read; where they leave something open, all pages of the document are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK, Dialect
from ledgerflow.functions.vocabulary import BANK_SIGNALS, CARD_SIGNALS

FIRST_PAGES = 6
# Keywords, explicit signals, currencies with their words, symbols and countries, column terms.
KEYWORDS = ["statement", "account statement", "statement of account", "statement of card account", "transaction", "transactions"]
EXPLICIT_CARD = ["credit card statement", "card limit", "credit limit", "available credit", "minimum payment due", "minimum amount due", "cashback card", "cash back card"]
EXPLICIT_BANK = ["bank account statement", "savings account", "current account", "type of account"]
CURRENCIES = {
    "AED": [r"\bAED\b", r"\bDHS?\.?\b", r"\bDIRHAMS?\b", "د\\.إ"], "INR": [r"\bINR\b", r"\bRUPEES?\b", "₹"], "USD": [r"\bUSD\b", r"\bUS DOLLARS?\b", r"\$"], "EUR": [r"\bEUR\b", r"\bEUROS?\b", "€"],
    "GBP": [r"\bGBP\b", r"\bPOUNDS?\b", "£"], "SAR": [r"\bSAR\b", r"\bSAUDI RIYALS?\b"], "QAR": [r"\bQAR\b", r"\bQATARI RIYALS?\b"], "KWD": [r"\bKWD\b", r"\bKUWAITI DINARS?\b"],
    "BHD": [r"\bBHD\b", r"\bBAHRAINI DINARS?\b"], "OMR": [r"\bOMR\b", r"\bOMANI RIALS?\b"],
}
SYMBOLS = {"AED": "د.إ", "INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "SAR": "﷼", "QAR": "﷼", "KWD": "د.ك", "BHD": ".د.ب", "OMR": "ر.ع."}
COUNTRIES = {
    "AED": "United Arab Emirates", "INR": "India", "USD": "United States", "EUR": "European Union", "GBP": "United Kingdom", "SAR": "Saudi Arabia", "QAR": "Qatar", "KWD": "Kuwait",
    "BHD": "Bahrain", "OMR": "Oman",
}
PERIODS = [
    r"(?i)(?:statement period|period)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s*(?:to|through|\-)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(?i)(20\d{2}-\d{2}-\d{2})\s*(?:to|\-)\s*(20\d{2}-\d{2}-\d{2})",
]
DATE_FORMATS = [(r"\b\d{4}-\d{2}-\d{2}\b", "YYYY-MM-DD"), (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "DD/MM/YYYY or MM/DD/YYYY"), (r"\b\d{1,2}-\d{1,2}-\d{4}\b", "DD-MM-YYYY or MM-DD-YYYY")]
OPENING = r"(?i)OPENING\s+BALANCE\s*[:\-]?\s*([0-9][0-9,]*\.\d{2})"
MONEY = r"[0-9][0-9,]*\.\d{2}"
#: Limit, available limit, minimum payment and due date in a row, and the 1,200 characters after them.
SUMMARY = rf"({MONEY})\s+({MONEY})\s+({MONEY})\s+(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})([\s\S]{{0,1000}}[\s\S]{{0,200}})"
WINDOW = 8000
TERMS = {
    "has_posting_date": ["posting date", "posted date", "value date"], "has_transaction_date": ["transaction date", "trans date", "txn date", "date"],
    "has_debit_credit_indicator": ["dr /cr", "dr/cr", "debit", "credit"], "has_withdrawal_column": ["withdrawals"], "has_deposit_column": ["deposits"], "has_balance_column": ["balance"],
    "has_transaction_id": ["tran id", "transaction id", "reference number", "reference no"],
}
DETAILS = ["particulars", "description", "transaction details", "transaction description", "merchant"]


def needed(pattern: str) -> str:
    """What a text in lower case holds wherever a currency's pattern matches: the pattern without its optional characters."""
    return re.sub(r"\\(.)", r"\1", re.sub(r"(\\.|.)\?", "", pattern.replace(r"\b", ""))).lower()


def steps(d: Dialect) -> list[dict[str, str]]:
    """Columns over ``text``, a document's pages with a line feed between them; each step may use those before it."""
    low = f"lower({d.replaced(f"replace(replace(text, '{chr(0xA0)}', ' '), '{chr(0x200B)}', '')", r'[ \t]+', ' ')})"
    # in Spark a pattern is tried only on texts that hold the letters it needs
    where_held = lambda term, value, none="null": f"case when contains(low, {d.text(term)}) then {value} else {none} end" if d.spark else value
    every = lambda pattern: f"regexp_count(text, {d.text('(?i)' + pattern)})" if d.spark else f"len(regexp_extract_all(text, {d.text('(?i)' + pattern)}))"
    count = lambda pattern: where_held(needed(pattern), every(pattern), "0")
    kept = lambda terms: d.array(f"case when contains(low, {d.text(t)}) then {d.text(t)} end" for t in terms)
    found = kept(dict.fromkeys([*CARD_SIGNALS, *BANK_SIGNALS, *KEYWORDS]))
    score = lambda signals: " + ".join(f"case when contains(low, {d.text(t)}) then {w} else 0 end" for t, w in signals.items())
    card, bank = d.any_text("low", EXPLICIT_CARD), d.any_text("low", EXPLICIT_BANK)
    kind = d.first_case([(f"{card} and not {bank}", "'credit_card'"), (f"{bank} and not {card}", "'bank_account'"), ("card_score > bank_score", "'credit_card'"), ("bank_score > card_score", "'bank_account'")], "'unknown'")
    top = lambda column: d.first_case([(f"{column}_{c} = most_{column} and most_{column} > 0", f"'{c}'") for c in CURRENCIES])
    most = lambda column: "greatest(" + ", ".join(f"{column}_{c}" for c in CURRENCIES) + ")"
    of = lambda values: d.first_case([(f"currency = '{c}'", d.text(v)) for c, v in values.items()])
    period = lambda i: f"coalesce({', '.join(f"nullif({where_held(term, d.extracted('text', p, i))}, '')" for p, term in zip(PERIODS, ('period', '20'), strict=True))})"
    money = lambda x: f"try_cast(replace({x}, ',', '') as double)"
    part = lambda i: f"nullif({d.extracted('summary', SUMMARY, i)}, '')"
    where = "instr(low, 'card limit')" if d.spark else "strpos(low, 'card limit')"
    complete = lambda value: f"case when rest_n >= 3 then {value} end"
    whole = "int" if d.spark else "integer"
    return [
        {"low": low},
        {"card_score": score(CARD_SIGNALS), "bank_score": score(BANK_SIGNALS), "document_type": f"case when {d.any_text('low', KEYWORDS)} then 'financial_statement' else 'unknown' end"}
        | {f"iso_{c}": count(rf"\b{c}\b") for c in CURRENCIES} | {f"any_{c}": " + ".join(map(count, patterns)) for c, patterns in CURRENCIES.items()}
        | {name: d.any_text("low", terms) for name, terms in TERMS.items()} | {"summary": f"case when {where} > 0 then substr(text, {where}, {WINDOW}) end"},
        {"most_iso": most("iso"), "most_any": most("any"), "statement_type": kind, "statement_start_date": period(1), "statement_end_date": period(2),
         "date_format": d.first_case([(d.matches("text", p), f"'{name}'") for p, name in DATE_FORMATS]), "opening_balance": money(f"nullif({where_held('opening', d.extracted('text', OPENING, 1))}, '')"),
         "rest": d.all_matches(d.extracted("summary", SUMMARY, 5), MONEY),
         "has_transaction_table": f"(has_transaction_date and {d.any_text('low', DETAILS)})",
         "keywords": f"array_compact({found})" if d.spark else f"[x for x in {found} if x is not null]"},
        {"currency": f"coalesce({top('iso')}, {top('any')})", "rest_n": f"coalesce({'size' if d.spark else 'len'}(rest), 0)",
         "statement_year": f"cast(nullif({d.extracted('coalesce(statement_end_date, statement_start_date)', r'(19|20)\d{2}')}, '') as {whole})"},
        {"currency_symbol": of(SYMBOLS), "country": of(COUNTRIES), "card_limit": complete(money(part(1))), "available_limit": complete(money(part(2))), "minimum_payment_due": complete(money(part(3))),
         "payment_due_date": complete(part(4)), "total_payment_due": complete(money(d.item("rest", "1"))), "profit_other_charges": complete(money(d.item("rest", "2"))),
         "current_balance": complete(money(d.item("rest", "3"))), "detected_keywords": d.joined("keywords", "|"),
         "confidence": "(case when document_type <> 'unknown' then 0.25 else 0 end + case when statement_type <> 'unknown' then 0.25 else 0 end + case when currency is not null then 0.25 else 0 end + case when has_transaction_table then 0.25 else 0 end)"},
    ]


FIELDS = [
    "document_type", "statement_type", "country", "currency", "currency_symbol", "date_format", "statement_start_date", "statement_end_date", "statement_year", "has_transaction_table", *TERMS,
    "page_count", "confidence", "detected_keywords", "opening_balance", "card_limit", "available_limit", "minimum_payment_due", "payment_due_date", "total_payment_due", "profit_other_charges", "current_balance",
]
OPEN = "confidence < 0.75 or document_type = 'unknown' or statement_type = 'unknown' or currency is null or not has_transaction_table"


def read(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) with what their texts say."""
    for step in steps(SPARK):
        docs = computed(docs, **step)
    return docs.withColumn("confidence", F.col("confidence").cast("double"))


def document_metadata(pages: DataFrame) -> DataFrame:
    """One row per document of ``pages`` (doc_id, page_number, text): ``FIELDS``.

    An ISO code of a currency beats its words and symbols, however often they stand; ties go to the first of the list.  Of
    the checks for document, kind, currency and table, confidence is the share that hold.  Null texts count as empty."""
    page = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("ps"), F.count(F.lit(1)).alias("page_count"))
    joined = lambda ps: F.array_join(F.transform(ps, lambda p: p["text"]), "\n")
    first = read(docs.select("doc_id", "page_count", "ps", joined(F.slice("ps", 1, FIRST_PAGES)).alias("text")))
    done = F.expr(f"not ({OPEN}) or page_count <= {FIRST_PAGES}")
    again = read(first.filter(~done).select("doc_id", "page_count", joined(F.col("ps")).alias("text")))
    return first.filter(done).select("doc_id", *FIELDS).unionByName(again.select("doc_id", *FIELDS))
