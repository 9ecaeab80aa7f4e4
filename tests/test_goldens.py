"""Values derived by hand from the rules."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import classify, values
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.operators import canonical, layout, memory, report, retrieval, validate
from ledgerflow.sources import readers, writers
from ledgerflow.streaming import ingest


def test_merchant_names(spark):
    want = {
        "FAITH CAFETERIA LLC ABU DHABI ARE": ("Faith Cafeteria", 0.90),
        "ADNOC IND AREA 447 SHARJAH ARE": ("ADNOC", 0.95),
        "TAP*KEETA DUBAI ARE": ("Keeta", 0.95),
        "AUTONOVA FOR CAR WASH ABU DHABI ARE": ("Autonova", 0.90),
        "MAWARED AL JOOD MANDI DUBAI ARE": ("Mawared Al Jood Mandi", 0.90),
        "TRANSFER PAYMENT RECEIVED THANK YOU": (None, 0.99),
        "DUBAI MALL": ("Dubai Mall", 0.85),
        "   ": (None, 0.0),
    }
    rows = canonical.normalised_merchants(spark.createDataFrame([(k,) for k in want], "description_raw string")).collect()
    assert {r.description_raw: (r.merchant_name, round(r.merchant_score, 2)) for r in rows} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("09 AUG", date(2026, 8, 9)), ("16 JUN 19", date(2019, 6, 16)), ("16 JUN 69", date(1969, 6, 16)), ("31/02/2026", None), ("01/09/2026", date(2026, 9, 1)),
        ("1st jan 2024", date(2024, 1, 1)), ("2026-8-9", date(2026, 8, 9)), ("09-08/2026", None), ("5-Dec-2023", date(2023, 12, 5)), ("junk", None),
    ],
)
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").selectExpr(f"{values.parsed_date(S, 't', '2026')} as d").first().d == want


def test_amounts(spark):
    want = {"14,000.00CR": (Decimal("14000.00"), True), "1,299.50": (Decimal("1299.50"), False), "(500.00)": (Decimal("-500.00"), False), "AED 75.25 DR": (Decimal("75.25"), False), "n/a": (None, False)}
    rows = spark.createDataFrame([(k,) for k in want], "t string").selectExpr("t", f"{values.parsed_amount(S, 't')} as a", f"{values.marked_credit(S, 't')} as c").collect()
    assert {r.t: (r.a, r.c) for r in rows} == want


def test_types_and_intents(spark):
    rows = spark.createDataFrame([("COFFEE HOUSE", "debit"), ("NEFT-SELECT-SPEND CBK", "credit"), ("IMPS FROM X", "credit"), ("BOOKS", "debit")], "t string, d string")
    assert [r.k for r in rows.selectExpr(f"{classify.transaction_type(S, 't', 'd')} as k").collect()] == ["fee", "cashback", "transfer", "purchase"]
    asked = {
        "Where did I spend the most?": "top_merchant", "What were my largest transactions?": "largest_transaction", "How much did I spend on Healthcare?": "category_spend",
        "How much was spent on healthcare": "expenses", "netflix": "net",
    }
    got = retrieval.intents(spark.createDataFrame([(q,) for q in asked], "question string"))
    assert {r.question: r.intent for r in got.collect()} == asked


def test_rules_fuzzy_and_scores(spark):
    rows = spark.createDataFrame([(1, "GOLDEN RESTAURAT"), (2, "NOVA CAFE DUBAI"), (3, "QWERTY"), (4, "NOVA CAFE")], "position long, description_raw string").withColumn("merchant", F.lit(None).cast("string"))
    got = {r.position: (r.rule_category, r.rule_subcategory, round(r.rule_score, 2)) for r in memory.classified(rows).collect()}
    assert got == {1: ("Food & Dining", "Restaurant", 0.95), 2: ("Bills & Utilities", "Mobile", 0.96), 3: (None, None, 0.0), 4: ("Food & Dining", "Cafe", 0.95)}  # "e dubai" is contained in 2


def test_page_rows_anchor_on_the_first_word(spark):
    words = spark.createDataFrame([("d", 1, f"w{i}", float(i), i + 1.0, t, t + 5) for i, t in enumerate((0.0, 3.0, 6.0, 9.0))], readers.WORDS)
    assert [r.row for r in layout.page_rows(words).orderBy("top").collect()] == [0, 0, 1, 1]
    assert [r.row for r in layout.page_rows(words, running_mean=True).orderBy("top").collect()] == [0, 0, 1, 1]


def test_column_validation(spark):
    table = {"date": ("transaction_date", ["01/02/2026", "2026-01-01", "x"]), "Balance": ("balance", ["1,000.00", "(3.00)", "12 CR"]), "Particulars": ("description", ["rent", "9", "food"])}
    cells = spark.createDataFrame([(h, r, i, v) for h, (r, vs) in table.items() for i, v in enumerate(vs)], "header string, role string, position int, value string")
    got = {r.role: (r.samples, round(r.score, 2), r.valid) for r in layout.validate_columns(cells).collect()}
    assert got == {"transaction_date": (3, 0.67, True), "balance": (3, 1.0, True), "description": (3, 0.67, True)}


def test_ledger_from_raw_rows_and_confidence(spark):
    raw = [
        ("s", 1, 1, "01/09/2026", None, None, "POS CARREFOUR DUBAI", None, "120.50", None, "879.50", None, "f.csv"),
        ("s", 1, 2, "02 SEP", None, None, "SALARY CREDIT", None, None, "5,000.00", "5,879.50", "A1", "f.csv"),
        ("s", 1, 3, None, None, None, "no date", "3.00", None, None, None, None, "f.csv"),
        ("s", 1, 4, "03 SEP", None, None, "Closing balance", "3.00", None, None, None, None, "f.csv"),
    ]
    rows = canonical.build_ledger(spark.createDataFrame(raw, canonical.RAW_ROWS)).orderBy("position").collect()
    assert [(r.transaction_id, r.transaction_date, r.direction, r.transaction_type, r.original_amount) for r in rows] == [
        ("TXN-000001", date(2026, 9, 1), "debit", "purchase", Decimal("120.50")), ("TXN-000002", date(2026, 9, 2), "credit", "salary", Decimal("5000.00")),
    ]
    assert rows[0].extraction_confidence == pytest.approx(0.85) and rows[0].merchant == "Carrefour"


def test_campaign_joins_families_and_close_spellings(spark):
    names = ["ADNOC 447", "adnoc sharjah", "Golden Bakery House", "Golden Bakery Houses", "Other Shop", "ADNOC credit"]
    rows = spark.createDataFrame([(i, "credit" if "credit" in n else "debit", n, n) for i, n in enumerate(names)], "position long, direction string, merchant string, description_raw string")
    got = {(r.anchor, r.position) for r in memory.campaign(rows, rows.filter("position in (0, 2)")).collect()}
    assert got == {(0, 1), (2, 3)}


def test_text_statements(spark):
    pages = spark.createDataFrame([("d", 1, "junk\n09 AUG 10 AUG COFFEE PLACE 1,299.50CR\nx"), ("e", 1, "01-02-2026 NEFT OUT TO\nSOMEONE 100.00 900.00 CR\nopening balance 3\n02-02-2026 FEE 1.00 899.00")], "doc_id string, page_number int, text string")
    (line,) = layout.text_transactions(pages.filter("doc_id = 'd'"), 2026).collect()
    assert (line.transaction_date, line.amount, line.direction, line.description_raw) == (date(2026, 8, 9), Decimal("1299.50"), "credit", "COFFEE PLACE")
    rows = layout.multiline_transactions(pages.filter("doc_id = 'e'")).orderBy("entry").collect()
    assert [(r.description_raw, r.amount, r.running_balance) for r in rows] == [("NEFT OUT TO SOMEONE", Decimal("100.00"), Decimal("900.00")), ("FEE", Decimal("1.00"), Decimal("899.00"))]
    assert layout.document_text(pages).filter("doc_id = 'd'").first().has_text


def test_balances_are_reconciled(spark):
    rows = spark.createDataFrame([("d", 1, None, 10.0, 100.0), ("d", 2, 5.0, None, 150.0), ("d", 3, 20.0, None, 130.0)], "doc_id string, position int, debit double, credit double, balance double")
    assert [(r.debit, r.credit, r.corrected) for r in layout.reconcile_balances(rows).orderBy("position").collect()] == [(None, 10.0, False), (None, 50.0, True), (20.0, None, False)]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "A", "debit", Decimal("3.50"))], "statement_id string, position long, merchant string, direction string, original_amount decimal(18,2)")
    writers.backup(rows, f"{tmp_path}/backup")
    back = readers.json_ledger(spark, f"{tmp_path}/backup").first()
    assert (back.statement_id, back.original_amount, back.category) == ("s", Decimal("3.50"), None)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(",".join(c.split()[0] for c in canonical.RAW_ROWS.split(", ")) + "\ns,1,1,01/09/2026,,,KFC,12.00,,,,,f\n")
    assert readers.csv_rows(spark, f"{tmp_path}/in").first().description == "KFC"
    (tmp_path / "p.txt").write_text("one\ftwo")
    assert [r.text for r in readers.page_texts(spark, f"{tmp_path}/p.txt").orderBy("page_number").collect()] == ["one", "two"]
    ingest.write(ingest.landing(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_export_has_summary_and_categories(spark):
    from ledgerflow.plans.adapters import ledger

    rows = report.overview_export(ledger(spark, "/root/testdata/sf0.001")).collect()
    assert {r.section for r in rows} == {"Summary", "Category"} and len([r for r in rows if r.section == "Summary"]) == 3
    cards = spark.createDataFrame([("a", Decimal("100.00"), Decimal("25.00"), None)], "statement_id string, card_limit decimal(18,2), available_limit decimal(18,2), current_balance decimal(18,2)")
    assert validate.card_snapshot(cards).first().utilisation == 75.0
