"""Page texts to a validated ledger: edges that the query's data do not have."""

from ledgerflow.operators.statement_pipeline import ledger_of_pages

SCHEMA = "doc_id string, page_number int, text string"


def test_pages_of_one_statement(spark):
    pages = [
        ("a", 1, "Credit Card Statement\nCard Limit AED 1,000\n01/02/2024 02/02/2024 CARREFOUR HYPERMARKET 10.00\n01/02/2024 02/02/2024 CARREFOUR HYPERMARKET 10.00"),
        ("a", 2, "  03/02/2024 03/02/2024 TRANSFER PAYMENT RECEIVED THANK YOU 1,250.00CR  \nnot a row 5.00"),
        ("b", 1, None), ("c", 1, ""), ("d", 1, "31/02/2024 31/02/2024 NO SUCH DAY 1.00"),
    ]
    rows = ledger_of_pages(spark.createDataFrame(pages, SCHEMA)).orderBy("statement_id", "position").collect()
    assert [(r.statement_id, r.source_page, str(r.transaction_date), float(r.original_amount), r.direction) for r in rows] == [
        ("a", 1, "2024-02-01", 10.0, "debit"), ("a", 1, "2024-02-01", 10.0, "debit"), ("a", 2, "2024-02-03", 1250.0, "credit"),
    ]
    assert {(r.original_currency, r.statement_type) for r in rows} == {("AED", "credit_card")}  # of the whole document, page 2 names none
    assert [r.codes for r in rows] == ["", "POSSIBLE_DUPLICATE", ""] and rows[0].rule_category is not None
    assert ledger_of_pages(spark.createDataFrame([], SCHEMA)).count() == 0
