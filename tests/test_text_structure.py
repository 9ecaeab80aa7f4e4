"""Headers in page texts: goldens of columns, scores and edges."""

from ledgerflow.operators.text_structure import header_windows, structure


def pages(spark, *texts):
    return spark.createDataFrame([(f"d{i}", n + 1, t) for i, doc in enumerate(texts) for n, t in enumerate(doc)], "doc_id string, page_number int, text string")


def test_columns_and_flags(spark):
    rows = pages(
        spark,
        ["Welcome", "ACME BANK\nDate Value Date Particulars Tran ID Withdrawals Deposits Balance\n01/02/2024 x 1.00"],
        ["Post Date Trxn. Date\n\n  Description\r\nAmount"],
        ["Dear customer,\nyour creditor undated"],
        [None, ""],
        ["Date Amount", "Date Amount"],
    )
    got = {r.doc_id: r for r in structure(rows).collect()}
    names = lambda d: [(c.name, c.field) for c in got[d].columns]
    bank = [("Withdrawals", "debit"), ("Particulars", "description"), ("Value Date", "value_date"), ("Deposits", "credit"), ("Tran ID", "transaction_id"), ("Balance", "balance"), ("Value", "amount"), ("Date", "transaction_date")]
    assert sorted(names("d0")) == sorted(bank) and [len(n) for n, _ in names("d0")] == sorted((len(n) for n, _ in bank), reverse=True)
    assert got["d0"].header_page == 2 and got["d0"].header_text.startswith("ACME BANK | Date Value Date")
    assert got["d0"].has_separate_debit_credit and not got["d0"].has_single_amount and got["d0"].has_balance and got["d0"].has_transaction_id and got["d0"].confidence == 1.0
    assert got["d1"].header_text == "Post Date Trxn. Date | Description | Amount" and got["d1"].has_single_amount and not got["d1"].has_debit_credit
    assert {f for _, f in names("d1")} == {"posting_date", "transaction_date", "description", "amount"}
    for d in ("d2", "d3"):  # no header: words within words do not count, no text
        assert (got[d].header_page, got[d].header_text, got[d].columns, got[d].confidence) == (None, None, [], 0.0)
    assert got["d4"].header_page == 1 and got["d4"].confidence == 0.67
    assert structure(rows.limit(0)).count() == 0


def test_scores(spark):
    texts = ["Date", "Date Amount", "Post Date Date Details", "Value Date Debit", "credit-balance"]
    rows = header_windows(pages(spark, *([t] for t in texts))).collect()
    assert {r.lines[0]: r.score for r in rows} == {"Date": 1, "Date Amount": 5, "Post Date Date Details": 7, "Value Date Debit": 8, "credit-balance": 2}


def test_dates_of_one_length_keep_their_order(spark):
    """"Value Date" stands before "Entry Date" among the phrases, whatever the header's own order."""
    row = structure(pages(spark, ["Entry Date Value Date Details Amount"])).collect()[0]
    names = [c.name for c in row.columns if c.name.endswith("Date") and c.name != "Date"]
    assert names == ["Value Date", "Entry Date"]


def test_windows_stay_in_their_page(spark):
    """Only a page's best window is sorted: no row is made of the others, whatever their number; the earliest best line wins."""
    page = "\n".join(["filler"] * 50 + ["Date Details Amount", "filler"] * 3)
    found = structure(pages(spark, [page, "Date Details Amount"], [None]))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.header_page, r.header_text) for r in found.collect()}
    assert got == {"d0": (1, "filler | filler | filler | Date Details Amount"), "d1": (None, None)}
