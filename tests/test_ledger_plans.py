"""The plans of the ledger's rows: each rule is worked out once."""

from ledgerflow.operators import canonical, layout


def _optimised(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_rows_are_chosen_by_values_worked_out_before(spark):
    """The filter repeated the rules for dates and amounts and was too long to be compiled, all the more where no ids are asked for."""
    ledger = canonical.build_ledger(spark.createDataFrame([], canonical.RAW_ROWS))
    for frame in (ledger, ledger.drop("transaction_id")):
        filters = [line for line in _optimised(frame) if line.strip(" :+-").startswith("Filter")]
        assert filters and not any("regexp_extract" in line or "RLIKE" in line for line in filters)


def test_ids_count_dropped_rows(spark):
    row = lambda n, date, amount: ("s", 1, n, date, None, None, "shop", amount, None, None, None, None, "f")
    raw = spark.createDataFrame([row(1, "no date", "1.00"), row(2, "01/02/2024", "2.00CR"), row(3, "01/02/2024", "none"), row(4, "03/02/2024", "4.00")], canonical.RAW_ROWS)
    got = sorted((r.transaction_id, float(r.original_amount), r.direction) for r in canonical.build_ledger(raw).collect())
    assert got == [("TXN-000002", 2.0, "credit"), ("TXN-000004", 4.0, "debit")]


def test_a_line_is_matched_once(spark):
    """A line was matched five times, once for the test and once for each part."""
    lines = ["02 AUG 03 AUG SHOP 7 1.00", "  01/02/2024 02/02/2024 A  B -1,234.50CR ", "01/02/2024 02/02/2024 C 5.00\r", "01/02/2024 SHOP 5.00", "", "02 AUG 03 AUG 4.00 5.00 6.00DR", "x 02 AUG 03 AUG D 1.00"]
    pages = spark.createDataFrame([("d", 2, "\n".join(lines)), ("e", 1, None)], "doc_id string, page_number int, text string")
    rows = layout.raw_text_rows(pages)
    got = sorted((r.position, r.transaction_date, r.posting_date, r.description, r.amount) for r in rows.collect())
    assert got == [
        (200000, "02 AUG", "03 AUG", "SHOP 7", "1.00"), (200001, "01/02/2024", "02/02/2024", "A  B", "-1,234.50CR"), (200002, "01/02/2024", "02/02/2024", "C", "5.00"), (200005, "02 AUG", "03 AUG", "4.00 5.00", "6.00DR"),
    ]
    assert "regexp_extract" not in "\n".join(_optimised(rows))
