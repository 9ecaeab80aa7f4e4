"""Backups restored record by record."""

from decimal import Decimal

from ledgerflow.sources import readers, restore, writers


def test_records_and_rejects(spark):
    good = '{"statement_id": "s", "position": 1, "original_amount": 2.5, "transaction_date": "2024-02-03", "other": [1]}'
    lines = [good, good[:-5], "", None, "[1]", '"x"', "null", good.replace("2.5", '"many"'), good.replace('"s"', "null"), good.replace('"2024-02-03"', '"soon"'), good.replace('"position": 1, ', ""), "{}"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "reason_no int, record string")
    got = {r.reason_no: r for r in restore.records(frame).collect()}
    want = [None, "malformed", "malformed", "malformed", "malformed", "malformed", "malformed", "malformed", "incomplete", "malformed", "incomplete", "incomplete"]
    assert [got[i].reason for i in range(len(lines))] == want
    assert got[0].row.original_amount == Decimal("2.50") and str(got[0].row.transaction_date) == "2024-02-03"
    assert restore.restored(frame).count() == 1 and restore.rejected(frame).count() == len(lines) - 1
    assert restore.records(frame.limit(0)).count() == 0


def test_files(spark, tmp_path):
    ledger = spark.createDataFrame([("s", 1, Decimal("1.00"), "KFC"), ("s", 2, None, "KFC")], "statement_id string, position long, original_amount decimal(18,2), merchant string")
    writers.backup(ledger, f"{tmp_path}/b")
    rows = readers.json_ledger(spark, f"{tmp_path}/b").collect()
    assert [(r.position, r.merchant) for r in rows] == [(1, "KFC")]
    left = restore.rejected(restore.backup_lines(spark, f"{tmp_path}/b")).collect()
    assert [r.reason for r in left] == ["incomplete"] and left[0].source_file.endswith(".json")


def test_categories_and_contexts(spark):
    rows = [("a", 1, "Netflix", "NETFLIX.COM", "Mine"), ("a", 2, "Netflix", "NETFLIX.COM", " "), ("b", 3, "Netflix", "NETFLIX.COM", "Mine")]
    ledger = spark.createDataFrame(rows, "statement_id string, position long, merchant string, description_raw string, category string")
    got = {r.position: r.category for r in restore.with_categories(ledger).collect()}
    assert got[3] == "Mine" and got[1] == got[2] != "Mine"
    saved = spark.createDataFrame([("a", 1.0, "f.pdf"), ("b", 2.0, None)], "statement_id string, card_limit double, file_name string")
    parsed = spark.createDataFrame([("a", 9.0, 5.0), ("c", 3.0, None)], "statement_id string, card_limit double, current_balance double")
    got = {r.statement_id: (r.card_limit, r.current_balance, r.file_name) for r in restore.merged_context(saved, parsed).collect()}
    assert got == {"a": (9.0, 5.0, "f.pdf"), "b": (2.0, None, None), "c": (3.0, None, None)}
