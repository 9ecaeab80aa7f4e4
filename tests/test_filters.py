"""Search by pattern, focus and editor search on small ledgers."""

from ledgerflow.operators import canonical

ROWS = [
    (1, "-: Noon", "order 17", "T-1", "Shopping"),
    (2, "noon ", "ORDER 18", "T-2", None),
    (3, None, "Noon. minutes", "T-3", ""),
    (4, "متجر", "x", "noon-4", "shopping"),
    (5, "", None, None, "Other"),
]


def positions(frame):
    return sorted(r.position for r in frame.collect())


def test_filters(spark):
    ledger = spark.createDataFrame(ROWS, "position long, merchant string, description_raw string, transaction_id string, category string")
    assert positions(canonical.search(ledger, "order 1[78]$", pattern=True)) == [1, 2]
    assert positions(canonical.search(ledger, "noon.", pattern=True)) == [2, 3]
    assert positions(canonical.search(ledger, "noon.")) == [3]
    assert positions(canonical.focus(ledger, "merchant", " :NOON")) == [1, 2]
    assert positions(canonical.focus(ledger, "merchant", "متجر")) == [4]
    assert positions(canonical.focus(ledger, "category", "SHOPPING")) == [1, 4]
    assert positions(canonical.focus(ledger, "category", "uncategorized")) == [2, 3]
    assert positions(canonical.focus(ledger, "", "noon")) == positions(canonical.editor_search(ledger, "  ")) == [1, 2, 3, 4, 5]
    assert positions(canonical.editor_search(ledger, "NOON")) == [1, 2, 3, 4]
    assert positions(canonical.editor_search(ledger, "t-2")) == [2]
