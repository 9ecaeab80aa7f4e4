"""Rows that travel with the columns of their document."""

import pytest

from ledgerflow.operators import generic_rows
from ledgerflow.operators.regions import ordered_rows
from ledgerflow.plans import layouts

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_join_after_rows_are_formed(spark):
    """Rows were joined with their columns: Spark took them for small, broadcast them all, and one task did the rest."""
    plan = _plan(ordered_rows(layouts._ordered_words(spark, SF), layouts._ordered_columns(spark, SF)))
    assert "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("size", ["1", "7"])
def test_small_batches(spark, size):
    """Rows, documents and columns cut by batches at any place."""
    words, columns = layouts._ordered_words(spark, SF), layouts._ordered_columns(spark, SF)
    some = columns.filter("doc_id % 3 <> 0")
    want = sorted(map(tuple, ordered_rows(words, some).fillna("").fillna(-1).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(map(tuple, ordered_rows(words, some).fillna("").fillna(-1).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert want and {int(r[0]) % 3 for r in want} == {1, 2}


def test_generic_rows_join_years_alone(spark):
    """Words were joined with their header, and rows with their columns, each in a shuffle of its own."""
    plan = _plan(generic_rows.generic_rows(layouts._generic_words(spark, SF), layouts._generic_columns(spark, SF)))
    assert sum("Join " in line for line in plan.splitlines()) == 1 and plan.count("MapInArrow") == 1
