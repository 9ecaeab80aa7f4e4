"""Every ledger query against its SQL; where there is none, against a plain version or for rows that no partitioning changes."""

import pytest

from ledgerflow.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference, rows_of
from tests.test_headers import expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""
        return
    frame = QUERIES[name](spark, SF)
    first = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name == "header_map":
        assert {r.header: (r.role, round(r.confidence, 2)) for r in frame.collect()} == {h: (role, round(c, 2)) for h in {r.header for r in frame.collect()} for role, c in [expected(h)]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert first and rows_of(frame.columns, [tuple(r) for r in QUERIES[name](spark, SF).collect()]) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
