"""Ledger backups read back record by record: what fits, and what was rejected and why (SNK2, SNK4, HLP28-29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.columns import computed
from ledgerflow.operators import memory

LEDGER_JSON = (
    "statement_id string, position long, transaction_id string, transaction_date date, posting_date date, description_raw string, merchant string,"
    " original_amount decimal(18,2), original_currency string, direction string, transaction_type string, category string, subcategory string, requires_review boolean"
)
#: Without these a record is no row of a ledger.
REQUIRED = ("statement_id", "position", "original_amount")


def records(lines: DataFrame) -> DataFrame:
    """``lines`` (record and others) with ``row``, the ledger row of the record, and ``reason``: null, or why it is rejected.

    "malformed" is a record that is no JSON object, or holds a value of another kind than its field; "incomplete" one
    without a statement, position or amount.  Null and blank records are malformed; unknown fields are passed over."""
    kind = f"{LEDGER_JSON}, _corrupt string"
    parsed = F.from_json("record", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    found = computed(lines, parsed=F.array(parsed))
    one = "try_element_at(parsed, 1)"
    missing = " or ".join(f"{one}.{c} is null" for c in REQUIRED)
    bad = f"record is null or trim(record) = '' or {one} is null or {one}._corrupt is not null"
    found = computed(found, reason=f"case when {bad} then 'malformed' when {missing} then 'incomplete' end")
    names = [f.split()[0] for f in LEDGER_JSON.split(", ")]
    row = F.struct(*(F.expr(f"{one}.{n}").alias(n) for n in names))
    return found.select(*lines.columns, row.alias("row"), "reason")


def restored(lines: DataFrame) -> DataFrame:
    """The ledger rows of the records that fit."""
    return records(lines).filter("reason is null").select("row.*")


def rejected(lines: DataFrame) -> DataFrame:
    """The other records, with the reason."""
    return records(lines).filter("reason is not null").drop("row")


def backup_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of a backup's files (``record``), with the file of each."""
    return spark.read.text(path).select(F.col("value").alias("record"), F.input_file_name().alias("source_file"))


def with_categories(ledger: DataFrame) -> DataFrame:
    """``ledger`` classified anew, by rules, in the statements of which a row lacks a category; others stay (HLP29)."""
    blank = "coalesce(trim(category), '') = ''"
    flagged = ledger.withColumn("_anew", F.expr(f"max({blank}) over (partition by statement_id)"))
    found = memory.classified(flagged)
    for name in ("category", "subcategory"):
        if name in ledger.columns:
            found = found.withColumn(name, F.expr(f"if(_anew, rule_{name}, {name})"))
    return found.select(*ledger.columns)


def merged_context(saved: DataFrame, parsed: DataFrame, key: str = "statement_id") -> DataFrame:
    """Saved facts of statements, where what was read from the statement itself wins, field by field (SNK4, HLP28).

    A statement may be in either table only; fields are those of both."""
    fields = list(dict.fromkeys(c for c in [*parsed.columns, *saved.columns] if c != key))
    side = lambda name, frame, alias: F.col(f"{alias}.{name}") if name in frame.columns else F.lit(None)
    value: dict[str, Column] = {name: F.coalesce(side(name, parsed, "p"), side(name, saved, "s")) for name in fields}
    return parsed.alias("p").join(saved.alias("s"), key, "full").select(key, *(v.alias(n) for n, v in value.items()))

