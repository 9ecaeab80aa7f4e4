"""Sinks: ledger backups, statement contexts, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.canonical import display_rows
from ledgerflow.sources.restore import LEDGER_JSON


def backup(ledger: DataFrame, path: str) -> None:
    """JSON lines by statement; dates are ISO texts, amounts numbers (SNK1, SNK3, SNK5)."""
    fields = [f.split()[:2] for f in LEDGER_JSON.split(", ")]
    kinds = [(n, k if "(" not in k else "decimal(18,2)") for n, k in fields]
    have = [F.col(n).cast(k).alias(n) if n in ledger.columns else F.lit(None).cast(k).alias(n) for n, k in kinds]
    ledger.select(*have).write.mode("overwrite").json(path)


def export_csv(ledger: DataFrame, path: str) -> None:
    """The display columns as CSV with a header (SNK6)."""
    display_rows(ledger).write.mode("overwrite").csv(path, header=True)


def save_memory(memory: DataFrame, path: str) -> None:
    memory.write.mode("overwrite").parquet(path)
