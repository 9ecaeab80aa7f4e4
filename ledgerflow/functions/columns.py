"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns (SQL texts are parsed) that later filters and projections refer to by value.

    A plain projection is merged with what follows and written out wherever it is named, so a long chain of rules grows
    with every step.  One row is generated from each here, which the optimiser leaves as it is.
    A struct among them is best kept in an array of one and read by ``try_element_at``: pruning of a struct's fields
    across generators goes wrong."""
    made = F.struct(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(made)))
