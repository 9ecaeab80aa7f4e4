"""Categorisation with remembered corrections, and bulk corrections of a merchant's family."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerflow.functions import classify, text
from ledgerflow.functions.dialect import SPARK as S

MEMORY = "merchant_key string, category string, subcategory string, times_confirmed int"


def with_keys(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("merchant_key", F.expr(text.merchant_key(S, "merchant", "cast(null as string)", "description_raw")))


def classified(ledger: DataFrame) -> DataFrame:
    """Add rule_category, rule_subcategory, rule_score (0.0 without a rule) (CL2, CL3, JN2)."""
    names = ledger.columns
    rows = ledger.withColumn("_text", F.expr(classify.searchable(S, "merchant", "description_raw"))).withColumn("_rule", F.expr(classify.category_rule(S, "_text")))
    part = lambda n: F.expr(classify.rule_part(S, "_rule", n))
    return rows.select(*names, part(1).alias("rule_category"), part(2).alias("rule_subcategory"), F.coalesce(part(3), F.lit(0.0)).alias("rule_score"))


def categorised(ledger: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory wins over rules; the rest has no category and is for review (JN1).

    ``memory`` has one row per key and is joined by it: small, it is broadcast by its measured size, large, it is not."""
    rows = classified(with_keys(ledger)).join(memory.select("merchant_key", F.col("category").alias("m_category"), F.col("subcategory").alias("m_subcategory")), "merchant_key", "left")
    known = F.col("m_category").isNotNull()
    score = F.when(known, 1.0).otherwise(F.col("rule_score"))
    return rows.select(
        "position", "merchant_key",
        F.coalesce("m_category", "rule_category").alias("category"),
        F.when(known, F.col("m_subcategory")).otherwise(F.col("rule_subcategory")).alias("subcategory"),
        score.alias("score"),
        (score < 0.9).alias("review"),
        F.when(known, "memory").when(F.col("rule_category").isNotNull(), "rule").otherwise("review").alias("origin"),
    )


def upsert(memory: DataFrame, corrections: DataFrame) -> DataFrame:
    """Memory after corrections (merchant_key, category, subcategory, position): the last one of a key wins, each counts
    (SRC19, JN5).  A merge by one aggregate over both."""
    old = memory.select("merchant_key", "category", "subcategory", "times_confirmed", F.lit(-1).cast("long").alias("position"))
    new = corrections.select("merchant_key", "category", "subcategory", F.lit(1).alias("times_confirmed"), "position")
    last = F.max_by(F.struct("category", "subcategory"), "position")
    out = old.unionByName(new).groupBy("merchant_key").agg(last.alias("l"), F.sum("times_confirmed").cast("long").alias("times_confirmed"))
    return out.select("merchant_key", "l.category", "l.subcategory", "times_confirmed")


def add_categories(known: DataFrame, added: DataFrame) -> DataFrame:
    """Custom categories (name, subcategory) with those added that are new (SRC20)."""
    return known.unionByName(added.dropDuplicates(["name"]).join(known, "name", "left_anti").select("name", "subcategory"))


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts; there is no built-in of it, so it only ever sees distinct names."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


#: Pairs of a group are listed while they are at most so many per row of it.
PAIRS_PER_ROW = 8


def _families(ledger: DataFrame) -> DataFrame:
    """The named rows (position, direction, family); directions are compared in any case, a missing one is a direction."""
    rows = ledger.select("position", F.expr("coalesce(lower(direction), '')").alias("direction"), F.expr(text.family_key(S, "coalesce(nullif(merchant, ''), description_raw)")).alias("_key"))
    # the key is a column of its own and the family never null, so that no plan spells the key out once per known family
    return rows.filter("_key <> ''").select("position", "direction", F.expr(f"coalesce({text.family(S, '_key')}, '')").alias("family"))


def _links(rows: DataFrame, chosen: DataFrame, least: float) -> DataFrame:
    """(direction, a, family, n, m): families that the ``n`` anchors of family ``a`` reach, and the rows of each.

    Families are compared, not rows: those of anchors meet those of the ledger of a length that allows the ratio."""
    of = lambda frame, n: frame.groupBy("direction", "family").agg(F.count(F.lit(1)).alias(n))
    own = of(chosen, "n").withColumnRenamed("family", "a")
    # a ratio of 0.92 needs nearly equal lengths, so candidates meet by length, not all with all
    near = own.withColumn("l", F.explode(F.sequence(F.ceil(F.length("a") * least / (2 - least)).cast("int"), F.floor(F.length("a") * (2 - least) / least).cast("int"))))
    met = near.join(of(rows, "m").withColumn("l", F.length("family")), ["direction", "l"])
    return met.withColumn("r", ratio("a", "family")).filter(F.col("r") >= least).select("direction", "a", "family", "n", "m")


def campaign(ledger: DataFrame, anchors: DataFrame, least: float = 0.92) -> DataFrame:
    """(anchor, position): rows of the anchor's direction whose merchant family is the anchor's or spelt much like it (JN3-4).

    As many rows as there are pairs; ``campaign_groups`` says the same in rows that grow with the ledger."""
    rows = _families(ledger)
    chosen = rows.join(anchors.select("position").distinct(), "position")
    reached = chosen.select(F.col("position").alias("anchor"), "direction", F.col("family").alias("a")).join(_links(rows, chosen, least), ["direction", "a"])
    return reached.select("anchor", "direction", "family").join(rows, ["direction", "family"]).filter("anchor <> position").select("anchor", "position")


def campaign_groups(ledger: DataFrame, anchors: DataFrame, least: float = 0.92) -> DataFrame:
    """The pairs of ``campaign`` without listing those of hot groups: (anchor, position, direction, family).

    A group is a direction and a family.  A row with both numbers is a pair.  Of a hot group, which has more than
    ``PAIRS_PER_ROW`` pairs per row, each anchor that reaches it and each position in it has one row, the other number
    null: every such anchor goes with every such position but itself.  Nothing is left out."""
    rows = _families(ledger)
    chosen = rows.join(anchors.select("position").distinct(), "position")
    group, none = ["direction", "family"], F.lit(None).cast("long")
    links = _links(rows, chosen, least).withColumn("n", F.sum("n").over(Window.partitionBy(*group)))
    links = links.select("direction", "a", "family", (F.col("n") * F.col("m") > PAIRS_PER_ROW * (F.col("n") + F.col("m"))).alias("hot"))
    reached = chosen.select(F.col("position").alias("anchor"), "direction", F.col("family").alias("a")).join(links, ["direction", "a"])
    listed = reached.filter("not hot").select("anchor", *group).join(rows, group).filter("anchor <> position").select("anchor", "position", *group)
    some = reached.filter("hot").select("anchor", none.alias("position"), *group)
    members = rows.join(links.filter("hot").select(*group).distinct(), group).select(none.alias("anchor"), "position", *group)
    return listed.unionByName(some).unionByName(members)


def campaign_positions(ledger: DataFrame, anchors: DataFrame, least: float = 0.92) -> DataFrame:
    """(position) of each row that an anchor other than itself reaches: the distinct positions of ``campaign``, found by
    the number of anchors per group.  An anchor always reaches its own family."""
    rows = _families(ledger)
    chosen = rows.join(anchors.select("position").distinct(), "position")
    reach = _links(rows, chosen, least).groupBy("direction", "family").agg(F.sum("n").alias("n"))
    alone = chosen.select("position", F.lit(1).alias("self"))
    out = rows.join(reach, ["direction", "family"]).join(alone, "position", "left")
    return out.filter("n > coalesce(self, 0)").select("position")


def first_spellings(ledger: DataFrame) -> DataFrame:
    """Distinct merchants in any case, each in its first spelling (QA5, JN12)."""
    rows = ledger.filter("nullif(trim(merchant), '') is not null")
    return rows.groupBy(F.lower("merchant").alias("name_key")).agg(F.min_by("merchant", "position").alias("name"), F.min("position").alias("first_position"))


def last_corrections(corrections: DataFrame) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("merchant_key").orderBy(F.desc("position")))
    return corrections.withColumn("r", row).filter("r = 1").drop("r")
