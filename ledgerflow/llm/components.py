"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerflow.llm.runtime import cut, remove, stored, table_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  The smallest neighbour comes from a combinable aggregate, which is cut so that the join with it has
    two plain exchanges: Spark can then split the partition of a node with very many links."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:  # a link for each link at most, so what comes twice is left for the other step
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _stored_with_state(edges: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """``edges`` written to ``path``, and what two equal sets of links have in common; seen while they are written."""
    seen = Observation()
    done = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), path)
    state = seen.get
    return done, (state["n"], state["h"])


def components(edges: DataFrame, first: str = "a", second: str = "b", most: int = 60) -> DataFrame:
    """(node, root): for every node with a link to another node, the smallest node it reaches.

    Nulls and self-links are ignored; repeated links count once; no edges give an empty table.  Labels stay distributed.
    The links of a round are removed when those of the next one stand.
    """
    x, y, spark = F.col(first), F.col(second), edges.sparkSession
    path = table_path(spark, "links")
    current, seen = _stored_with_state(edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), path)
    for _ in range(most):
        if not seen[0]:
            break
        old, path = path, table_path(spark, "links")
        current, state = _stored_with_state(_star(cut(_star(current, large=True)), large=False), path)
        remove(spark, old)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
