"""Exact confirmation of similarity links between sets, block by block.

``families`` are loose groups: every pair that may be linked lies in one family.  A family of many members is cut into
blocks and every pair of blocks is confirmed in a task of its own, so no task holds more than two blocks.  A task
reports, instead of all its links, a star per connected group of members, which has the same components.  For a family of
one block these are its components; only the stars of larger families are joined further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.components import components
from ledgerflow.llm.runtime import cut, group_bounds, rows_by_key

BLOCK = 128
#: Most cells of the membership matrix that one multiplication holds.
_CELLS = 1 << 24


def link_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * |intersection| >= percent * |union|; empty sets link with nothing."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    width = int(at.max()) + 1 if len(at) else 0
    row = np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(sets), len(sets)), np.int64)
    step = max(1, _CELLS // max(1, len(sets)))
    order = np.argsort(at, kind="stable") if width > step else None
    for low in range(0, width, step):
        if order is None:
            r, c = row, at
        else:
            i, j = np.searchsorted(at[order], [low, low + step])
            r, c = row[order[i:j]], at[order[i:j]] - low
        member = np.zeros((len(sets), min(step, width - low)), np.float32)
        member[r, c] = 1
        both += np.rint(member @ member.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def stars(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a connected group to its smallest node."""
    label = nodes.copy()
    some = np.flatnonzero(linked.any(1))
    while len(some):
        least = np.minimum(label[some], np.where(linked[some], label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label[some]).all():
            break
        label[some] = least
    return nodes[some], label[some]


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_by_key(batches, ["family", "i", "j"]):
        rows = rows.combine_chunks()
        node, blocks = rows.column("node").to_numpy(), rows.column("blocks").to_numpy()
        values = rows.column("hashes").chunk(0) if rows.num_rows else None
        cuts = group_bounds(*(rows.column(k).to_numpy() for k in ("family", "i", "j")))
        left, right, whole = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                sets = [np.frombuffer(values[k].as_buffer(), np.uint64) for k in range(a, b)]
                x, y = stars(node[a:b], link_matrix(sets, percent))
                left.append(x)
                right.append(y)
                whole.append(np.full(len(x), blocks[a] == 1))
        if left:
            x, y, z = np.concatenate(left), np.concatenate(right), np.concatenate(whole)
            keep = (x != y) | z
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep]), pa.array(z[keep])], ["a", "b", "whole"])


def families(loose: DataFrame) -> DataFrame:
    """(node, family, i, blocks): the loose groups of candidate pairs (a, b) and each member's block."""
    members = cut(components(loose))
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return cut(
        members.join(cut(sizes), "root").select("node", F.col("root").alias("family"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), "blocks")
    )


def confirmed_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the exact links among ``members`` (from ``families``), by ``sets`` (node, hashes: sorted uint64)."""
    rows = sets.join(members, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "hashes", "family", "blocks", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    edges = cut(rows.mapInArrow(lambda batches: confirm(batches, percent), "a long, b long, whole boolean"))
    single = edges.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()  # a set may come in repeated rows
    return single.unionByName(components(edges.filter("not whole")))
