"""A balanced k-d tree over points (id, p), level by level.

Node k of level l holds the points whose rank is in [ceil(k n / 2^l), ceil((k + 1) n / 2^l)) when nodes of the level before are in order and
points in a node are in order of one coordinate, then of their id: sizes within a level differ by one at most, whatever n. A rank is a running
count over ranges of that order (one sort a level, no node in one task), and the node that it falls in is arithmetic: no medians are
collected or joined. Once nodes are small, each is split to the end in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.blas import running_total

TASK_ROWS = 1 << 16


def axes_of(points: DataFrame, levels: int) -> list[int]:
    """The coordinate that each level splits: the longest side of the boxes so far."""
    spans = points.select(F.posexplode("p").alias("axis", "x")).groupBy("axis").agg((F.max("x") - F.min("x")).alias("span")).orderBy("axis").collect()
    side, out = [float(r["span"] or 0.0) for r in spans] or [0.0], []
    for _ in range(levels):
        out.append(int(np.argmax(side)))
        side[out[-1]] /= 2
    return out


def levels_for(rows: int, leaf_rows: int) -> int:
    """The least depth at which no leaf has more than ``leaf_rows`` points."""
    return max(0, (-(-rows // leaf_rows) - 1).bit_length())


def kd_tree(points: DataFrame, leaf_rows: int = 256, axes: list[int] | None = None, levels: int | None = None, task_rows: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """The points with ``leaf``, from 0 in tree order, and the number of levels. Ids are unique; ``p`` has one length for all points.

    Node k of a level holds the leaves whose number begins with the bits of k. ``axes`` gives the coordinate of each level."""
    n = points.count()
    levels = levels_for(n, leaf_rows) if levels is None else levels
    axes = axes_of(points, levels) if axes is None else axes
    tree, level = points.withColumn("leaf", F.lit(0).cast("long")), 0
    while level < levels and n >> level > task_rows:
        ranked = running_total(tree.withColumns({"_x": F.col("p")[axes[level]], "_one": F.lit(1).cast("long")}), ["leaf", "_x", "id"], "_one", "_rank")
        tree, level = ranked.withColumn("leaf", F.expr(f"(_rank - 1) * {2 << level}L div {n}L")).drop("_x", "_one", "_rank"), level + 1
    if level == levels:
        return tree, levels
    begun = level

    def split(table: pa.Table) -> pa.Table:
        first = -(-table.column("leaf")[0].as_py() * n // (1 << begun))  # the rank that the node begins with
        ids = table.column("id").to_numpy()
        p = np.stack(table.column("p").to_numpy())
        leaf = np.zeros(len(ids), np.int64)
        for at in range(begun, levels):
            order = np.lexsort((ids, p[:, axes[at]], leaf))
            leaf[order] = (first + np.arange(len(ids))) * (2 << at) // n
        return table.set_column(table.schema.get_field_index("leaf"), "leaf", pa.array(leaf))

    return tree.groupBy("leaf").applyInArrow(split, tree.schema), levels
