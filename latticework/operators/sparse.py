"""Sparse and dense products as equality joins and grouped sums; partial sums are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.blas import equal_split
from latticework.tables import cut, n_partitions

TASK_ENTRIES = 1 << 20


def spmv(a: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """y = A x; with a row domain (i) rows without an entry are zero, else they are left out."""
    product = a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    if rows is None:
        return product
    return rows.select("i").join(product, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def spmm(a: DataFrame, x: DataFrame) -> DataFrame:
    """Y = A X for X as (i, k, v): rows (i, k, v)."""
    return a.join(x.select(F.col("i").alias("j"), "k", F.col("v").alias("x")), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def spmm_columns(a: DataFrame, x: DataFrame, columns: list[str]) -> DataFrame:
    """Y = A X for X as columns of one row table (i, c1, c2, ...): one join and one shuffle for all vectors."""
    renamed = x.select(F.col("i").alias("j"), *columns)
    return a.join(renamed, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in columns])


def matmul(a: DataFrame, b: DataFrame, bound: int = 1 << 13) -> DataFrame:
    """C = A B of two coordinate matrices; indices of many entries by tiles, see ``meet``."""
    met = meet(a.select(F.col("j").alias("k"), F.col("i").alias("p"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), F.col("j").alias("q"), F.col("v").alias("y")), bound)
    return met.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("v")).select(F.col("p").alias("i"), F.col("q").alias("j"), "v")


def triple_product(r: DataFrame, a: DataFrame, p: DataFrame) -> DataFrame:
    return matmul(matmul(r, a), p)


def gram(a: DataFrame, bound: int = 1 << 13) -> DataFrame:
    """A' A of a coordinate matrix: a self-join on the row; rows of many entries by tiles, see ``meet``. The matrix is written once, and joined in
    as many tasks as keep one at ``TASK_ENTRIES`` of it, so a task's memory does not grow with the matrix."""
    a = cut(a.select("i", "j", "v"))
    tasks = max(n_partitions(a.sparkSession, a), -(-a.count() // TASK_ENTRIES))
    met = meet(a.select(F.col("i").alias("k"), F.col("j").alias("p"), F.col("v").alias("x")), a.select(F.col("i").alias("k"), F.col("j").alias("q"), F.col("v").alias("y")), bound, tasks)
    return met.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("v")).select(F.col("p").alias("i"), F.col("q").alias("j"), "v")


def gram_rows(rows: DataFrame, column: str) -> DataFrame:
    """A' A for rows that are arrays of one bounded length: a partial product for each Arrow batch, then sums. No pair
    of entries is ever a row before the reduction."""
    import numpy as np
    import pandas as pd

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy()).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return rows.select(column).mapInPandas(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def blocked(a: DataFrame, blocks: int) -> DataFrame:
    """Entries with ``block``: equal runs of the entries in row order, the first ones with the remainder. A row of many entries is in
    several blocks; repeated coordinates may be, too."""
    ordered = equal_split(a.withColumn("_at", F.monotonically_increasing_id()), ["i", "j", "_at"], blocks)
    return ordered.select("i", "j", "v", (F.col("part") - 1).alias("block"))


def block_of(at: Column, entries: int, blocks: int) -> Column:
    """The block of ``blocked`` in which the entry at a place in row order, from 0, is."""
    size, rest = divmod(entries, blocks)
    long = F.greatest(at - (size + 1) * rest, F.lit(0))  # past the blocks that have one of the remainder
    of = lambda place, each: ((place - place % each) / each).cast("long")
    return F.when(at < (size + 1) * rest, of(at, size + 1)).otherwise(rest + of(long, max(1, size))).cast("int")


def spmv_blocked(entries: DataFrame, x: DataFrame) -> DataFrame:
    """y = A x for entries from ``blocked``: a partial sum for each block and row, which only rows in two blocks have more of than one,
    and one sum of those. No task sums more entries than a block has, whatever the rows' sizes, and a row reaches the last
    sum once a block."""
    met = entries.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j")
    partial = met.groupBy("block", "i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
    return partial.groupBy("i").agg(F.sum("s").alias("v"))


def _dealt(side: DataFrame, heavy: DataFrame, own: str, other: str, bound: int) -> DataFrame:
    """Entries with the tiles of their index: those of a heavy one are in one tile of their own side (``own``) and meet all of the other's."""
    met = side.join(heavy.select("_k", F.col(own).alias("_own"), F.col(other).alias("_other")), side["k"] == heavy["_k"], "left").drop("_k")
    tile = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / bound)).cast("int")
    mine = F.pmod(F.xxhash64("at", "v", F.monotonically_increasing_id()), tile(F.col("_own"))).cast("int")
    return met.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), tile(F.col("_other")) - 1))).drop("_own", "_other")


def meet(left: DataFrame, right: DataFrame, bound: int = 1 << 13, tasks: int | None = None) -> DataFrame:
    """All (p, x, q, y) of (k, p, x) and (k, q, y) with equal k. An index with more than ``bound`` entries on a side is cut into tiles of
    about so many on both sides, and every pair of tiles is a key of its own: a task joins a tile with a tile, never a whole index with
    itself. Of the indices only those over the bound, at most entries / bound of them, are joined to the entries. ``tasks``: in how many the pairs are made, where Spark is not to say."""
    l, r = left.select("k", F.col("p").alias("at"), F.col("x").alias("v")), right.select("k", F.col("q").alias("at"), F.col("y").alias("v"))  # noqa: E741
    sides = l.select("k", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(r.select("k", F.lit(0).alias("a"), F.lit(1).alias("b")))
    heavy = sides.groupBy(F.col("k").alias("_k")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).where((F.col("ta") > bound) | (F.col("tb") > bound))
    a = _dealt(l, heavy, "ta", "tb", bound).select("k", "ta", "tb", F.col("at").alias("p"), F.col("v").alias("x"))
    b = _dealt(r, heavy, "tb", "ta", bound).select("k", "ta", "tb", F.col("at").alias("q"), F.col("v").alias("y"))
    if tasks is not None:
        a, b = (d.repartition(tasks, "k", "ta", "tb") for d in (a, b))
    return a.join(b, ["k", "ta", "tb"]).select("p", "x", "q", "y")
