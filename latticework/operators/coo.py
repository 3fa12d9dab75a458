"""Coordinate matrices (i, j, v) and vectors (i, v): contracts, views and reshapes. A missing entry is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def coo(df: DataFrame, i: str, j: str, v: str | Column) -> DataFrame:
    value = F.col(v) if isinstance(v, str) else v
    return df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), value.cast("double").alias("v"))


def vec(df: DataFrame, i: str, v: str | Column) -> DataFrame:
    value = F.col(v) if isinstance(v, str) else v
    return df.select(F.col(i).cast("long").alias("i"), value.cast("double").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def merge(a: DataFrame) -> DataFrame:
    """Duplicate coordinates added up."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def merge_last(a: DataFrame, order: str) -> DataFrame:
    """Duplicate coordinates: the entry that is last in ``order`` wins."""
    return a.groupBy("i", "j").agg(F.max_by("v", order).alias("v"))


def mirror(a: DataFrame) -> DataFrame:
    """A symmetric matrix of its one stored triangle: the bag union with the off-diagonal mirrored."""
    return a.unionByName(transpose(a.where("i <> j")))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def set_diagonal(a: DataFrame, rows: DataFrame, value: float) -> DataFrame:
    """Every diagonal entry of the row domain (i) is ``value``."""
    return a.where("i <> j").unionByName(rows.select("i", F.col("i").alias("j"), F.lit(value).alias("v")))


def upper(a: DataFrame) -> DataFrame:
    return a.where("i <= j")


def fill(rows: DataFrame, value: float) -> DataFrame:
    return rows.select("i", F.lit(value).cast("double").alias("v"))


def row_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "total", inclusive: bool = True, chunk: int = 1 << 16) -> DataFrame:
    """Running sum by ``key`` (whole numbers, distinct) in two steps: chunks of the key axis, then within each, so no
    task holds more than a chunk; the window over chunks sees one row for each chunk."""
    d = df.withColumn("_c", F.floor(F.col(key) / chunk))
    last = W.unboundedPreceding, -1
    chunks = d.groupBy("_c").agg(F.sum(value).alias("_s"))
    starts = chunks.select("_c", F.coalesce(F.sum("_s").over(W.orderBy("_c").rowsBetween(*last)), F.lit(0)).alias("_b"))
    within = F.sum(value).over(W.partitionBy("_c").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    total = within + F.col("_b") - (F.lit(0) if inclusive else F.col(value))
    return d.join(starts, "_c").withColumn(out, total).drop("_c", "_b")


def row_ptr(a: DataFrame) -> DataFrame:
    """Rows (i, n, row_end): the inclusive prefix sum of entries a row, over rows that have any."""
    return prefix_sum(row_counts(a), "i", "n", "row_end")


def csr(a: DataFrame) -> DataFrame:
    """Rows (i, js, vs), columns ascending; one row of the matrix is one record."""
    packed = a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
    return packed.select("i", F.col("e.j").alias("js"), F.col("e.v").alias("vs"))


def from_csr(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode(F.arrays_zip("js", "vs")).alias("e")).select("i", F.col("e.js").alias("j"), F.col("e.vs").alias("v"))


def sorted_rows(a: DataFrame, partitions: int | None = None) -> DataFrame:
    """Entries of a row together and in column order within their partition, without a global sort."""
    spread = a.repartition(partitions, "i") if partitions else a.repartition("i")
    return spread.sortWithinPartitions("i", "j")


def dense(a: DataFrame, spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Every cell, zeros included; duplicates added up."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    return cells.join(merge(a), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def nnz_blocks(a: DataFrame, blocks: int) -> DataFrame:
    """Entries in row order dealt into ``blocks`` equal runs (the first ones get the remainder): per block its first and
    last entry and row, and whether its first and last rows are all its own (a block inside one row: false and null).

    Positions come from two prefix sums; no window spans all entries.
    """
    counted = row_ptr(a).withColumn("row_start", F.col("row_end") - F.col("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size, rest = divmod(total, blocks)
    start = lambda b: b * size + F.least(b, F.lit(rest))
    edges = a.sparkSession.range(blocks).select(F.col("id").alias("block"), start(F.col("id")).alias("nnz_start"), (start(F.col("id") + 1) - 1).alias("nnz_end")).where("nnz_end >= nnz_start")
    # a row touches the consecutive blocks from that of its first entry to that of its last
    block_of = lambda p: F.when(p < (size + 1) * rest, F.floor(p / (size + 1))).otherwise(F.floor((p - rest) / max(1, size)))
    touched = counted.select("i", "row_start", "row_end", F.explode(F.sequence(block_of(F.col("row_start")), block_of(F.col("row_end") - 1))).alias("block"))
    ends = touched.groupBy("block").agg(F.min("i").alias("first_row"), F.max("i").alias("last_row"), F.min("row_start").alias("_s"), F.max("row_end").alias("_e"))
    inside = F.col("first_row") == F.col("last_row")
    return edges.join(ends, "block").select(
        "block", "nnz_start", "nnz_end", "first_row", "last_row",
        (~inside & (F.col("nnz_start") == F.col("_s"))).alias("first_intact"),
        F.when(~inside, F.col("nnz_end") == F.col("_e") - 1).alias("last_intact"),
    )


def gather_rows(a: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose number is in ``index`` (i)."""
    return a.join(index.select("i").distinct(), "i", "left_semi")


def block_copy(a: DataFrame, r0: int, r1: int, c0: int, c1: int, to_row: int = 0, to_col: int = 0) -> DataFrame:
    """The window of rows r0..r1 and columns c0..c1 (both ends included), moved to (to_row, to_col)."""
    return a.where(F.col("i").between(r0, r1) & F.col("j").between(c0, c1)).select((F.col("i") - r0 + to_row).alias("i"), (F.col("j") - c0 + to_col).alias("j"), "v")


def kron(a: DataFrame, b: DataFrame, b_rows: int, b_cols: int, block: int = 65536) -> DataFrame:
    """Kronecker product: every entry of ``b`` meets every entry of ``a``, by an equality join on blocks of ``b``'s entries."""
    blocks = max(1, -(-b.count() // block))
    x = a.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("v").alias("av"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    y = b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"), F.pmod(F.xxhash64("i", "j"), F.lit(blocks)).cast("int").alias("block"))
    return x.join(y, "block").select((F.col("ai") * b_rows + F.col("bi")).alias("i"), (F.col("aj") * b_cols + F.col("bj")).alias("j"), (F.col("av") * F.col("bv")).alias("v"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct rows by hash order of their key: the same rows each time."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def z_order(points: DataFrame, coords: list[str], bits: int = 10) -> DataFrame:
    """A Morton key ``z`` of coordinates in [0, 1): near points have near keys. Stands in for a k-d tree order."""
    cells = [F.least(F.floor(F.col(c) * (1 << bits)).cast("long"), F.lit((1 << bits) - 1)) for c in coords]
    z = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cells):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), b * len(cells) + k))
    return points.withColumn("z", z)
