"""Generated inputs in closed form: the same rows on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TASK_ROWS = 1 << 20


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 to n - 1 in tasks of at most ``TASK_ROWS``: what a task that groups them holds does not grow with n."""
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


def vector(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """(i, v) with v an expression of i."""
    return numbers(spark, n).withColumnRenamed("id", "i").select("i", value.cast("double").alias("v"))


def modular(spark: SparkSession, n: int, modulus: int, shift: int = 0) -> DataFrame:
    return vector(spark, n, (F.col("i") + shift) % modulus)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) by hash of the keys: stands in for a random stream and is the same each time."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def centred(spark: SparkSession, n: int, seed: int = 19241112) -> DataFrame:
    """A right-hand side in [-1/2, 1/2)."""
    return vector(spark, n, uniform(F.lit(seed), F.col("i")) - 0.5)


def random_coo(spark: SparkSession, rows: int, cols: int, entries: int, seed: int = 114514) -> DataFrame:
    """Entries at hashed places, duplicates included, of value 1."""
    u = lambda k: F.floor(uniform(F.lit(seed + k), F.col("id")) * (rows if k == 0 else cols)).cast("long")
    return numbers(spark, entries).select(u(0).alias("i"), u(1).alias("j"), F.lit(1.0).alias("v"))


def random_points(spark: SparkSession, n: int, seed: int = 114514) -> DataFrame:
    """(id, x, y, z, q) in the unit cube."""
    return numbers(spark, n).select("id", *[uniform(F.lit(seed + k), F.col("id")).alias(c) for k, c in enumerate("xyzq")])


def _square(spark: SparkSession, n: int, m: int) -> DataFrame:
    return numbers(spark, n * m).select(F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"))


def distance_matrix(spark: SparkSession, n: int, m: int, gap: float = 1.0) -> DataFrame:
    """Distances of two parallel lines of points, ``gap`` apart along their direction."""
    return _square(spark, n, m).withColumn("v", F.abs(F.col("i").cast("double") / n - (F.col("j").cast("double") / m + 1.0 + gap)))


def reciprocal_matrix(spark: SparkSession, n: int, m: int) -> DataFrame:
    d = distance_matrix(spark, n, m)
    return d.withColumn("v", F.lit(1.0) / F.col("v"))


def dense_stencil(spark: SparkSession, nx: int, ny: int, coefficients: tuple[float, ...] = (10.0, -2.0, -1.0, -0.5)) -> DataFrame:
    """Two-dimensional axis stencil as (i, j, v), row x * ny + y; the centre is twice its coefficient."""
    moves = [(0, 0, 2.0 * coefficients[0])] + [(s * r if a == 0 else 0, s * r if a == 1 else 0, c) for r, c in enumerate(coefficients) if r for a in (0, 1) for s in (-1, 1)]
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(c)).alias("v")) for dx, dy, c in moves])
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("x"), (F.col("id") % ny).alias("y"), F.explode(table).alias("o"))
    x2, y2 = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
    return cells.where(x2.between(0, nx - 1) & y2.between(0, ny - 1)).select((F.col("x") * ny + F.col("y")).alias("i"), (x2 * ny + y2).alias("j"), "o.v")


def with_singular_values(rows: DataFrame, condition: float) -> DataFrame:
    """Rows (i, v) with orthonormal columns scaled to singular values that rise linearly from 1 / condition to 1."""
    n = F.size("v")
    value = lambda x, k: x * (1.0 / condition + (1.0 - 1.0 / condition) * F.when(n > 1, k / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(1.0)))
    return rows.select("i", F.transform("v", value).alias("v"))


def spd(a: DataFrame) -> DataFrame:
    """A'A of a coordinate matrix."""
    from latticework.operators.sparse import gram

    return gram(a)
