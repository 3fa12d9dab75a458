"""Vectors, fields and matrices that the grid, solver and dense queries take from the part table: every part counts in one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.tables import table


def cells_sql(n: int) -> str:
    """(id, v): the sizes of all parts whose key is id modulo n, added up; zero where there are none."""
    return f"(SELECT id, coalesce(w, 0)::DOUBLE AS v FROM range({n}) t(id) LEFT JOIN (SELECT p_partkey % {n} AS w_id, sum(p_size) AS w FROM part GROUP BY 1) ON w_id = id)"


def cells(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    sums = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % n).alias("id")).agg(F.sum("p_size").alias("w"))
    return spark.range(n).join(sums, "id", "left").select("id", F.coalesce("w", F.lit(0)).cast("double").alias("v"))


def vector(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return cells(spark, sf_dir, n).withColumnRenamed("id", "i")


def field(spark: SparkSession, sf_dir: str, sizes: tuple[int, int, int], value: Column | None = None) -> DataFrame:
    """(x, y, z, v) over all cells of a grid."""
    nx, ny, nz = sizes
    at = [(F.col("id") % nx), (F.floor(F.col("id") / nx) % ny), F.floor(F.col("id") / (nx * ny))]
    return cells(spark, sf_dir, nx * ny * nz).select(*[a.cast("int").alias(c) for a, c in zip(at, "xyz")], (F.col("v") if value is None else value).alias("v"))


def field_sql(sizes: tuple[int, int, int], value: str = "v") -> str:
    nx, ny, nz = sizes
    return f"(SELECT (id % {nx})::INT AS x, (id // {nx} % {ny})::INT AS y, (id // {nx * ny})::INT AS z, {value} AS v FROM {cells_sql(nx * ny * nz)})"


def columns_scaled(spark: SparkSession, sf_dir: str, a: DataFrame, n: int, digits: int) -> DataFrame:
    """A coordinate matrix of n columns, each times the table's value for it: an operator whose coefficients vary."""
    met = a.join(vector(spark, sf_dir, n).select(F.col("i").alias("j"), F.col("v").alias("s")), "j")
    return met.select("i", "j", (F.round(F.col("v") * F.col("s"), digits) + 0.0).alias("v"))


def columns_scaled_sql(sql: str, n: int, digits: int) -> str:
    return f"SELECT m.i, m.j, round(m.v * c.v, {digits}) + 0.0 AS v FROM ({sql}) m JOIN {cells_sql(n)} c ON c.id = m.j"
