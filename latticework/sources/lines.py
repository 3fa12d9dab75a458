"""Text of one file, or of a folder whose files follow each other by name: lines in order, read and written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.blas import running_total
from latticework.tables import n_partitions

#: where a line stands: file, the block of it that one task reads, and the place in that
PLACE = ["_file", "_block", "_n"]


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(line, _file, _block, _n): trimmed lines; the last three, in turn, are in the order of the text. A task may read blocks of many files in any order."""
    return spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``at``, a line's number from 0."""
    counted = running_total(lines.withColumn("_one", F.lit(1).cast("long")), PLACE, "_one", "at")
    return counted.withColumn("at", F.col("at") - 1).drop("_one")


def first_file(spark: SparkSession, path: str) -> str:
    """The file that the text begins in."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError("no file")
    return files[0]


def write(head: list[str], body: DataFrame, order: list[str], path: str) -> None:
    """``head``, then the values of ``body`` (value and the columns of ``order``) in order, as a folder of text files: each task writes a range,
    and the first one's file begins with the head. The files one after the other are the text."""
    spark = body.sparkSession
    top = spark.createDataFrame([(k, line) for k, line in enumerate(head)], "_o long, value string").select(F.lit(0).alias("_kind"), "_o", *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in order], "value")
    every = top.unionByName(body.select(F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_o"), *order, "value"))
    keys = ["_kind", *order]  # the head's lines agree in them, so they are in one file
    every.repartitionByRange(n_partitions(spark, body), *keys).sortWithinPartitions(*keys, "_o").select("value").write.mode("overwrite").text(path)
