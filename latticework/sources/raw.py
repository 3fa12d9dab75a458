"""Raw binary doubles, point files and field text."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources import lines


def read_doubles(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """Raw values of a file (or each file of a folder): rows (path, i, v). A file is read in blocks of whole values by as many tasks as it has
    blocks, whatever its size; a file that ends within a value is refused."""
    import numpy as np

    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names and sizes, no contents
    if odd := [f["path"] for f in files if f["length"] % width]:
        raise ValueError(f"not whole values of {width} bytes: {odd[:3]}")
    setting = "org.apache.spark.input.FixedLengthBinaryInputFormat"

    def values(name: str):
        def some(records):
            while chunk := list(itertools.islice(records, 1 << 16)):
                numbers = np.frombuffer(b"".join(bytes(v) for _, v in chunk), dtype).astype(float).tolist()
                yield from ((name, k, v) for (k, _), v in zip(chunk, numbers))

        return some

    read = lambda f: spark.sparkContext.newAPIHadoopFile(f, setting, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{setting}.recordLength": str(width)})
    parts = [read(f["path"]).mapPartitions(values(f["path"])) for f in files if f["length"]]
    return spark.createDataFrame(spark.sparkContext.union(parts) if parts else [], "path string, i long, v double")


def write_doubles(x: DataFrame, path: str) -> None:
    """Values (i, v) by index as one raw file on any store that Spark writes to, streamed a partition at a time."""
    import struct

    spark = x.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    held: list[float] = []

    def flush() -> None:
        out.write(bytearray(struct.pack(f"<{len(held)}d", *held)))
        held.clear()

    try:
        for row in x.orderBy("i").select("v").toLocalIterator():
            held.append(row["v"])
            if len(held) >= 1 << 16:
                flush()
        flush()
    finally:
        out.close()


def write_points(points: DataFrame, path: str) -> None:
    """Points (id, p) by id as text: "npt dim" and a line a point, as files that follow each other by name."""
    n, dim = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("p")), F.lit(0))).first()
    body = points.select(F.col("id").cast("long").alias("id"), F.array_join(F.transform("p", lambda x: x.cast("double").cast("string")), " ").alias("value"))
    lines.write([f"{n} {dim}"], body, ["id"], path)


def write_field(x: DataFrame, path: str) -> None:
    """Values (i, v) by index, one a line, as files that follow each other by name."""
    lines.write([], x.select("i", F.col("v").cast("double").cast("string").alias("value")), ["i"], path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Text of "npt dim" and npt * dim numbers, point after point on lines of dim: rows (id, p)."""
    text = lines.numbered(lines.placed(spark, path).where("line <> ''"))
    return text.where("at > 0").select((F.col("at") - 1).alias("id"), F.transform(F.split("line", r"\s+"), lambda x: x.cast("double")).alias("p"))


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """One number a line: rows (i, v)."""
    return lines.numbered(lines.placed(spark, path).where("line <> ''")).select(F.col("at").alias("i"), F.col("line").cast("double").alias("v"))
