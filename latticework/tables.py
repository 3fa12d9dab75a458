"""Tables in the driver's folder, small generated tables and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder and that table's path: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is dropped when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: iterations keep a plan of constant size, and a lost
    executor costs a read."""
    return written(df, "cut")[0]


class Steps:
    """The tables that an iteration writes. What was written before a turn is dropped once what follows no longer reads it."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = written(df, "step")
        self.paths.append((df.sparkSession, path))
        return out

    def mark(self) -> int:
        return len(self.paths)

    def forget(self, before: int, first: int = 0) -> None:
        """Drops what was written from the first to before the given mark."""
        for spark, path in self.paths[first:before]:
            drop_path(spark, path)
        del self.paths[first:before]


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if (spark, path) in _WRITTEN:
        _WRITTEN.remove((spark, path))


def n_partitions(spark: SparkSession, given: DataFrame | None = None, bytes_each: int = 128 << 20, most: int = 32768) -> int:
    """spark.sql.shuffle.partitions or, where ``given`` reads more than ``bytes_each`` for each of those, as many as its bytes ask for."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if given is None:
        return n
    leaves = given._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return n if size > 1 << 60 else max(n, min(most, -(-size // bytes_each)))  # beyond: a size that Spark doesn't know


def _drop_all() -> None:
    for spark, path in list(_WRITTEN):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


atexit.register(_drop_all)
