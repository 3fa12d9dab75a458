"""What several training-data operators share: tables kept in workers, components, and the library's written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.tables import drop_path, n_partitions, shared_dir, written

__all__ = ["components", "drop_path", "kept", "local_forest", "n_partitions", "release", "row_key", "shared_dir", "shrink_edges", "text_or_empty", "written"]


_KEPT: dict = {}


def kept(key, make):
    """What an operator keeps in a worker process between tasks. Only one operator's is kept: workers are
    reused, and the tables of a stage that has ended must not take the next one's memory."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_key(docs: DataFrame) -> Column:
    """Two 64-bit hashes of all columns, as a string: rows that agree in everything share them. Columns with maps count by their JSON text, as maps have no hash."""
    maps = lambda kind: isinstance(kind, T.MapType) or any(maps(k) for k in ([kind.elementType] if isinstance(kind, T.ArrayType) else [f.dataType for f in kind] if isinstance(kind, T.StructType) else []))
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if maps(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit(" "), F.hex(F.xxhash64(F.lit("second"), *columns)))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def local_forest(u, v):
    """Edges of a spanning forest of the edges (u, v) given as integer arrays: (child, root) pairs, root the smallest.

    Runs over one bounded batch at a time.
    """
    import numpy as np

    if not len(u):
        return u, v
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # pointer jumping
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def shrink_edges(edges: DataFrame) -> DataFrame:
    """Replaces the edges of each Arrow batch by a spanning forest of them: same components, no more edges than nodes."""
    import pyarrow as pa

    def shrink(batches):
        for batch in batches:
            u, v = local_forest(batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(shrink, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: rows (node, component), component the smallest node reachable.

    Alternates two star steps until nothing changes. Both hang a node's neighbours on its smallest
    neighbour; the smallest neighbour is a grouped min (combined before the shuffle) joined back, so no
    neighbour list is ever gathered and a hub only costs a joined row an edge. Each round is written to
    the shared folder. Nodes without an edge (or only to themselves) are not returned; an empty input
    gives an empty result. Null ends are ignored.
    """
    spark = edges.sparkSession
    e = shrink_edges(edges.where("u is not null and v is not null and u <> v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = written(e, "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest of the node's closed neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt, new_path = written(small.where("u <> v").distinct(), "edges")
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        e, path = nxt, new_path
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
