"""Fourier transforms of grid fields (x, y, z, re, im) and Poisson solvers on them.

A transform goes axis by axis: grid lines along an axis stand together, and a task transforms all whole lines of an Arrow batch
at once; lines are spread over all tasks. ``dft_join`` is the same by a join with all frequencies, for small sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.grid import fd_weights
from latticework.tables import n_partitions


def complex_field(field: DataFrame) -> DataFrame:
    return field.select("x", "y", "z", F.col("v").alias("re"), F.lit(0.0).alias("im"))


def fft_axis(field: DataFrame, axis: str, n: int, inverse: bool = False) -> DataFrame:
    """One axis; cells that are missing count as zero."""
    rest = [a for a in "xyz" if a != axis]
    names = ["x", "y", "z", "re", "im"]

    def transformed(cells: dict[str, np.ndarray]) -> pa.RecordBatch:
        first = np.r_[True, (cells[rest[0]][1:] != cells[rest[0]][:-1]) | (cells[rest[1]][1:] != cells[rest[1]][:-1])]
        line = np.cumsum(first) - 1
        v = np.zeros((line[-1] + 1, n), complex)
        v[line, cells[axis]] = cells["re"] + 1j * cells["im"]
        v = (np.fft.ifft(v, axis=1) if inverse else np.fft.fft(v, axis=1)).ravel()
        out = {axis: np.tile(np.arange(n, dtype=np.int32), line[-1] + 1), "re": v.real, "im": v.imag}
        out |= {r: np.repeat(cells[r][first], n).astype(np.int32) for r in rest}
        return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    def run(batches):
        left = None  # the last line of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if left is not None:
                cells = {c: np.concatenate([left[c], cells[c]]) for c in names}
            same = (cells[rest[0]] == cells[rest[0]][-1]) & (cells[rest[1]] == cells[rest[1]][-1])
            cut = int(np.argmax(same))  # lines are sorted, so these are the last ones
            left = {c: v[cut:] for c, v in cells.items()}
            if cut:
                yield transformed({c: v[:cut] for c, v in cells.items()})
        if left is not None:
            yield transformed(left)

    typed = field.select(*[F.col(c).cast("int").alias(c) for c in "xyz"], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    together = typed.repartition(n_partitions(field.sparkSession, field), *rest).sortWithinPartitions(*rest)
    return together.mapInArrow(run, "x int, y int, z int, re double, im double")


def fft3(field: DataFrame, sizes: tuple[int, int, int], inverse: bool = False) -> DataFrame:
    for axis, n in zip("xyz", sizes):
        if n > 1:
            field = fft_axis(field, axis, n, inverse)
    return field


def half_spectrum(full: DataFrame, nx: int) -> DataFrame:
    """The part a real-input transform stores: x up to nx / 2."""
    return full.where(F.col("x") <= nx // 2)


def unpack_half(half: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """The whole spectrum of a real field from its stored half: F(-k) is the conjugate of F(k)."""
    nx, ny, nz = sizes
    mirrored = half.where((F.col("x") > 0) & (F.col("x") < nx - nx // 2)).select(
        (F.lit(nx) - F.col("x")).cast("int").alias("x"), F.pmod(-F.col("y"), F.lit(ny)).cast("int").alias("y"), F.pmod(-F.col("z"), F.lit(nz)).cast("int").alias("z"), "re", (-F.col("im")).alias("im")
    )
    return half.unionByName(mirrored)


def dft_join(line: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """DFT of one line (k, v) of length n: every frequency meets every sample, by an equality join on blocks of frequencies; for
    small n. Rows (f, re, im)."""
    spark = line.sparkSession
    blocks = -(-n // block)
    angle = F.lit(-2.0 * np.pi / n) * ((F.col("f") * F.col("k")) % n)
    frequencies = spark.range(n).select(F.col("id").alias("f"), (F.col("id") % blocks).cast("int").alias("block"))
    met = line.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(frequencies, "block")
    return met.groupBy("f").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))


def poisson_periodic(rhs: DataFrame, sizes: tuple[int, int, int], cell: tuple[float, float, float], radius: int) -> DataFrame:
    """u with -Laplacian(u) = rhs less its mean, u of mean zero, for the finite-difference Laplacian of ``radius``."""
    w = fd_weights(radius)
    symbol = F.lit(0.0)
    for axis, n, length in zip("xyz", sizes, cell):
        h2 = (length / n) ** 2
        line = F.lit(w[0] / h2)
        for r in range(1, radius + 1):
            line = line + F.cos(F.col(axis) * (2.0 * np.pi * r / n)) * (2.0 * w[r] / h2)
        symbol = symbol - line
    hat = fft3(complex_field(rhs), sizes).withColumn("d", symbol)
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    divided = [F.when(zero | (F.col("d") == 0), 0.0).otherwise(F.col(c) / F.when(F.col("d") == 0, 1.0).otherwise(F.col("d"))).alias(c) for c in ("re", "im")]
    u = fft3(hat.select("x", "y", "z", *divided), sizes, inverse=True).select("x", "y", "z", F.col("re").alias("v"))
    mean = u.agg(F.avg("v").alias("m"))
    return u.crossJoin(F.broadcast(mean)).select("x", "y", "z", (F.col("v") - F.col("m")).alias("v"))


def poisson_zero(rhs: DataFrame, sizes: tuple[int, int, int], spacing: float) -> DataFrame:
    """u = 0 on the boundary with Laplacian(u) = rhs at the inner points 0 .. m-1 of each axis (size 1: no axis), for the
    second-order Laplacian: an odd extension to 2 (m + 1) points makes it periodic."""
    ext = tuple(1 if m == 1 else 2 * (m + 1) for m in sizes)
    field = rhs
    for axis, m, n in zip("xyz", sizes, ext):
        if m == 1:
            continue
        a = F.col(axis)
        flips = F.array(F.struct((a + 1).alias("p"), F.lit(1.0).alias("s")), F.struct((F.lit(n - 1) - a).alias("p"), F.lit(-1.0).alias("s")))
        field = field.withColumn("f", F.explode(flips)).withColumn(axis, F.col("f.p").cast("int")).withColumn("v", F.col("v") * F.col("f.s")).drop("f")
    mu = F.lit(0.0)
    for axis, m, n in zip("xyz", sizes, ext):
        if m > 1:
            mu = mu + F.pow(F.sin(F.col(axis) * (np.pi / n)), 2) * (4.0 / spacing**2)
    hat = fft3(complex_field(field), ext).withColumn("mu", mu)
    divided = [F.when(F.col("mu") == 0, 0.0).otherwise(-F.col(c) / F.when(F.col("mu") == 0, 1.0).otherwise(F.col("mu"))).alias(c) for c in ("re", "im")]
    u = fft3(hat.select("x", "y", "z", *divided), ext, inverse=True)
    for axis, m in zip("xyz", sizes):
        if m > 1:
            u = u.where(F.col(axis).between(1, m)).withColumn(axis, F.col(axis) - 1)
    return u.select("x", "y", "z", F.col("re").alias("v"))
