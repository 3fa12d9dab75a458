"""Stencils on regular grids (x, y, z, v), x fastest in the linear id x + nx (y + ny z).

A stencil pushes each cell's value to its neighbours: an explode over a bounded list of offsets and a grouped sum that
is combined before the shuffle. A boundary condition is 0 for periodic and 1 for zero outside.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Offsets = list[tuple[int, int, int, float]]


def fd_weights(radius: int) -> list[float]:
    """Weights of the second derivative, w[0] the centre: w[k] = 2 (-1)^(k+1) (n!)^2 / (k^2 (n-k)! (n+k)!), and the centre
    takes what makes the weights sum to zero in the limit, -2 times the sum of 1 / k^2."""
    n = radius
    rest = [2.0 * (-1) ** (k + 1) * factorial(n) ** 2 / (k * k * factorial(n - k) * factorial(n + k)) for k in range(1, n + 1)]
    return [-2.0 * sum(1.0 / (k * k) for k in range(1, n + 1)), *rest]


def axis_offsets(weights: list[list[float]], centre: float | None = None) -> Offsets:
    """Offsets along three axes from each axis's weights; ``centre`` replaces the sum of their centres."""
    out = [(0, 0, 0, sum(w[0] for w in weights) if centre is None else centre)]
    for axis, w in enumerate(weights):
        for r in range(1, len(w)):
            for s in (-r, r):
                out.append((*[s if a == axis else 0 for a in range(3)], w[r]))
    return out


def laplacian_offsets(sizes: tuple[int, int, int], bcs: tuple[int, int, int], cell: tuple[float, float, float], radius: int) -> Offsets:
    w = fd_weights(radius)
    return axis_offsets([[x / (length / (n - bc)) ** 2 for x in w] for n, bc, length in zip(sizes, bcs, cell)])


def cubed_centre_offsets(weights: list[float]) -> Offsets:
    """One set of weights on three axes with the centre weight cubed (not tripled): an operator of its own."""
    return axis_offsets([weights] * 3, centre=weights[0] ** 3)


def three_axis_offsets(weights: list[float]) -> Offsets:
    """One set of weights on three axes, the centre three times its weight."""
    return axis_offsets([weights] * 3, centre=3.0 * weights[0])


def grid(spark: SparkSession, sizes: tuple[int, int, int], value: Column | None = None) -> DataFrame:
    """All cells; ``value`` may use x, y, z and id."""
    nx, ny, nz = sizes
    ids = spark.range(nx * ny * nz)
    cells = ids.select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"), "id")
    return cells.select("x", "y", "z", (F.lit(0.0) if value is None else value.cast("double")).alias("v"))


def _moved(axis: str, shift: Column, n: int, bc: int) -> Column:
    at = F.col(axis) + shift
    return F.pmod(at, F.lit(n)) if bc == 0 else F.when(at.between(0, n - 1), at)


def stencil(field: DataFrame, offsets: Offsets, sizes: tuple[int, int, int], bcs: tuple[int, int, int]) -> DataFrame:
    """out(p) = sum over offsets of c v(p + offset): each cell pushes to p - offset."""
    table = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(-dz).alias("dz"), F.lit(float(c)).alias("c")) for dx, dy, dz, c in offsets if c])
    pushed = field.select("x", "y", "z", "v", F.explode(table).alias("o"))
    to = [_moved(a, F.col(f"o.d{a}"), n, bc).cast("int").alias(a) for a, n, bc in zip("xyz", sizes, bcs)]
    landed = pushed.select(*to, (F.col("v") * F.col("o.c")).alias("v")).where("x is not null and y is not null and z is not null")
    return landed.groupBy("x", "y", "z").agg(F.sum("v").alias("v"))


def laplacian(field: DataFrame, sizes, bcs, cell, radius: int) -> DataFrame:
    return stencil(field, laplacian_offsets(sizes, bcs, cell, radius), sizes, bcs)


def stencil_1d(field: DataFrame, weights: list[float], axis: str = "x") -> DataFrame:
    """One axis, zero outside, by a window over each grid line: no row is multiplied."""
    from pyspark.sql import Window as W

    line = W.partitionBy(*[a for a in "xyz" if a != axis]).orderBy(axis)
    total = F.col("v") * weights[0]
    for r in range(1, len(weights)):
        total = total + (F.coalesce(F.lag("v", r).over(line), F.lit(0.0)) + F.coalesce(F.lead("v", r).over(line), F.lit(0.0))) * weights[r]
    return field.select("x", "y", "z", total.alias("v"))


def halo(field: DataFrame, sizes, bcs, radius: int) -> DataFrame:
    """The field with ``radius`` cells around it: periodic copies, or zeros where nothing is stored (not stored)."""
    shifts = [[(0, 0)] if bc else [(0, 0), (-1, n), (1, n)] for n, bc in zip(sizes, bcs)]
    moves = F.array(*[F.struct(F.lit(a * n).alias("x"), F.lit(b * m).alias("y"), F.lit(c * k).alias("z")) for a, n in shifts[0] for b, m in shifts[1] for c, k in shifts[2]])
    spread = field.select(*"xyz", "v", F.explode(moves).alias("m")).select(*[(F.col(a) + F.col(f"m.{a}")).alias(a) for a in "xyz"], "v")
    for a, n in zip("xyz", sizes):
        spread = spread.where(F.col(a).between(-radius, n - 1 + radius))
    return spread


def block_copy_3d(field: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int], to: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    for a, s, n in zip("xyz", start, size):
        field = field.where(F.col(a).between(s, s + n - 1))
    return field.select(*[(F.col(a) - s + t).alias(a) for a, s, t in zip("xyz", start, to)], "v")


def stencil_coo(spark: SparkSession, offsets: Offsets, sizes, bcs) -> DataFrame:
    """The stencil as a matrix (i, j, v) over linear ids; offsets that wrap to one cell add up."""
    nx, ny, _ = sizes
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(float(c)).alias("v")) for dx, dy, dz, c in offsets if c])
    cells = grid(spark, sizes).select("x", "y", "z", F.explode(table).alias("o"))
    at = [_moved(a, F.col(f"o.d{a}"), n, bc).cast("long").alias(f"{a}2") for a, n, bc in zip("xyz", sizes, bcs)]
    linear = lambda x, y, z: F.col(x).cast("long") + F.col(y).cast("long") * nx + F.col(z).cast("long") * (nx * ny)
    kept = cells.select("x", "y", "z", "o.v", *at).where("x2 is not null and y2 is not null and z2 is not null")
    return kept.select(linear("x", "y", "z").alias("i"), linear("x2", "y2", "z2").alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def laplacian_coo(spark: SparkSession, sizes, bcs, cell, radius: int) -> DataFrame:
    return stencil_coo(spark, laplacian_offsets(sizes, bcs, cell, radius), sizes, bcs)


def restriction(spark: SparkSession, sizes, bcs) -> DataFrame:
    """Trilinear restriction to every second cell: weight 1/8 halved for each step away. Coarse size floor(n / 2)."""
    box = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    table = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz"), F.lit(0.125 * 0.5 ** (abs(x) + abs(y) + abs(z))).alias("v")) for x, y, z in box])
    nx, ny, _ = sizes
    mx, my, mz = (n // 2 for n in sizes)
    coarse = grid(spark, (mx, my, mz)).select(*[(F.col(a) * 2 + 1).alias(a) for a in "xyz"], (F.col("x") + F.col("y") * mx + F.col("z") * (mx * my)).cast("long").alias("i"), F.explode(table).alias("o"))
    at = [_moved(a, F.col(f"o.d{a}"), n, bc).cast("long").alias(f"{a}2") for a, n, bc in zip("xyz", sizes, bcs)]
    kept = coarse.select("i", "o.v", *at).where("x2 is not null and y2 is not null and z2 is not null")
    return kept.select("i", (F.col("x2") + F.col("y2") * nx + F.col("z2") * (nx * ny)).alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def prolongation(spark: SparkSession, sizes, bcs) -> DataFrame:
    """8 times the restriction's transpose."""
    return restriction(spark, sizes, bcs).select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * 8.0).alias("v"))


def axis_matrix(spark: SparkSession, n: int, weights: dict[int, float], bc: int) -> DataFrame:
    """A one-dimensional stencil as (i, j, v)."""
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(c)).alias("v")) for d, c in weights.items() if c])
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(table).alias("o")).select("i", (F.col("i") + F.col("o.d")).alias("j"), "o.v")
    cells = cells.withColumn("j", F.pmod("j", F.lit(n))) if bc == 0 else cells.where(F.col("j").between(0, n - 1))
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))


def first_derivative_weights(radius: int) -> dict[int, float]:
    """w[k] = (-1)^(k+1) (n!)^2 / (k (n-k)! (n+k)!), odd in k."""
    n = radius
    out = {}
    for k in range(1, n + 1):
        w = (-1) ** (k + 1) * factorial(n) ** 2 / (k * factorial(n - k) * factorial(n + k))
        out[k], out[-k] = w, -w
    return out


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def kron_laplacian(spark: SparkSession, sizes, bcs, cell, radius: int, metric: dict[str, float] | None = None) -> DataFrame:
    """Second derivatives of a possibly sheared cell as Kronecker sums: metric gives the factors of xx, yy, zz, xy, xz, yz
    (1, 1, 1, 0, 0, 0 by default, the plain Laplacian); a mixed term is the product of two first derivatives."""
    from latticework.operators.coo import kron

    metric = {"xx": 1.0, "yy": 1.0, "zz": 1.0} if metric is None else metric
    h = [length / (n - bc) for n, bc, length in zip(sizes, bcs, cell)]
    w = fd_weights(radius)
    second = [axis_matrix(spark, n, {0: w[0] / s**2} | {d * r: w[r] / s**2 for r in range(1, radius + 1) for d in (-1, 1)}, bc) for n, s, bc in zip(sizes, h, bcs)]
    first = [axis_matrix(spark, n, {k: c / s for k, c in first_derivative_weights(radius).items()}, bc) for n, s, bc in zip(sizes, h, bcs)]
    total = None
    for name, factor in metric.items():
        if not factor:
            continue
        a, b = ("xyz".index(c) for c in name)
        parts = [second[k] if a == b == k else first[k] if k in (a, b) else identity(spark, sizes[k]) for k in range(3)]
        yz = kron(parts[2], parts[1], sizes[1], sizes[1])
        term = kron(yz, parts[0], sizes[0], sizes[0]).withColumn("v", F.col("v") * factor)
        total = term if total is None else total.unionByName(term)
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


def gradient(spark: SparkSession, sizes, bcs, cell, radius: int, axis: int) -> DataFrame:
    from latticework.operators.coo import kron

    h = cell[axis] / (sizes[axis] - bcs[axis])
    parts = [axis_matrix(spark, n, {k: c / h for k, c in first_derivative_weights(radius).items()}, bc) if k2 == axis else identity(spark, n) for k2, (n, bc) in enumerate(zip(sizes, bcs))]
    return kron(kron(parts[2], parts[1], sizes[1], sizes[1]), parts[0], sizes[0], sizes[0])


def kron_prolongation(spark: SparkSession, sizes, bcs) -> DataFrame:
    """Linear interpolation on each axis (1/2, 1, 1/2 around every second cell), as a Kronecker product."""
    from latticework.operators.coo import kron

    def one(n: int, bc: int) -> DataFrame:
        table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(v).alias("v")) for d, v in ((-1, 0.5), (0, 1.0), (1, 0.5))])
        cells = spark.range(n // 2).select(F.col("id").alias("j"), F.explode(table).alias("o")).select((F.col("j") * 2 + 1 + F.col("o.d")).alias("i"), "j", "o.v")
        return (cells.withColumn("i", F.pmod("i", F.lit(n))) if bc == 0 else cells.where(F.col("i").between(0, n - 1))).groupBy("i", "j").agg(F.sum("v").alias("v"))

    p = [one(n, bc) for n, bc in zip(sizes, bcs)]
    return kron(kron(p[2], p[1], sizes[1], sizes[1] // 2), p[0], sizes[0], sizes[0] // 2)


def stencil_matrix(spark: SparkSession, shape: tuple[int, ...], coefficients) -> DataFrame:
    """An arbitrary odd-sized 2-D or 3-D stencil (nested lists or an array) on a grid of ``shape``, zero outside; ids run
    with the last axis fastest; zero coefficients are dropped."""
    import numpy as np

    c = np.asarray(coefficients, float)
    half = [s // 2 for s in c.shape]
    names = [f"d{k}" for k in range(c.ndim)]
    table = F.array(*[F.struct(*[F.lit(int(p - h)).alias(d) for p, h, d in zip(at, half, names)], F.lit(float(c[at])).alias("v")) for at in np.ndindex(c.shape) if c[at] != 0])
    total, step, axes = int(np.prod(shape)), 1, []
    for k in range(len(shape) - 1, -1, -1):
        axes.insert(0, F.floor(F.col("id") / step) % shape[k])
        step *= shape[k]
    cells = spark.range(total).select("id", *[a.alias(f"p{k}") for k, a in enumerate(axes)], F.explode(table).alias("o"))
    j, inside = F.lit(0).cast("long"), F.lit(True)
    for k, n in enumerate(shape):
        at = F.col(f"p{k}") + F.col(f"o.d{k}")
        inside = inside & at.between(0, n - 1)
        j = j * n + at
    return cells.where(inside).select(F.col("id").alias("i"), j.alias("j"), "o.v")


def inverse_stencil(coefficients, extend: int = 1):
    """The middle row of the inverse of the stencil's matrix on a small grid (stencil size + 2 extend), as a stencil."""
    import numpy as np

    c = np.asarray(coefficients, float)
    size = c.shape[0] + 2 * max(1, extend)
    shape = (size,) * c.ndim
    n = size**c.ndim
    a = np.zeros((n, n))
    for i, p in enumerate(np.ndindex(shape)):
        for at in np.ndindex(c.shape):
            q = tuple(x + y - s // 2 for x, y, s in zip(p, at, c.shape))
            if all(0 <= x < size for x in q):
                a[i, np.ravel_multi_index(q, shape)] = c[at]
    return np.linalg.inv(a)[(n + 1) // 2 - 1].reshape(shape)


def inverse_stencil_matrix(spark: SparkSession, shape: tuple[int, ...], coefficients, extend: int = 1) -> DataFrame:
    return stencil_matrix(spark, shape, inverse_stencil(coefficients, extend))


def support_inverse_stencil(shape: tuple[int, ...], coefficients):
    """The inverse of the stencil's matrix among the cells of the stencil itself, its column of the middle cell, as a stencil. Cells
    count by their distance in the order of a grid of this shape, the last axis fastest."""
    import numpy as np

    c = np.asarray(coefficients, float)
    strides = [int(np.prod(shape[k + 1 :])) for k in range(len(shape))]
    cells = np.argwhere(c != 0)
    away = (cells - np.array(c.shape) // 2) @ np.array(strides)
    value = {int(d): c[tuple(at)] for d, at in zip(away, cells)}
    among = np.array([[value.get(int(d - e), 0.0) for e in away] for d in away])
    out = np.zeros_like(c)
    out[tuple(cells.T)] = np.linalg.inv(among)[:, int(np.flatnonzero(away == 0)[0])]
    return out


def jacobi_start(spark: SparkSession, nx: int, ny: int, inner: DataFrame | None = None) -> DataFrame:
    """Rows (x, y, v): zero inside (or ``inner``'s values (x, y, v), all cells), sin(2 pi y / (ny - 1)) on the left and right edges; y runs over ny rows that wrap."""
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    edge = F.sin(F.col("y") * (2.0 * 3.141592653589793) / (ny - 1))
    if inner is not None:
        cells = cells.join(inner, ["x", "y"])
    return cells.select("x", "y", F.when(F.col("x").isin(0, nx - 1), edge).otherwise(F.lit(0.0) if inner is None else F.col("v")).alias("v"))


def jacobi_sweep(a: DataFrame, nx: int, ny: int) -> DataFrame:
    """One sweep: inner columns become the mean of their four neighbours (y wraps), edges stay."""
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    pushed = a.select((F.col("x")).alias("x"), "y", "v", F.explode(table).alias("o"))
    near = pushed.select((F.col("x") + F.col("o.dx")).alias("x"), F.pmod(F.col("y") + F.col("o.dy"), F.lit(ny)).alias("y"), (F.col("v") * 0.25).alias("v"))
    inner = near.where(F.col("x").between(1, nx - 2)).groupBy("x", "y").agg(F.sum("v").alias("v"))
    return inner.unionByName(a.where(F.col("x").isin(0, nx - 1)))


def jacobi(spark: SparkSession, nx: int, ny: int, sweeps: int, tolerance: float = 0.0, lag: bool = True, inner: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Sweeps and their residual norms (2-norm of the change); stops under ``tolerance``, one sweep late with ``lag``."""
    from latticework.tables import Steps

    steps, norms = Steps(), []
    a = steps.cut(jacobi_start(spark, nx, ny, inner))
    for _ in range(sweeps):
        b = steps.cut(jacobi_sweep(a, nx, ny))
        change = b.alias("n").join(a.alias("o"), ["x", "y"]).agg(F.sqrt(F.sum(F.pow(F.col("n.v") - F.col("o.v"), 2)))).first()[0]
        seen = norms[-1] if lag and norms else change
        norms.append(change)
        steps.forget(steps.mark() - 1)
        a = b
        if tolerance and (len(norms) > 1 or not lag) and seen < tolerance:
            break
    return a, norms
