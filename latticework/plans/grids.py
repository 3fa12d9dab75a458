"""Stencils, transfers and sweeps on grids whose field, or whose coefficients, are sums over all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import coo, grid, sparse
from latticework.plans import derived
from latticework.plans.linear import rounded
from latticework.plans.registry import query

SIZES, BCS, CELL, RADIUS = (7, 6, 5), (0, 0, 1), (3.5, 3.0, 2.0), 2
NX, NY, NZ = SIZES
CUBE = f"(SELECT id, (id % {NX})::INT AS x, (id // {NX} % {NY})::INT AS y, (id // {NX * NY})::INT AS z FROM range({NX * NY * NZ}) t(id))"
CELLS = NX * NY * NZ
FIELD = derived.field_sql(SIZES)


def field(spark, sf_dir):
    return derived.field(spark, sf_dir, SIZES)


def values(offsets) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for a, b, c, w in offsets if w) + ") AS o(dx, dy, dz, c)"


def moved(axis: str, n: int, bc: int, d: str) -> str:
    return f"(({axis} + {d}) % {n} + {n}) % {n}" if bc == 0 else f"{axis} + {d}"


def apply_sql(offsets, bcs=BCS, digits: int = 6) -> str:
    """The stencil pulled from neighbours: the other way round from the operator's push."""
    on = " AND ".join(f"f.{a} = {moved('g.' + a, n, bc, 'o.d' + a)}" for a, n, bc in zip("xyz", SIZES, bcs))
    return f"SELECT g.x, g.y, g.z, round(sum(o.c * f.v), {digits}) AS v FROM {FIELD} g CROSS JOIN {values(offsets)} JOIN {FIELD} f ON {on} GROUP BY 1, 2, 3"


LAPLACE = grid.laplacian_offsets(SIZES, BCS, CELL, RADIUS)
WEIGHTS = [1.5, -0.75, 0.125]


@query(f"SELECT k, round(w, 12) AS w, round(w * c.v, 8) + 0.0 AS weighted FROM (SELECT k, CASE WHEN k = 0 THEN -2 * (SELECT sum(1.0 / (j * j)) FROM range(1, 7) r(j)) ELSE 2 * pow(-1, k + 1) * pow(factorial(6), 2) / (k * k * factorial((6 - k)::INT) * factorial((6 + k)::INT)) END AS w FROM range(7) t(k)) JOIN {derived.cells_sql(7)} c ON c.id = k")
def fd_weights(spark, sf_dir):
    """The weights, and each times the table's value for it."""
    w = spark.createDataFrame(list(enumerate(grid.fd_weights(6))), "k long, w double")
    met = w.join(derived.cells(spark, sf_dir, 7), F.col("k") == F.col("id"))
    return met.select("k", F.round("w", 12).alias("w"), (F.round(F.col("w") * F.col("v"), 8) + 0.0).alias("weighted"))


@query(apply_sql(LAPLACE))
def laplacian_apply(spark, sf_dir):
    return rounded(grid.laplacian(field(spark, sf_dir), SIZES, BCS, CELL, RADIUS), "v", digits=6)


@query(apply_sql(grid.three_axis_offsets(WEIGHTS), (1, 1, 1)))
def stencil_three_axis(spark, sf_dir):
    return rounded(grid.stencil(field(spark, sf_dir), grid.three_axis_offsets(WEIGHTS), SIZES, (1, 1, 1)), "v", digits=6)


@query(apply_sql(grid.cubed_centre_offsets(WEIGHTS), (1, 1, 1)))
def stencil_c0cubed(spark, sf_dir):
    return rounded(grid.stencil(field(spark, sf_dir), grid.cubed_centre_offsets(WEIGHTS), SIZES, (1, 1, 1)), "v", digits=6)


@query(apply_sql([(0, 0, 0, WEIGHTS[0])] + [(s * r, 0, 0, WEIGHTS[r]) for r in (1, 2) for s in (-1, 1)], (1, 1, 1)))
def stencil_window(spark, sf_dir):
    """One axis by lag and lead."""
    return rounded(grid.stencil_1d(field(spark, sf_dir), WEIGHTS), "v", digits=6)


def coo_sql(offsets, bcs=BCS, digits: int = 8) -> str:
    parts = {a: moved("g." + a, n, bc, "o.d" + a) for a, n, bc in zip("xyz", SIZES, bcs)}
    inside = " AND ".join(f"{parts[a]} BETWEEN 0 AND {n - 1}" for a, n in zip("xyz", SIZES))
    return f"SELECT g.id AS i, ({parts['x']} + ({parts['y']}) * {NX} + ({parts['z']}) * {NX * NY})::BIGINT AS j, round(sum(o.c), {digits}) AS v FROM {CUBE} g CROSS JOIN {values(offsets)} WHERE {inside} GROUP BY 1, 2"


@query(derived.columns_scaled_sql(coo_sql(LAPLACE, digits=13), CELLS, 6))
def laplacian_coo(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, grid.laplacian_coo(spark, SIZES, BCS, CELL, RADIUS), CELLS, 6)


@query(derived.columns_scaled_sql(coo_sql(LAPLACE, digits=13), CELLS, 6))
def laplacian_kron(spark, sf_dir):
    """The same matrix as Kronecker sums."""
    return derived.columns_scaled(spark, sf_dir, grid.kron_laplacian(spark, SIZES, BCS, CELL, RADIUS), CELLS, 6)


def _mixed_offsets():
    h = [length / (n - bc) for n, bc, length in zip(SIZES, BCS, CELL)]
    d = grid.first_derivative_weights(RADIUS)
    mixed = [(i, j, 0, 0.25 * d[i] * d[j] / h[0] / h[1]) for i in d for j in d]
    return LAPLACE + mixed


@query(derived.columns_scaled_sql(coo_sql(_mixed_offsets(), digits=13), CELLS, 6))
def laplacian_mixed(spark, sf_dir):
    """With a mixed xy derivative, as a sheared cell has."""
    return derived.columns_scaled(spark, sf_dir, grid.kron_laplacian(spark, SIZES, BCS, CELL, RADIUS, {"xx": 1.0, "yy": 1.0, "zz": 1.0, "xy": 0.25}), CELLS, 6)


@query(derived.columns_scaled_sql(coo_sql([(0, k, 0, w / (CELL[1] / (NY - BCS[1]))) for k, w in grid.first_derivative_weights(RADIUS).items()], digits=13), CELLS, 6))
def gradient_y(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, grid.gradient(spark, SIZES, BCS, CELL, RADIUS, 1), CELLS, 6)


_MX, _MY, _MZ = (n // 2 for n in SIZES)
_BOX = values([(a, b, c, 0.125 * 0.5 ** (abs(a) + abs(b) + abs(c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
_RP = {a: moved(f"(g.{a} * 2 + 1)", n, bc, "o.d" + a) for a, n, bc in zip("xyz", SIZES, BCS)}
RESTRICT = f"""SELECT g.id AS i, ({_RP['x']} + ({_RP['y']}) * {NX} + ({_RP['z']}) * {NX * NY})::BIGINT AS j, sum(o.c) AS v
  FROM (SELECT id, (id % {_MX})::INT AS x, (id // {_MX} % {_MY})::INT AS y, (id // {_MX * _MY})::INT AS z FROM range({_MX * _MY * _MZ}) t(id)) g CROSS JOIN {_BOX}
  WHERE {' AND '.join(f'{_RP[a]} BETWEEN 0 AND {n - 1}' for a, n in zip('xyz', SIZES))} GROUP BY 1, 2"""


@query(derived.columns_scaled_sql(RESTRICT, CELLS, 6))
def restrict(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, grid.restriction(spark, SIZES, BCS), CELLS, 6)


@query(derived.columns_scaled_sql(f"SELECT j AS i, i AS j, v * 8 AS v FROM ({RESTRICT})", _MX * _MY * _MZ, 6))
def prolong(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, grid.prolongation(spark, SIZES, BCS), _MX * _MY * _MZ, 6)


@query(derived.columns_scaled_sql(f"SELECT j AS i, i AS j, v * 8 AS v FROM ({RESTRICT})", _MX * _MY * _MZ, 6))
def prolong_kron(spark, sf_dir):
    """Linear interpolation as a Kronecker product: the same matrix."""
    return derived.columns_scaled(spark, sf_dir, grid.kron_prolongation(spark, SIZES, BCS), _MX * _MY * _MZ, 6)


_S2 = [[0.0, -1.0, 0.0], [-1.0, 8.0, -2.0], [0.0, -1.0, 0.5]]


@query(derived.columns_scaled_sql(f"""SELECT (g.id)::BIGINT AS i, ((x + dx) * 9 + y + dy)::BIGINT AS j, c AS v FROM (SELECT id, id // 9 AS x, id % 9 AS y FROM range(72) t(id)) g
  CROSS JOIN (VALUES {', '.join(f'({a - 1}, {b - 1}, {_S2[a][b]}::DOUBLE)' for a in range(3) for b in range(3) if _S2[a][b])}) o(dx, dy, c) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 8""", 72, 6))
def stencil_matrix_2d(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, grid.stencil_matrix(spark, (8, 9), _S2), 72, 6)


@query(derived.columns_scaled_sql(f"""SELECT (g.id)::BIGINT AS i, ((x + dx) * 20 + (y + dy) * 5 + z + dz)::BIGINT AS j, c AS v FROM (SELECT id, id // 20 AS x, id // 5 % 4 AS y, id % 5 AS z FROM range(60) t(id)) g
  CROSS JOIN {values([(0, 0, 0, 6.0)] + [tuple(s if a == k else 0 for a in range(3)) + (-1.0,) for k in range(3) for s in (-1, 1)])} WHERE x + dx BETWEEN 0 AND 2 AND y + dy BETWEEN 0 AND 3 AND z + dz BETWEEN 0 AND 4""", 60, 6))
def stencil_matrix_3d(spark, sf_dir):
    import numpy as np

    s = np.zeros((3, 3, 3))
    s[1, 1, 1] = 6.0
    for k in range(3):
        for d in (0, 2):
            s[tuple(d if a == k else 1 for a in range(3))] = -1.0
    return derived.columns_scaled(spark, sf_dir, grid.stencil_matrix(spark, (3, 4, 5), s), 60, 6)


@query()
def inverse_stencil(spark, sf_dir):
    """An inverse-stencil preconditioner as a matrix; the inverse is taken on the driver, tests compare."""
    return derived.columns_scaled(spark, sf_dir, grid.inverse_stencil_matrix(spark, (8, 9), [[0, -1, 0], [-1, 4.5, -1], [0, -1, 0]], 2), 72, 8)


@query(f"""SELECT x + a * {NX} AS x, y + b * {NY} AS y, z, v FROM {FIELD} CROSS JOIN (VALUES (-1), (0), (1)) s(a) CROSS JOIN (VALUES (-1), (0), (1)) t(b)
  WHERE x + a * {NX} BETWEEN -2 AND {NX + 1} AND y + b * {NY} BETWEEN -2 AND {NY + 1}""")
def halo(spark, sf_dir):
    return grid.halo(field(spark, sf_dir), SIZES, BCS, RADIUS)


@query(f"SELECT x - 1 + 10 AS x, y - 2 AS y, z AS z, v FROM {FIELD} WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 4 AND z BETWEEN 0 AND 1")
def block_copy_3d(spark, sf_dir):
    return grid.block_copy_3d(field(spark, sf_dir), (1, 2, 0), (4, 3, 2), (10, 0, 0))


_JX, _JY, _JK = 9, 8, 5


def _jacobi_sql() -> str:
    s = f"WITH s0 AS MATERIALIZED (SELECT (id % {_JX})::INT AS x, (id // {_JX})::INT AS y, CASE WHEN id % {_JX} IN (0, {_JX - 1}) THEN sin((id // {_JX}) * 2.0 * 3.141592653589793 / {_JY - 1}) ELSE c.v / 1000 END AS v FROM {derived.cells_sql(_JX * _JY)} c)"
    for k in range(1, _JK + 1):
        near = " OR ".join(f"(n.x = s.x + ({dx}) AND n.y = (s.y + ({dy}) + {_JY}) % {_JY})" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        s += f""", s{k} AS MATERIALIZED (SELECT s.x, s.y, sum(n.v) * 0.25 AS v FROM s{k - 1} s JOIN s{k - 1} n ON {near} WHERE s.x BETWEEN 1 AND {_JX - 2} GROUP BY 1, 2
          UNION ALL SELECT x, y, v FROM s{k - 1} WHERE x IN (0, {_JX - 1}))"""
    return s + f" SELECT x, y, round(v, 10) AS v FROM s{_JK}"


@query(_jacobi_sql())
def jacobi_k(spark, sf_dir):
    inner = derived.cells(spark, sf_dir, _JX * _JY).select((F.col("id") % _JX).cast("int").alias("x"), F.floor(F.col("id") / _JX).cast("int").alias("y"), (F.col("v") / 1000).alias("v"))
    a, _ = grid.jacobi(spark, _JX, _JY, _JK, inner=inner)
    return rounded(a, "v", digits=10)


@query(f"""WITH a AS ({derived.columns_scaled_sql(coo_sql(LAPLACE, digits=13), CELLS, 12)}), r AS ({RESTRICT}) SELECT r1.i AS i, r2.i AS j, round(sum(r1.v * a.v * r2.v * 8), 10) AS v FROM r r1 JOIN a ON r1.j = a.i JOIN r r2 ON a.j = r2.j GROUP BY 1, 2""")
def coarse_operator(spark, sf_dir):
    """R A P of the grid Laplacian."""
    r = grid.restriction(spark, SIZES, BCS)
    p = coo.transpose(r).withColumn("v", F.col("v") * 8.0)
    return rounded(sparse.triple_product(r, derived.columns_scaled(spark, sf_dir, grid.laplacian_coo(spark, SIZES, BCS, CELL, RADIUS), CELLS, 12), p), "v", digits=10)
