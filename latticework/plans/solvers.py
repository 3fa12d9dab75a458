"""Iterative solvers on small grids, with right-hand sides from all parts. A fixed number of steps makes results exact to compare; the SQL unrolls it."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import grid, solve
from latticework.plans import derived
from latticework.plans.linear import rounded
from latticework.plans.registry import query

SIZES, BCS, CELL, RADIUS = (5, 5, 5), (1, 1, 1), (2.0, 2.0, 2.0), 1
N = 125
OFFSETS = [(a, b, c, -w) for a, b, c, w in grid.laplacian_offsets(SIZES, BCS, CELL, RADIUS)]  # positive definite


def matrix(spark):
    from latticework.tables import cut

    return cut(grid.stencil_coo(spark, OFFSETS, SIZES, BCS))


def right_side(spark, sf_dir):
    return derived.vector(spark, sf_dir, N).select("i", (F.col("v") % 114 - 20).alias("v"))


def _matrix_sql() -> str:
    rows = ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for a, b, c, w in OFFSETS)
    return f"""a AS MATERIALIZED (SELECT id AS i, (id + dx + dy * 5 + dz * 25)::BIGINT AS j, w AS v FROM (SELECT id, id % 5 AS x, id // 5 % 5 AS y, id // 25 AS z FROM range({N}) t(id))
      CROSS JOIN (VALUES {rows}) o(dx, dy, dz, w) WHERE x + dx BETWEEN 0 AND 4 AND y + dy BETWEEN 0 AND 4 AND z + dz BETWEEN 0 AND 4),
      b AS MATERIALIZED (SELECT id AS i, v % 114 - 20 AS v FROM {derived.cells_sql(N)})"""


def _power_sql(k: int) -> str:
    s = f"WITH {_matrix_sql()}, x0 AS MATERIALIZED (SELECT i, v FROM b)"
    for n in range(1, k + 1):
        s += f", y{n} AS MATERIALIZED (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x{n - 1} x ON a.j = x.i GROUP BY 1), x{n} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM y{n}) AS v FROM y{n})"
    return s + f" SELECT i, round(v, 8) AS v FROM x{k}"


def _cg_sql(k: int) -> str:
    s = f"WITH {_matrix_sql()}, s0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS x, v AS r, v AS p FROM b)"
    for n in range(1, k + 1):
        p = n - 1
        s += f""", ap{n} AS MATERIALIZED (SELECT a.i, sum(a.v * s.p) AS v FROM a JOIN s{p} s ON a.j = s.i GROUP BY 1),
          al{n} AS MATERIALIZED (SELECT (SELECT sum(r * r) FROM s{p}) / sum(s.p * ap.v) AS alpha FROM s{p} s JOIN ap{n} ap USING (i)),
          t{n} AS MATERIALIZED (SELECT s.i, s.x + alpha * s.p AS x, s.r - alpha * ap.v AS r, s.p FROM s{p} s JOIN ap{n} ap USING (i) CROSS JOIN al{n}),
          s{n} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM t{n}) / (SELECT sum(r * r) FROM s{p}) * p AS p FROM t{n})"""
    return s + f" SELECT i, round(x, 6) AS v FROM s{k}"


@query(_power_sql(5))
def power_iter_k(spark, sf_dir):
    x, _ = solve.power_iteration(solve.operator(matrix(spark)), right_side(spark, sf_dir), 5)
    return rounded(x, "v", digits=8)


@query(_cg_sql(3))
def cg_k(spark, sf_dir):
    return rounded(solve.conjugate_gradient(solve.operator(matrix(spark)), right_side(spark, sf_dir), 0.0, 3).x, "v", digits=6)


#: what a solver's solution gives back: A x, which SQL compares with the right-hand side
_BACK = f"SELECT id AS i, round(v % 114 - 20, 5) AS v FROM {derived.cells_sql(N)}"


def _back(a, solution: solve.Solution):
    from latticework.operators.sparse import spmv

    return rounded(spmv(a, solution.x), "v", digits=5).withColumn("v", F.col("v") + 0.0)


@query(_BACK)
def bicgstab(spark, sf_dir):
    a, b = matrix(spark), right_side(spark, sf_dir)
    return _back(a, solve.bicgstab(solve.operator(a), b, 1e-9, 40))


@query(_BACK)
def pcg(spark, sf_dir):
    from latticework.operators.blas import diagonal_scale
    from latticework.operators.coo import diagonal

    a, b = matrix(spark), right_side(spark, sf_dir)
    inverse = diagonal(a).select("i", (1.0 / F.col("v")).alias("v"))
    return _back(a, solve.conjugate_gradient(solve.operator(a), b, 1e-9, 40, precondition=lambda r: diagonal_scale(inverse, r)))


@query(_BACK)
def aar(spark, sf_dir):
    a, b = matrix(spark), right_side(spark, sf_dir)
    return _back(a, solve.anderson_richardson(solve.operator(a), b, OFFSETS[0][3], 1e-9, 80))


@query(_BACK)
def gmres(spark, sf_dir):
    a, b = matrix(spark), right_side(spark, sf_dir)
    return _back(a, solve.gmres(solve.operator(a), b, 15, 1e-9, 60))


@query(f"SELECT id AS i, round(v % 114 - (SELECT avg(v % 114) FROM {derived.cells_sql(64)}), 4) + 0.0 AS v FROM {derived.cells_sql(64)}")
def multigrid(spark, sf_dir):
    """Periodic in all directions: the right-hand side is projected and the coarsest level uses the pseudo-inverse. A x is the right-hand
    side less its mean."""
    sizes = (4, 4, 4)
    m = solve.Multigrid(spark, sizes, (0, 0, 0), (2.0, 2.0, 2.0), 1, 1)
    b = derived.vector(spark, sf_dir, 64).select("i", (F.col("v") % 114).alias("v"))
    s = m.solve(b, 1e-7, 40, project=True)
    return _back(m.a[0], s).withColumn("v", F.round("v", 4) + 0.0)
