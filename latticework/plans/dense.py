"""Factorizations of the embeddings, mixed precision and spectral solvers. What SQL can check is the factors' product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import coo, factor, grid, mixed, spectral
from latticework.plans import derived
from latticework.plans.linear import rounded
from latticework.plans.registry import query
from latticework.tables import table

def whole(spark, sf_dir):
    """All entries of the embeddings."""
    return factor.tall(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def width_of(rows) -> int:
    return rows.agg(F.max(F.size("v"))).first()[0]


def product_of(q, r: np.ndarray):
    """Q R and Q'Q - I of rows and a small factor, as (name, i, j, v)."""
    from latticework.operators.sparse import gram_rows

    again = factor.times(q, r).select("i", F.posexplode("v").alias("j", "v"))
    ident = gram_rows(q, "v").withColumn("v", F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double")))
    return again.select(F.lit("qr").alias("name"), "i", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v")).unionByName(ident.select(F.lit("orthogonality").alias("name"), "i", "j", F.round("v", 6).alias("v")))


@query()
def eigh_topk(spark, sf_dir):
    """The largest ten eigenvalues of A'A with the residuals of their vectors."""
    from latticework.operators.sparse import gram_rows

    rows = whole(spark, sf_dir)
    g = factor.small(gram_rows(rows, "v"))
    w, v = factor.eigh_gram(rows)
    return spark.createDataFrame([(k, round(float(w[k]), 6), round(float(np.linalg.norm(g @ v[:, k] - w[k] * v[:, k])), 6)) for k in range(10)], "k long, eigenvalue double, residual double")


@query()
def pivoted_qr(spark, sf_dir):
    r, order, rank = factor.tall_pivoted(whole(spark, sf_dir))
    return spark.createDataFrame([(k, order[k], round(float(abs(r[k, k])), 6), rank) for k in range(len(order))], "k long, column long, diagonal double, rank long")


@query()
def dense_kernels(spark, sf_dir):
    """Residuals of the driver's dense kernels on A'A + I: LU, Cholesky, block Gauss-Jordan, two-stage tridiagonal reduction,
    divide and conquer, the generalized eigenproblem."""
    from latticework.operators.sparse import gram_rows

    g = factor.small(gram_rows(whole(spark, sf_dir), "v"))
    n = len(g)
    g = g / np.abs(g).max() + np.eye(n)
    b = np.diag(1.0 + np.arange(n) / n)
    p, low, up = factor.lu(g)
    q, t = factor.two_stage(g, 4)
    w, v = factor.tridiagonal_eigh(np.diag(t), np.diag(t, 1))
    wg, vg = factor.generalized_eigh(g, b)
    found = {
        "lu": p @ g - low @ up, "lu_inverse": g @ factor.lu_inverse(g) - np.eye(n), "cholesky_inverse": g @ factor.cholesky_inverse(g) - np.eye(n),
        "gauss_jordan": g @ factor.gauss_jordan_inverse(g, 5) - np.eye(n), "two_stage": q @ t @ q.T - g, "divide_conquer": t @ v - v * w, "generalized": g @ vg - b @ vg * wg,
    }
    return spark.createDataFrame([(k, round(float(np.abs(x).max()), 8)) for k, x in found.items()], "kernel string, residual double")


# ---- tall factorizations ----


_ALL = "SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"
_QR_ALL = f"""WITH a AS ({_ALL}), k AS (SELECT DISTINCT j FROM a)
  SELECT 'qr' AS name, i, j, round(v, 6) AS v FROM a UNION ALL SELECT 'orthogonality', x.j, y.j, 0.0 FROM k x CROSS JOIN k y"""


@query(_QR_ALL)
def cholqr_whole(spark, sf_dir):
    """Cholesky-QR twice: Q R gives A back, Q'Q is the identity."""
    return product_of(*factor.cholesky_qr2(whole(spark, sf_dir)))


@query(_QR_ALL)
def qr_residual_whole(spark, sf_dir):
    """Tall-skinny QR."""
    return product_of(*factor.tall_qr(whole(spark, sf_dir)))


@query(_QR_ALL)
def block_mgs_whole(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return product_of(*factor.block_gram_schmidt(rows, width_of(rows), 16))


@query(f"SELECT i, j, round(v, 6) AS v FROM ({_ALL})")
def randomized_xr_whole(spark, sf_dir):
    rows = whole(spark, sf_dir)
    q, r = factor.randomized_xr(rows, width_of(rows))
    return factor.times(q, r).select("i", F.posexplode("v").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


@query(f"""WITH a AS ({_ALL}) SELECT round(sum(v * v), 4) AS sum_of_eigenvalues FROM a""")
def eigh_sum_whole(spark, sf_dir):
    """The eigenvalues of A'A add up to the squared norm of A."""
    w, _ = factor.eigh_gram(whole(spark, sf_dir))
    return spark.createDataFrame([(round(float(w.sum()), 4),)], "sum_of_eigenvalues double")


# ---- what the driver's dense kernels give back, against the matrix they were given ----

_GRAM = f"""a AS MATERIALIZED ({_ALL}), g0 AS MATERIALIZED (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2),
  g AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM g0) + (i = j)::INT AS v FROM g0)"""
#: kernels whose factors multiply to A'A / max + I, to its inverse's product with it, and to the embeddings' first rows
_OF_G = ("lu", "cholesky", "two_stage", "one_stage", "two_stage_apply", "divide_conquer", "generalized", "eigh", "pivoted_qr", "wider_band")
_OF_I = ("lu_inverse", "cholesky_inverse", "gauss_jordan")
_OF_A = ("householder", "blocked_qr", "wy")


def _matrix_rows(spark, name: str, x: np.ndarray):
    return [(name, int(i), int(j), round(float(x[i, j]), 6) + 0.0) for i in range(x.shape[0]) for j in range(x.shape[1])]


@query(f"""WITH {_GRAM}, k AS (SELECT DISTINCT j FROM a), top AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM (SELECT DISTINCT i FROM a) ORDER BY i LIMIT 96)
  SELECT name, i, j, round(v, 6) + 0.0 AS v FROM g CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _OF_G)}) o(name)
  UNION ALL SELECT name, x.j, y.j, (x.j = y.j)::INT::DOUBLE FROM k x CROSS JOIN k y CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _OF_I)}) o(name)
  UNION ALL SELECT name, r, j, round(v, 6) + 0.0 FROM a JOIN top USING (i) CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _OF_A)}) o(name)""")
def dense_products(spark, sf_dir):
    """Products of what each dense kernel returns: LU, Cholesky and block Gauss-Jordan, one- and two-stage reductions to tridiagonal
    form (with Q applied in two steps, too), divide and conquer, symmetric and generalized eigenproblems, pivoted QR of A'A / max + I (columns
    put back), and Householder QR of the first 96 embeddings: reflectors one by one, in panels, and as I - W Y'."""
    from latticework.operators.sparse import gram_rows

    rows = whole(spark, sf_dir)
    g = factor.small(gram_rows(rows, "v"))
    n = len(g)
    g = g / np.abs(g).max() + np.eye(n)
    first = np.array([r["v"] for r in rows.orderBy("i").limit(96).collect()])
    out = {}
    p, low, up = factor.lu(g)
    out["lu"] = p.T @ low @ up
    out["cholesky"] = (lambda c: c @ c.T)(np.linalg.cholesky(g))
    q, t = factor.two_stage(g, 4)
    out["two_stage"] = q @ t @ q.T
    w, v = factor.tridiagonal_eigh(np.diag(t), np.diag(t, 1))
    out["divide_conquer"] = q @ (v * w) @ v.T @ q.T
    q1, t1 = factor.tridiagonalize(g)
    out["one_stage"] = q1 @ t1 @ q1.T
    to_band, band = factor.to_band(g, 4)
    vectors = factor.apply_two_stage(to_band, factor.band_to_tridiagonal(band, 4)[0], v)  # of T, taken back to the matrix's
    out["two_stage_apply"] = (vectors * w) @ vectors.T
    b = np.diag(1.0 + np.arange(n) / n)
    wg, vg = factor.generalized_eigh(g, b)
    out["generalized"] = b @ (vg * wg) @ vg.T @ b
    we, ve = np.linalg.eigh(g)
    out["eigh"] = (ve * we) @ ve.T
    q2, r2, order, _ = factor.pivoted_qr(g)
    back = np.zeros_like(g)
    back[:, order] = q2 @ r2
    out["pivoted_qr"] = back
    q8, t8 = factor.two_stage(g, 8)
    out["wider_band"] = q8 @ t8 @ q8.T
    out["lu_inverse"], out["cholesky_inverse"], out["gauss_jordan"] = g @ factor.lu_inverse(g), g @ factor.cholesky_inverse(g), g @ factor.gauss_jordan_inverse(g, 5)
    reflectors, r = factor.householder_qr(first)
    out["householder"] = factor.apply_q(reflectors, r)
    qb, rb = factor.blocked_qr(first, 8)
    out["blocked_qr"] = qb @ rb
    wm, ym = factor.wy(reflectors, len(first))
    out["wy"] = (np.eye(len(first)) - wm @ ym.T) @ r
    made = [row for name, x in out.items() for row in _matrix_rows(spark, name, x)]  # of 96 x 64 numbers at most a kernel
    return spark.createDataFrame(made, "name string, i long, j long, v double")


EIGEN_N = 2400


@query(f"WITH {_GRAM} SELECT i, j, round(v, 4) + 0.0 AS v FROM g0")
def generalized_eigen(spark, sf_dir):
    """A x = lambda B x with A the Gram matrix of all embeddings and B = diag(1 + i / n): B V diag(w) V' B is A again."""
    from latticework.operators.sparse import gram_rows

    a = factor.small(gram_rows(whole(spark, sf_dir), "v"))
    b = np.diag(1.0 + np.arange(len(a)) / len(a))
    w, v = factor.generalized_eigh(a, b)
    made = b @ (v * w) @ v.T @ b
    return spark.createDataFrame([(i, j, round(float(made[i, j]), 4) + 0.0) for i in range(len(made)) for j in range(len(made))], "i long, j long, v double")


@query()
def eigen_lowest(spark, sf_dir):
    """The ten lowest eigenvalues of A x = lambda B x at n = 2400 on the driver, for its time: A symmetric with entries in [-1/2, 1/2), B = I + C S C' / n
    with S the Gram matrix of all embeddings, scaled."""
    from latticework.operators.sparse import gram_rows

    s = factor.small(gram_rows(whole(spark, sf_dir), "v"))
    rng = np.random.default_rng(1)
    a = rng.random((EIGEN_N, EIGEN_N)) - 0.5
    a = np.tril(a) + np.tril(a, -1).T
    c = rng.random((EIGEN_N, len(s))) - 0.5
    w, _ = factor.generalized_eigh(a, np.eye(EIGEN_N) + c @ (s / np.abs(s).max()) @ c.T / EIGEN_N)
    return spark.createDataFrame([(k, float(w[k])) for k in range(10)], "k long, eigenvalue double")


@query(f"WITH {_GRAM} SELECT i, j, round(v, 4) + 0.0 AS v FROM g0")
def eigh_product(spark, sf_dir):
    """V diag(w) V' of the Gram matrix's eigenpairs is the Gram matrix."""
    w, v = factor.eigh_gram(whole(spark, sf_dir))
    made = (v * w) @ v.T
    return spark.createDataFrame([(i, j, round(float(made[i, j]), 4) + 0.0) for i in range(len(made)) for j in range(len(made))], "i long, j long, v double")


@query(f"WITH {_GRAM} SELECT i, j, round(v, 4) + 0.0 AS v FROM g0")
def pivoted_product(spark, sf_dir):
    """R'R of the pivoted QR, with the columns put back, is the Gram matrix."""
    r, order, _ = factor.tall_pivoted(whole(spark, sf_dir))
    back = np.zeros((len(order), len(order)))
    back[:, order] = r
    made = back.T @ back
    return spark.createDataFrame([(i, j, round(float(made[i, j]), 4) + 0.0) for i in range(len(made)) for j in range(len(made))], "i long, j long, v double")


# ---- mixed precision ----


_HALF = lambda x: f"CASE WHEN ({x}) = 0 THEN 0 ELSE round_even(({x}) / pow(2, floor(log2(abs({x}))) - 10), 0) * pow(2, floor(log2(abs({x}))) - 10) END"


@query(f"""WITH l0 AS (SELECT p_partkey AS i, p_retailprice AS x, {_HALF('p_retailprice')} AS s0 FROM part),
  l1 AS (SELECT *, (x - s0) * 1024 AS r1 FROM l0), l2 AS (SELECT *, {_HALF('r1')} AS s1 FROM l1), l3 AS (SELECT *, (r1 - s1) * 1024 AS r2 FROM l2)
  SELECT i, s0, s1, {_HALF('r2')} AS s2 FROM l3""")
def ozaki_split(spark, sf_dir):
    df, _ = mixed.split_direct(table(spark, sf_dir, "part"), "p_retailprice", 3)
    return df.select(F.col("p_partkey").alias("i"), "s0", "s1", "s2")


@query("SELECT p_partkey AS i, (p_retailprice / 3)::FLOAT::DOUBLE AS s0, ((p_retailprice / 3 - (p_retailprice / 3)::FLOAT::DOUBLE) * 16777216)::FLOAT::DOUBLE AS s1 FROM part")
def ozaki_split_single(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_retailprice") / 3.0).alias("x"))
    df, _ = mixed.split_direct(part, "x", 2, "single")
    return df.select("i", "s0", "s1")


@query("""WITH t0 AS (SELECT ceil(log2(max(p_retailprice))) AS tau FROM part),
  l0 AS (SELECT p_partkey AS i, p_retailprice AS x, (p_retailprice + pow(2, 43 + tau)) - pow(2, 43 + tau) AS k0, tau AS tau0 FROM part CROSS JOIN t0)
  SELECT i, k0 * pow(2, -tau0) AS s0 FROM l0""")
def ozaki_split_shift(spark, sf_dir):
    df, _ = mixed.split_shift(table(spark, sf_dir, "part"), "p_retailprice", 1)
    return df.select(F.col("p_partkey").alias("i"), "s0")


@query("SELECT p_partkey AS i, round(p_retailprice, 6) AS v FROM part")
def ozaki_recombine(spark, sf_dir):
    """Three half-precision levels hold the price to well below a millionth."""
    df, exponents = mixed.split_direct(table(spark, sf_dir, "part"), "p_retailprice", 4)
    return df.select(F.col("p_partkey").alias("i"), F.round(mixed.recombine(exponents), 6).alias("v"))


_G = lambda m: f"(SELECT (id // 12) AS i, (id % 12) AS j, ((v * {m} % 101) / 101.0::DOUBLE + 0.01::DOUBLE) AS v FROM {derived.cells_sql(144)})"


def _square(spark, sf_dir, m: int):
    """A 12 x 12 matrix of the parts' sizes."""
    i = F.col("id")
    return derived.cells(spark, sf_dir, 144).select(F.floor(i / 12).alias("i"), (i % 12).alias("j"), ((F.col("v") * m % 101) / F.lit(101.0) + 0.01).alias("v"))


@query(f"SELECT a.i, b.j, round(sum(a.v * b.v), 5) AS v FROM {_G(37)} a JOIN {_G(53)} b ON a.j = b.i GROUP BY 1, 2")
def ozaki_gemm(spark, sf_dir):
    """Split product in fast mode against the plain product, to five digits."""
    return rounded(mixed.split_gemm(_square(spark, sf_dir, 37), _square(spark, sf_dir, 53), 3), "v", digits=5)


@query(f"SELECT a.i, b.j, round(sum(a.v::FLOAT::DOUBLE * b.v::FLOAT::DOUBLE), 8) AS v FROM {_G(37)} a JOIN {_G(53)} b ON a.j = b.i GROUP BY 1, 2")
def gemm_single(spark, sf_dir):
    return rounded(mixed.gemm_as(_square(spark, sf_dir, 37), _square(spark, sf_dir, 53), "single"), "v", digits=8)


def _e4m3(x: str) -> str:
    return f"(round_even(({x}) / pow(2, floor(log2(({x}))) - 3), 0) * pow(2, floor(log2(({x}))) - 3))"


@query(f"""SELECT a.i, b.j, sum({_e4m3('a.v')} * {_e4m3('b.v')})::FLOAT::DOUBLE AS v FROM {_G(37).replace('+ 0.01::DOUBLE', '+ 0.01::DOUBLE + 0.04::DOUBLE')} a JOIN {_G(53).replace('+ 0.01::DOUBLE', '+ 0.01::DOUBLE + 0.04::DOUBLE')} b ON a.j = b.i GROUP BY 1, 2""")
def gemm_e4m3(spark, sf_dir):
    """Eight-bit inputs, the product rounded to single precision."""
    more = lambda m: _square(spark, sf_dir, m).withColumn("v", F.col("v") + 0.04)
    return mixed.gemm_as(more(37), more(53), "e4m3", "single")


@query(f"SELECT a.i, b.j, round_even(sum(a.v * b.v) / pow(2, floor(log2(sum(a.v * b.v))) - 10), 0) * pow(2, floor(log2(sum(a.v * b.v))) - 10) AS v FROM {_G(37)} a JOIN {_G(53)} b ON a.j = b.i GROUP BY 1, 2")
def gemm_half_out(spark, sf_dir):
    """Double inputs, the product rounded to half precision."""
    return mixed.gemm_as(_square(spark, sf_dir, 37), _square(spark, sf_dir, 53), "double", "half")


# ---- spectral ----


SIZES, CELL = (6, 5, 4), (3.0, 2.5, 2.0)


@query(f"SELECT f, round(sum(a.v * cos(-2 * pi() * (f * k % 24) / 24)), 8) + 0.0 AS re, round(sum(a.v * sin(-2 * pi() * (f * k % 24) / 24)), 8) + 0.0 AS im FROM (SELECT id AS k, v FROM {derived.cells_sql(24)}) a CROSS JOIN range(24) b(f) GROUP BY 1")
def dft_small(spark, sf_dir):
    line = derived.cells(spark, sf_dir, 24).withColumnRenamed("id", "k")
    return spectral.dft_join(line, 24).select("f", (F.round("re", 8) + 0.0).alias("re"), (F.round("im", 8) + 0.0).alias("im"))


_CUBE = derived.field_sql(SIZES)


def _cube(spark, sf_dir):
    return derived.field(spark, sf_dir, SIZES)


_ANGLE = "-2 * pi() * (a.x * b.x / 6.0 + a.y * b.y / 5.0 + a.z * b.z / 4.0)"
_DFT3 = f"SELECT b.x, b.y, b.z, round(sum(a.v * cos({_ANGLE})), 6) + 0.0 AS re, round(sum(a.v * sin({_ANGLE})), 6) + 0.0 AS im FROM {_CUBE} a CROSS JOIN {_CUBE} b GROUP BY 1, 2, 3"


@query(_DFT3)
def fft3(spark, sf_dir):
    out = spectral.fft3(spectral.complex_field(_cube(spark, sf_dir)), SIZES)
    return out.select("x", "y", "z", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query(_DFT3)
def fft3_unpacked(spark, sf_dir):
    """The half spectrum of a real field, unpacked."""
    out = spectral.unpack_half(spectral.half_spectrum(spectral.fft3(spectral.complex_field(_cube(spark, sf_dir)), SIZES), 6), SIZES)
    return out.select("x", "y", "z", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query(f"SELECT x, y, z, round(v - (SELECT avg(v) FROM {_CUBE}), 6) + 0.0 AS v FROM {_CUBE}")
def poisson_periodic(spark, sf_dir):
    """Minus the Laplacian of the solution gives the right-hand side less its mean."""
    u = spectral.poisson_periodic(_cube(spark, sf_dir), SIZES, CELL, 2)
    back = grid.laplacian(u, SIZES, (0, 0, 0), CELL, 2)
    return back.select("x", "y", "z", (F.round(-F.col("v"), 6) + 0.0).alias("v"))


@query(f"SELECT x, y, z, round(v, 6) AS v FROM {derived.field_sql((6, 5, 1))}")
def poisson_zero_2d(spark, sf_dir):
    u = spectral.poisson_zero(derived.field(spark, sf_dir, (6, 5, 1)), (6, 5, 1), 0.5)
    five = [(0, 0, 0, -16.0)] + [(s if k == 0 else 0, s if k == 1 else 0, 0, 4.0) for k in (0, 1) for s in (-1, 1)]
    return rounded(grid.stencil(u, five, (6, 5, 1), (1, 1, 1)), "v", digits=6)


@query(f"SELECT x, y, z, round(v, 6) AS v FROM {_CUBE}")
def poisson_zero_3d(spark, sf_dir):
    u = spectral.poisson_zero(_cube(spark, sf_dir), SIZES, 0.5)
    seven = [(0, 0, 0, -24.0)] + [tuple(s if a == k else 0 for a in range(3)) + (4.0,) for k in range(3) for s in (-1, 1)]
    return rounded(grid.stencil(u, seven, SIZES, (1, 1, 1)), "v", digits=6)


@query(derived.columns_scaled_sql("WITH s AS (SELECT id, id // 5 AS i, id % 5 AS j FROM range(25) t(id)) SELECT i, j, abs(i / 5.0::DOUBLE - (j / 5.0::DOUBLE + 2.0::DOUBLE)) AS v FROM s", 5, 6))
def distance_matrix(spark, sf_dir):
    from latticework.sources.generators import distance_matrix as made

    return derived.columns_scaled(spark, sf_dir, made(spark, 5, 5), 5, 6)


@query(derived.columns_scaled_sql("""SELECT (id)::BIGINT AS i, ((x + dx) * 6 + y + dy)::BIGINT AS j, c::DOUBLE AS v FROM (SELECT id, id // 6 AS x, id % 6 AS y FROM range(30) t(id))
  CROSS JOIN (VALUES (0, 0, 20.0), (1, 0, -2.0), (-1, 0, -2.0), (0, 1, -2.0), (0, -1, -2.0), (2, 0, -1.0), (-2, 0, -1.0), (0, 2, -1.0), (0, -2, -1.0), (3, 0, -0.5), (-3, 0, -0.5), (0, 3, -0.5), (0, -3, -0.5)) o(dx, dy, c)
  WHERE x + dx BETWEEN 0 AND 4 AND y + dy BETWEEN 0 AND 5""", 30, 6))
def dense_stencil(spark, sf_dir):
    from latticework.sources.generators import dense_stencil as made

    return derived.columns_scaled(spark, sf_dir, made(spark, 5, 6), 30, 6)


@query(f"SELECT x.i, sum(x.v * y.v * c.v) AS v FROM (SELECT id AS i, (id * id % 11)::DOUBLE AS v FROM range(50) t(id)) x JOIN (SELECT id AS i, ((id + 3) % 10)::DOUBLE AS v FROM range(50) t(id)) y USING (i) JOIN {derived.cells_sql(50)} c ON c.id = x.i GROUP BY 1")
def generated_vectors(spark, sf_dir):
    from latticework.sources.generators import modular, vector

    x = vector(spark, 50, F.col("i") * F.col("i") % 11).withColumnRenamed("v", "x")
    c = derived.vector(spark, sf_dir, 50).withColumnRenamed("v", "c")
    return coo.vec(x.join(modular(spark, 50, 10, 3), "i").join(c, "i").withColumn("p", F.col("x") * F.col("v") * F.col("c")), "i", "p")
