import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import kernels, scalar
from latticework.operators import blas, coo, mixed, nbody, redist, sparse
from latticework.plans import blocks, points
from latticework.sources import generators, matrix_market, raw


def entries(df):
    return sorted((r["i"], r["j"], r["v"]) for r in df.collect())


def test_erf(spark):
    xs = [-7.0, -2.5, -1e-9, 0.0, 1e-3, 0.3, 1.0, 3.7, 5.9, 30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalar.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-14)


def test_ordered_comparison_with_nan(spark):
    row = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double").select(*[scalar.ordered(o, F.col("a"), F.col("b")) for o in ("eq", "ne", "lt", "le", "gt", "ge")]).first()
    assert not any(row)


def test_safe_division(spark):
    assert [r[0] for r in spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double").select(scalar.safe_div(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]


def test_spmv_zero_rows_and_duplicates(spark):
    a = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0), (3, 2, 1.0)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 10.0), (2, 1.0)], "i long, v double")
    y = sparse.spmv(a, x, spark.range(5).withColumnRenamed("id", "i"))
    assert sorted(map(tuple, y.collect())) == [(0, 0.0), (1, 50.0), (2, 0.0), (3, 1.0), (4, 0.0)]


def test_merge_last_and_csr_round_trip(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 5.0, 2), (0, 3, 2.0, 1)], "i long, j long, v double, o int")
    assert entries(coo.merge_last(a, "o")) == [(0, 0, 5.0), (0, 3, 2.0)]
    assert entries(coo.from_csr(coo.csr(coo.merge(a)))) == [(0, 0, 6.0), (0, 3, 2.0)]


def test_nnz_blocks_with_one_heavy_row(spark):
    cells = [(0, 0)] + [(2, k) for k in range(20)] + [(5, 1), (7, 2)]
    a = spark.createDataFrame([(i, j, 1.0) for i, j in cells], "i long, j long, v double")
    got = [tuple(r) for r in coo.nnz_blocks(a, 4).orderBy("block").collect()]
    assert [(r[1], r[2]) for r in got] == [(0, 5), (6, 11), (12, 17), (18, 22)]
    assert [(r[3], r[4], r[5], r[6]) for r in got] == [(0, 2, True, False), (2, 2, False, None), (2, 2, False, None), (2, 7, False, True)]


def test_prefix_sum_over_chunks(spark):
    d = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r["k"]: r["t"] for r in coo.prefix_sum(d, "k", "n", "t", chunk=16).collect()}
    assert [got[k] for k in range(300)] == list(np.cumsum(np.arange(300) % 7))


def test_nrm2_safe_does_not_overflow(spark):
    d = spark.createDataFrame([(3e200,), (4e200,)], "v double")
    assert blas.nrm2_safe(d, "v").first()[0] == pytest.approx(5e200)
    assert blas.nrm2_safe(spark.createDataFrame([(0.0,)], "v double"), "v").first()[0] == 0.0


def test_pivot_tie_goes_to_the_lowest_column(spark):
    d = spark.createDataFrame([(4, 2.0), (1, 2.0), (0, 1.0)], "j long, norm double")
    assert blas.pivot_column(d).first()["j"] == 1


def test_lower_bound_with_ties(spark):
    v = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0)], "v double")
    q = spark.createDataFrame([(x,) for x in (0.0, 2.0, 3.0, 9.0)], "q double")
    assert sorted(map(tuple, blas.lower_bound(v, q).collect())) == [(0.0, 0), (2.0, 1), (3.0, 3), (9.0, 4)]


def test_half_rounding_like_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-9, 6, 500), [0.0, -0.0, 65504.0, 65519.9, 65520.0, 1e9, -1e9, 6e-8, 5.96e-8, 2.98e-8, 2.0**-14, 2.0**-24, 2.0**-25, 1.0 - 2**-12, 4096.0 - 1e-9]])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(mixed.round_half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        want = xs.astype(np.float16).astype(np.float64)
    assert np.array_equal(np.array(got), want)


def test_split_levels_recombine(spark):
    xs = [0.0, 1 / 3, -123.456, 1e-3, 65000.7]
    df, exponents = mixed.split_direct(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 4)
    got = [r[0] for r in df.select(mixed.recombine(exponents)).collect()]
    assert got == pytest.approx(xs, rel=1e-12)
    df, exponents = mixed.split_shift(spark.createDataFrame([(abs(x),) for x in xs], "x double"), "x", 3, 8)
    back = [r[0] for r in df.select(mixed.recombine(exponents)).collect()]
    assert back == pytest.approx([abs(x) for x in xs], abs=1e-3)


def test_coincident_points(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0, 1.0), (2, 3.0, 4.0, 0.0, 2.0)], "id long, x double, y double, z double, q double")
    got = {r["id"]: r["v"] for r in nbody.scalar_sum(p, p).collect()}
    assert got == pytest.approx({0: 0.4, 1: 0.4, 2: 0.4})


@pytest.mark.parametrize("kernel", ["rpy", "stokes"])
def test_symmetric_vector_sweep(spark, kernel):
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, rng.uniform(0, 1, 6))) for k in range(24)]
    rows[7] = (7, *rows[2][1:4], *rows[7][4:])  # coincident, one in each set
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, qx double, qy double, qz double")
    left, right, f = p.where("id % 2 = 0"), p.where("id % 2 = 1"), getattr(kernels, kernel)
    got = {(r["side"], r["id"]): (r["vx"], r["vy"], r["vz"]) for r in nbody.symmetric_vector_sum(left, right, f).collect()}
    want = {(s, r["id"]): (r["vx"], r["vy"], r["vz"]) for s, x, y in (("left", left, right), ("right", right, left)) for r in nbody.vector_sum(x, y, f).collect()}
    assert len(got) == 24 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)


def test_whole_tables_meet(spark, tmp_path):
    rng = np.random.default_rng(5)
    lines = [(int(o), int(rng.integers(1, 400)), int(rng.integers(1, 9))) for o in (1, 1, 300, 301, 5000, 5000, 14000, 14001, 20000, 20000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    a, b = {}, {}
    for o, p, s in lines:
        a[o], b[s] = (min(a.get(o, (p, p))[0], p), max(a.get(o, (p, p))[1], p)), min(b.get(s, p), p)
    want = {(o, s, max(lo, at), min(hi, at + 20)) for o, (lo, hi) in a.items() for s, at in b.items() if lo <= at + 20 and at <= hi}
    got = [tuple(r) for r in blocks.interval_overlap_whole(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {o for o, *_ in got} > {301, 5000}
    vectors = [(k, [float(x) for x in rng.uniform(-1, 1, 6)], k % 5) for k in range(9)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    m = np.zeros((27, 27))
    for r in nbody.stokes_matrix(points.points(spark, str(tmp_path))).collect():
        m[r["i"], r["j"]] = r["v"]
    x = np.array([v[:3] for _, v, _ in vectors], np.float32).astype(float)
    c = 1 / (6 * np.pi * 0.25 * 0.5)
    for i in range(9):
        for j in range(9):
            d = x[i] - x[j]
            r = np.linalg.norm(d)
            block = c * np.eye(3) if i == j else c * 0.25 * 0.75 / r * (np.eye(3) + np.outer(d, d) / r**2)
            assert m[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] == pytest.approx(block, abs=1e-7)


def test_box_overlap_edges(spark):
    box = "rank long, r0 long, r1 long, c0 long, c1 long"
    a = spark.createDataFrame([(0, 0, 9, 0, 9), (1, 20, 29, 0, 9)], box)
    b = spark.createDataFrame([(0, 9, 20, 9, 9), (1, 10, 19, 0, 9)], box)
    assert sorted(map(tuple, redist.overlap_2d(a, b, 4).collect())) == [(0, 0, 9, 9, 9, 9), (1, 0, 20, 20, 9, 9)]


MM = {
    "general real": ("%%MatrixMarket matrix coordinate real general\n% note\n\n3 3 3\n1 1 2.5\n3 2 -1e2\n3 3 3\n", [(0, 0, 2.5), (2, 1, -100.0), (2, 2, 3.0)]),
    "symmetric pattern": ("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n1 1\n3 1\n", [(0, 0, 1.0), (0, 2, 1.0), (2, 0, 1.0)]),
    "complex": ("%%MatrixMarket matrix coordinate complex general\n2 2 1\n2 1 4.0 -9.0\n", [(1, 0, 4.0)]),
    "skew integer": ("%%MatrixMarket matrix coordinate integer skew-symmetric\n2 2 1\n2 1 4\n", [(0, 1, -4.0), (1, 0, 4.0)]),
    "array": ("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n", [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]),
    "symmetric array": ("%%MatrixMarket matrix array real symmetric\n2 2\n1\n2\n3\n", [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]),
}


@pytest.mark.parametrize("kind", MM)
def test_matrix_market(spark, tmp_path, kind):
    text, want = MM[kind]
    (tmp_path / "a.mtx").write_text(text)
    assert entries(matrix_market.read(spark, str(tmp_path / "a.mtx"))) == want


def test_matrix_market_rejects_and_writes(spark, tmp_path):
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket tensor coordinate real general\n1 1 1\n1 1 1\n")
    with pytest.raises(ValueError):
        matrix_market.header(spark, str(tmp_path / "bad.mtx"))
    (tmp_path / "c.mtx").write_text(MM["complex"][0])
    with pytest.raises(ValueError):
        matrix_market.read(spark, str(tmp_path / "c.mtx"), fields=("real", "integer"))
    a = spark.createDataFrame([(0, 1, 0.1), (4, 2, -3.0)], "i long, j long, v double")
    matrix_market.write(a, str(tmp_path / "out"), 5, 3)
    assert matrix_market.header(spark, str(tmp_path / "out"))[0].code == "MCRG"
    assert entries(matrix_market.read(spark, str(tmp_path / "out"))) == entries(a)


def test_raw_points_and_fields(spark, tmp_path):
    x = generators.modular(spark, 50, 7)
    raw.write_doubles(x, str(tmp_path / "x.bin"))
    assert sorted((r["i"], r["v"]) for r in raw.read_doubles(spark, str(tmp_path / "x.bin")).collect()) == [(k, float(k % 7)) for k in range(50)]
    (tmp_path / "p.txt").write_text("2 3\n0 1 2\n3 4 5\n")
    assert sorted((r["id"], list(r["p"])) for r in raw.read_points(spark, str(tmp_path / "p.txt")).collect()) == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    (tmp_path / "f.txt").write_text("1.5\n-2\n")
    assert sorted(map(tuple, raw.read_field(spark, str(tmp_path / "f.txt")).collect())) == [(0, 1.5), (1, -2.0)]


def test_generators_repeat(spark):
    a = generators.random_coo(spark, 20, 30, 100).collect()
    assert a == generators.random_coo(spark, 20, 30, 100).collect()
    assert all(0 <= r["i"] < 20 and 0 <= r["j"] < 30 for r in a)
    assert all(0 <= r["x"] < 1 for r in generators.random_points(spark, 50).collect())
    assert abs(np.mean([r["v"] for r in generators.centred(spark, 2000).collect()])) < 0.05


def test_eight_bit_rounding_is_the_nearest_of_all_values(spark):
    values = sorted({(1 + m / 8) * 2.0**e for e in range(-6, 9) for m in range(8) if (e, m) != (8, 7)} | {m / 8 * 2.0**-6 for m in range(8)})
    rng = np.random.default_rng(1)
    xs = [float(x) for x in np.r_[values, -np.array(values), rng.normal(size=300) * 10, rng.normal(size=100) * 0.01, 460.0, 470.0]]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double").select("k", mixed.round_e4m3(F.col("x")).alias("v")).orderBy("k").select("v").collect()]
    for x, y in zip(xs, got):
        if abs(x) > 464:  # half-way to what would follow 448
            assert np.isnan(y)
        else:
            assert abs(abs(y) - abs(x)) == min(abs(abs(x) - v) for v in values) and abs(y) in values, (x, y)


def test_splits_on_grids_are_shifts(spark):
    """Rounding to a grid leaves what adding and taking away a large power of two does."""
    rng = np.random.default_rng(2)
    xs = [float(x) for x in np.abs(rng.normal(size=200)) * 7]
    df, exponents = mixed.split_shift(spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double"), "x", 3, 4)
    got = np.array([[r["s0"], r["s1"], r["s2"]] for r in df.orderBy("k").collect()])
    rest = np.array(xs)
    for level in range(3):
        tau = int(np.ceil(np.log2(rest.max())))
        sigma = 2.0 ** (np.ceil(53 - min(10, (24 - 2) / 2)) + tau)
        kept = (rest + sigma) - sigma
        assert exponents[level] == tau and np.array_equal(got[:, level], kept * 2.0**-tau)
        rest = rest - kept


@pytest.mark.parametrize("tolerance", [0.0, 1e-10])
def test_kernel_products_over_many_blocks(spark, tolerance):
    from latticework.functions import kernels

    rng = np.random.default_rng(3)
    x, q = rng.random((700, 3)) * 4, rng.normal(size=700)
    df = spark.createDataFrame([(k, [float(a) for a in p], float(w)) for k, (p, w) in enumerate(zip(x, q))], "id long, p array<double>, q double").repartition(3)
    got = {r["id"]: r["v"] for r in nbody.kernel_matvec(df, kernels.gauss_array(2.0), 0.1, rows=90, tolerance=tolerance).collect()}
    a = np.exp(-((x[:, None] - x[None, :]) ** 2).sum(2) / 4.0)
    np.fill_diagonal(a, 1.1)
    assert np.allclose([got[k] for k in range(700)], a @ q, atol=1e-7)


def test_thin_factors_of_far_blocks():
    entry = lambda a, b: 1.0 / np.sqrt(((a[:, None] - b[None, :]) ** 2).sum(2))
    rng = np.random.default_rng(4)
    a, b = rng.random((200, 3)), rng.random((150, 3)) + [5.0, 0, 0]
    u, v = nbody.thin_factors(a, b, entry, 1e-9)
    assert u.shape[1] < 30 and np.abs(u @ v.T - entry(a, b)).max() < 1e-7
    assert nbody.thin_factors(a, a + 1e-3, lambda x, y: rng.normal(size=(len(x), len(y))), 1e-9) is None


def test_inverse_of_a_stencil_on_its_own_cells():
    from latticework.operators import grid

    c = np.zeros((3, 3, 3))
    c[1, 1, 1] = 6.5
    for axis in range(3):
        for s in (0, 2):
            at = [1, 1, 1]
            at[axis] = s
            c[tuple(at)] = -1.0
    got = grid.support_inverse_stencil((7, 8, 9), c)
    cells = [tuple(p) for p in np.argwhere(c != 0)]
    full = np.zeros((7, 7))
    for i, p in enumerate(cells):
        for j, q in enumerate(cells):
            d = tuple(np.array(p) - np.array(q) + 1)
            full[i, j] = c[d] if all(0 <= k < 3 for k in d) else 0.0
    want = np.linalg.inv(full)[:, cells.index((1, 1, 1))]
    assert np.allclose([got[p] for p in cells], want) and (got != 0).sum() == 7


def test_text_in_many_files_and_blocks(spark, tmp_path):
    """Written by many tasks, read by many tasks in any order: the order of lines is kept."""
    a = coo.coo(spark.range(4000).selectExpr("id * 7 % 500 as r", "id % 83 as c", "cast(id % 91 as double) as v"), "r", "c", "v").repartition(5)
    a = coo.merge(a)
    n = a.count()
    matrix_market.write(a, str(tmp_path / "out"), 500, 83)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    text = [line for p in parts for line in p.read_text().splitlines()]
    assert len(parts) > 1 and text[:2] == ["%%MatrixMarket matrix coordinate real general", f"500 83 {n}"]
    places = [tuple(map(int, line.split()[:2])) for line in text[2:]]
    assert places == sorted(places)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert entries(matrix_market.read(spark, str(tmp_path / "out"))) == entries(a)
        x = coo.vec(spark.range(3000).selectExpr("id as k", "cast(id * 31 % 997 as double) as w"), "k", "w").repartition(6)
        raw.write_field(x, str(tmp_path / "field"))
        assert sorted(map(tuple, raw.read_field(spark, str(tmp_path / "field")).collect())) == sorted(map(tuple, x.collect()))
        (tmp_path / "one.txt").write_text("".join(f"{k * 31 % 997}.0\n" for k in range(3000)))
        assert sorted(map(tuple, raw.read_field(spark, str(tmp_path / "one.txt")).collect())) == sorted(map(tuple, x.collect()))
        raw.write_points(spark.range(700).selectExpr("id", "array(cast(id as double), 1.5D) as p").repartition(4), str(tmp_path / "points"))
        assert {r["id"]: list(r["p"]) for r in raw.read_points(spark, str(tmp_path / "points")).collect()} == {k: [float(k), 1.5] for k in range(700)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_raw_values_by_blocks(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=10_000)
    (tmp_path / "x").mkdir()
    v[:9000].astype("<f8").tofile(tmp_path / "x" / "a.bin")
    v[9000:].astype("<f8").tofile(tmp_path / "x" / "b.bin")
    got = raw.read_doubles(spark, str(tmp_path / "x"))
    found = {(r["path"].rsplit("/")[-1], r["i"]): r["v"] for r in got.collect()}
    assert found == {("a.bin", k): x for k, x in enumerate(v[:9000])} | {("b.bin", k): x for k, x in enumerate(v[9000:])}
    v.astype("<f4").tofile(tmp_path / "y.bin")
    assert raw.read_doubles(spark, str(tmp_path / "y.bin"), "<f4").count() == 10_000
    (tmp_path / "odd.bin").write_bytes(b"123456789")
    with pytest.raises(ValueError):
        raw.read_doubles(spark, str(tmp_path / "odd.bin"))
