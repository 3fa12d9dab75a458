"""Sources and sinks: a table is written to a file of each format in the shared folder and read back, and SQL compares with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import scalar
from latticework.operators import coo
from latticework.plans import derived
from latticework.plans.linear import lineitem, prices
from latticework.plans.registry import query
from latticework.sources import generators, matrix_market, raw
from latticework.tables import scratch, table


def _through(spark, a, rows: int, cols: int, banner: matrix_market.Banner):
    path = scratch(spark, "matrix")
    matrix_market.write(a, path, rows, cols, banner)
    return matrix_market.read(spark, path)


@query("SELECT l_orderkey - 1 AS i, l_partkey - 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def matrix_market_general(spark, sf_dir):
    a = coo.merge(lineitem(spark, sf_dir)).select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")
    rows, cols = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    return _through(spark, a, rows, cols, matrix_market.Banner())


_PAIRS = "(SELECT c.c_nationkey::BIGINT AS i, s.s_nationkey::BIGINT AS j, count(*) AS n FROM customer c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def _nations(spark, sf_dir):
    """Line items from suppliers of one nation to customers of another."""
    t = lambda n: table(spark, sf_dir, n)
    met = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return met.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


_LOWER = f"(SELECT greatest(i, j) AS a, least(i, j) AS b, sum(n)::DOUBLE AS v FROM {_PAIRS} GROUP BY 1, 2)"


def _lower(spark, sf_dir):
    return _nations(spark, sf_dir).groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.sum("v").alias("v"))


@query(f"SELECT a AS i, b AS j, v FROM {_LOWER} UNION ALL SELECT b, a, v FROM {_LOWER} WHERE a <> b")
def matrix_market_symmetric(spark, sf_dir):
    """The lower triangle is written, the matrix read."""
    return _through(spark, _lower(spark, sf_dir), 25, 25, matrix_market.Banner(field="integer", symmetry="symmetric"))


@query(f"SELECT a AS i, b AS j, v FROM {_LOWER} WHERE a <> b UNION ALL SELECT b, a, -v FROM {_LOWER} WHERE a <> b")
def matrix_market_skew(spark, sf_dir):
    return _through(spark, _lower(spark, sf_dir), 25, 25, matrix_market.Banner(symmetry="skew-symmetric"))


@query(f"SELECT i, j, 1.0::DOUBLE AS v FROM {_PAIRS}")
def matrix_market_pattern(spark, sf_dir):
    return _through(spark, _nations(spark, sf_dir), 25, 25, matrix_market.Banner(field="pattern"))


@query(f"SELECT x.i, y.i AS j, coalesce(n, 0)::DOUBLE AS v FROM range(25) x(i) CROSS JOIN range(25) y(i) LEFT JOIN {_PAIRS} p ON p.i = x.i AND p.j = y.i")
def matrix_market_array(spark, sf_dir):
    """Dense: all values down the columns."""
    return _through(spark, _nations(spark, sf_dir), 25, 25, matrix_market.Banner("array"))


@query(f"SELECT x.i, y.i AS j, coalesce(v, 0)::DOUBLE AS v FROM range(25) x(i) CROSS JOIN range(25) y(i) LEFT JOIN {_LOWER} p ON p.a = greatest(x.i, y.i) AND p.b = least(x.i, y.i)")
def matrix_market_array_symmetric(spark, sf_dir):
    return _through(spark, _lower(spark, sf_dir), 25, 25, matrix_market.Banner("array", symmetry="symmetric"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_retailprice AS v FROM part")
def raw_doubles(spark, sf_dir):
    path = scratch(spark, "doubles")
    raw.write_doubles(prices(spark, sf_dir), path)
    return raw.read_doubles(spark, path).select("i", "v")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings")
def point_file(spark, sf_dir):
    path = scratch(spark, "points")
    raw.write_points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p")), path)
    return raw.read_points(spark, path).select("id", F.posexplode("p").alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), "v")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_retailprice AS v FROM part")
def field_file(spark, sf_dir):
    path = scratch(spark, "field")
    raw.write_field(prices(spark, sf_dir), path)
    return raw.read_field(spark, path)


@query("""SELECT count(*) AS points, count(*)::INT AS ids, 1.0::DOUBLE AS inside, 0.5::DOUBLE AS mean_x, 0.5::DOUBLE AS mean_q, 0.0::DOUBLE AS mean_centred, count(*)::DOUBLE AS sum_coo, 1 AS coo_inside FROM lineitem""")
def random_inputs(spark, sf_dir):
    """What hashed generators promise for as many rows as lineitem has: ranges, means to one digit and the sum of duplicate entries."""
    n = table(spark, sf_dir, "lineitem").count()
    p = generators.random_points(spark, n)
    inside = F.avg(F.forall(F.array(*"xyzq"), lambda c: (c >= 0) & (c < 1)).cast("double")).alias("inside")
    found = p.agg(F.count(F.lit(1)).alias("points"), inside, F.round(F.avg("x"), 1).alias("mean_x"), F.round(F.avg("q"), 1).alias("mean_q"))
    ids = p.select("id").repartition(p.rdd.getNumPartitions(), "id").distinct().agg(F.count(F.lit(1)).cast("int").alias("ids"))  # as many tasks as rows ask for
    found = found.crossJoin(ids).select("points", "ids", "inside", "mean_x", "mean_q")
    centred = generators.centred(spark, n).agg((F.round(F.avg("v"), 1) + 0.0).alias("mean_centred"))
    a = generators.random_coo(spark, 40, 30, n)
    cells = a.agg(F.sum("v").alias("sum_coo"), F.bool_and(F.col("i").between(0, 39) & F.col("j").between(0, 29)).cast("int").alias("coo_inside"))
    return found.crossJoin(centred).crossJoin(cells)  # one row each


@query(derived.columns_scaled_sql("SELECT id // 7 AS i, id % 7 AS j, 1 / abs((id // 7) / 6.0::DOUBLE - ((id % 7) / 7.0::DOUBLE + 2.0::DOUBLE)) AS v FROM range(42) t(id)", 7, 6))
def reciprocal_matrix(spark, sf_dir):
    return derived.columns_scaled(spark, sf_dir, generators.reciprocal_matrix(spark, 6, 7), 7, 6)


@query("""SELECT x.l_partkey % 20 AS i, y.l_partkey % 20 AS j, sum(x.l_quantity * y.l_quantity) AS v FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey GROUP BY 1, 2""")
def spd_matrix(spark, sf_dir):
    """A'A of orders x parts in twenty classes."""
    a = coo.merge(coo.coo(table(spark, sf_dir, "lineitem").withColumn("c", F.col("l_partkey") % 20), "l_orderkey", "c", "l_quantity"))
    return generators.spd(a)


@query("""SELECT p_partkey AS i, x < y AS lt, x <= y AS le, x > y AS gt, x >= y AS ge, x = y AS eq, x <> y AS ne, nan_lt, nan_eq, nan_ne, round(CASE WHEN p_size = 25 THEN 0 ELSE 2 / sqrt(abs(p_size - 25)) END, 6) AS frsqrt
  FROM (SELECT *, p_size::DOUBLE AS x, 25.0::DOUBLE AS y, false AS nan_lt, false AS nan_eq, false AS nan_ne FROM part)""")
def ordered_compare(spark, sf_dir):
    """Comparisons that nothing passes which is not a number, and the reciprocal root by Newton steps."""
    x, y, nan = F.col("p_size").cast("double"), F.lit(25.0), F.lit(float("nan"))
    usual = [scalar.ordered(k, x, y).alias(k) for k in ("lt", "le", "gt", "ge", "eq", "ne")]
    odd = [scalar.ordered(k, x, nan).alias(f"nan_{k}") for k in ("lt", "eq", "ne")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), *usual, *odd, F.round(scalar.frsqrt(F.abs(x - y), 2.0, 2), 6).alias("frsqrt"))


@query("SELECT p_partkey AS i, 7.5::DOUBLE AS v FROM part")
def fill_constant(spark, sf_dir):
    return coo.fill(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")), 7.5)
