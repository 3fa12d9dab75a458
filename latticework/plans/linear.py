"""Sparse products, vector operations, reductions, windows and reshapes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import scalar
from latticework.operators import blas, coo, sparse
from latticework.plans.registry import query
from latticework.tables import table


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders x parts, quantities as values; coordinates repeat."""
    return coo.coo(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo.vec(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# ---- products ----


@query("SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv(spark, sf_dir):
    return rounded(sparse.spmv(lineitem(spark, sf_dir), prices(spark, sf_dir)), "v")


#: a third of all entries in row 0
_SKEWED = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS i, l_partkey AS j, l_quantity AS v FROM lineitem"


def _skewed(spark, sf_dir):
    return lineitem(spark, sf_dir).withColumn("i", F.when(F.col("i") % 3 == 0, 0).otherwise(F.col("i")))


@query(f"SELECT i, round(sum(v * p_retailprice), 4) AS v FROM ({_SKEWED}) JOIN part ON j = p_partkey GROUP BY 1")
def spmv_blocked(spark, sf_dir):
    """By equal runs of entries, of which the long row has a third."""
    return rounded(sparse.spmv_blocked(sparse.blocked(_skewed(spark, sf_dir), 32), prices(spark, sf_dir)), "v")


@query(f"""WITH a AS (SELECT i, j % 16 AS j, sum(v) AS v FROM ({_SKEWED}) GROUP BY 1, 2)
  SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2""")
def gram_tiled(spark, sf_dir):
    """A'A in sixteen classes of parts, rows of more than eight entries by tiles."""
    a = coo.merge(_skewed(spark, sf_dir).withColumn("j", F.col("j") % 16))
    return rounded(sparse.gram(a, 8), "v")


@query("""SELECT o_orderkey AS i, coalesce(round(y, 4), 0.0) AS v FROM orders LEFT JOIN
  (SELECT l_orderkey, sum(l_quantity * p_retailprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey""")
def spmv_zero_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    return rounded(sparse.spmv(lineitem(spark, sf_dir), prices(spark, sf_dir), rows), "v")


@query("""SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) AS y0, round(sum(l_quantity * p_size), 4) AS y1
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def spmm(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("y0"), F.col("p_size").cast("double").alias("y1"))
    return rounded(sparse.spmm_columns(lineitem(spark, sf_dir), x, ["y0", "y1"]), "y0", "y1")


@query("""SELECT l_orderkey AS i, k, round(sum(l_quantity * x), 4) AS v FROM lineitem JOIN
  (SELECT p_partkey, 0 AS k, p_retailprice AS x FROM part UNION ALL SELECT p_partkey, 1, p_size FROM part) ON l_partkey = p_partkey GROUP BY 1, 2""")
def spmm_long(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("i"), F.lit(0).alias("k"), F.col("p_retailprice").alias("v")).unionByName(p.select(F.col("p_partkey").alias("i"), F.lit(1).alias("k"), F.col("p_size").cast("double").alias("v")))
    return rounded(sparse.spmm(lineitem(spark, sf_dir), x), "v")


@query("""SELECT s_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, round(sum(s_acctbal), 4) AS v FROM
  (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) s JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def spgemm(spark, sf_dir):
    """(nations x suppliers) (suppliers x nations) (nations x regions)."""
    s = table(spark, sf_dir, "supplier")
    r = s.select(F.col("s_nationkey").cast("long").alias("i"), F.col("s_suppkey").alias("j"), F.lit(1.0).alias("v"))
    a = s.select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"), F.col("s_acctbal").alias("v"))
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return rounded(sparse.triple_product(r, a, p), "v")


@query("""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""")
def gram(spark, sf_dir):
    return rounded(sparse.gram_rows(table(spark, sf_dir, "embeddings"), "embedding"), "v", digits=6)


@query("""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""")
def gram_coo_whole(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return rounded(sparse.gram(e.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))), "v", digits=6)


@query("SELECT vec_id AS i, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: embedding[k]::DOUBLE * k)), 6) AS v FROM embeddings")
def gemv(spark, sf_dir):
    """Dense rows times the vector 1, 2, ..."""
    weighted = F.aggregate(F.transform("embedding", lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.round(weighted, 6).alias("v"))


# ---- coordinate matrices ----


@query("SELECT l_orderkey AS i, l_partkey AS j, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2")
def coo_merge(spark, sf_dir):
    return rounded(coo.merge(lineitem(spark, sf_dir)), "v")


@query("SELECT l_orderkey AS i, l_partkey AS j, arg_max(l_quantity, l_extendedprice) AS v FROM lineitem GROUP BY 1, 2")
def coo_merge_last(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"), "l_extendedprice")
    return coo.merge_last(li, "l_extendedprice")


@query("SELECT i, n, sum(n) OVER (ORDER BY i)::BIGINT AS row_end FROM (SELECT l_orderkey AS i, count(*) AS n FROM lineitem GROUP BY 1)")
def csr_row_ptr(spark, sf_dir):
    return coo.row_ptr(lineitem(spark, sf_dir))


@query("""WITH r AS (SELECT i, n, (sum(n) OVER (ORDER BY i))::BIGINT AS e FROM (SELECT l_orderkey AS i, count(*) AS n FROM lineitem GROUP BY 1)),
  t AS (SELECT sum(n)::BIGINT AS total FROM r),
  b AS (SELECT k AS block, (k * (total // 16) + least(k, total % 16))::BIGINT AS s, ((k + 1) * (total // 16) + least(k + 1, total % 16) - 1)::BIGINT AS f FROM t, range(16) AS x(k))
  SELECT block, s AS nnz_start, f AS nnz_end, min(i) AS first_row, max(i) AS last_row,
    min(i) <> max(i) AND s = min(e - n) AS first_intact, CASE WHEN min(i) <> max(i) THEN f = max(e) - 1 END AS last_intact
  FROM b JOIN r ON e > s AND e - n <= f GROUP BY block, s, f""")
def nnz_blocks(spark, sf_dir):
    return coo.nnz_blocks(lineitem(spark, sf_dir), 16)


@query("SELECT l_partkey AS i, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1")
def transpose_nnz(spark, sf_dir):
    return coo.transpose(lineitem(spark, sf_dir)).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT i, len(list(j)) AS n, min(j) AS first_col, max(j) AS last_col FROM (SELECT l_orderkey AS i, l_partkey AS j FROM lineitem) GROUP BY i")
def csr_rows(spark, sf_dir):
    r = coo.csr(lineitem(spark, sf_dir))
    return r.select("i", F.size("js").cast("long").alias("n"), F.col("js")[0].alias("first_col"), F.element_at("js", -1).alias("last_col"))


@query("""WITH m AS (SELECT s_nationkey AS i, (s_suppkey % 25) AS j, sum(s_acctbal) AS v FROM supplier GROUP BY 1, 2)
  SELECT r.i::BIGINT AS i, c.j::BIGINT AS j, round(coalesce(v, 0.0), 4) AS v FROM range(25) r(i) CROSS JOIN range(25) c(j) LEFT JOIN m ON m.i = r.i AND m.j = c.j""")
def sparse_to_dense(spark, sf_dir):
    a = coo.coo(table(spark, sf_dir, "supplier").withColumn("c", F.col("s_suppkey") % 25), "s_nationkey", "c", "s_acctbal")
    return rounded(coo.dense(a, spark, 25, 25), "v")


@query("SELECT i, j, v FROM (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem) WHERE i = j UNION ALL SELECT i, j, v FROM (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem) WHERE i < j")
def upper_triangle(spark, sf_dir):
    return coo.upper(lineitem(spark, sf_dir))


@query("SELECT l_orderkey AS i, l_quantity AS v FROM lineitem WHERE l_orderkey = l_partkey")
def diagonal(spark, sf_dir):
    return coo.diagonal(lineitem(spark, sf_dir))


@query("""SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem WHERE l_orderkey <> l_partkey
  UNION ALL SELECT o_orderkey, o_orderkey, 7.0 FROM orders""")
def set_diagonal(spark, sf_dir):
    return coo.set_diagonal(lineitem(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")), 7.0)


@query("""WITH a AS (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem WHERE l_orderkey >= l_partkey)
  SELECT * FROM a UNION ALL SELECT j, i, v FROM a WHERE i <> j""")
def symmetric_mirror(spark, sf_dir):
    return coo.mirror(lineitem(spark, sf_dir).where("i >= j"))


@query("SELECT l_orderkey - 10 + 3 AS i, l_partkey - 5 + 1 AS j, l_quantity AS v FROM lineitem WHERE l_orderkey BETWEEN 10 AND 400 AND l_partkey BETWEEN 5 AND 120")
def block_copy(spark, sf_dir):
    return coo.block_copy(lineitem(spark, sf_dir), 10, 400, 5, 120, 3, 1)


@query("SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def gather_rows(spark, sf_dir):
    index = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("i"))
    return coo.gather_rows(lineitem(spark, sf_dir), index)


@query("""SELECT (a.n_regionkey * 25 + b.n_nationkey)::BIGINT AS i, (a.n_nationkey * 5 + b.n_regionkey)::BIGINT AS j, (a.n_nationkey * b.n_regionkey)::DOUBLE AS v
  FROM nation a CROSS JOIN nation b""")
def kronecker(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return coo.kron(coo.coo(n, "n_regionkey", "n_nationkey", F.col("n_nationkey")), coo.coo(n, "n_nationkey", "n_regionkey", F.col("n_regionkey")), 25, 5)


@query("""SELECT vec_id, sum(((x >> b) & 1) << (2 * b))::BIGINT + sum(((y >> b) & 1) << (2 * b + 1))::BIGINT AS z FROM
  (SELECT vec_id, least(floor(abs(embedding[1]::DOUBLE) / 64 * 1024), 1023)::BIGINT AS x, least(floor(abs(embedding[2]::DOUBLE) / 64 * 1024), 1023)::BIGINT AS y FROM embeddings)
  CROSS JOIN (SELECT unnest(range(10)) AS b) GROUP BY 1""")
def z_order(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", *[(F.abs(F.col("embedding")[k].cast("double")) / 64).alias(c) for k, c in enumerate("xy")])
    return coo.z_order(p, ["x", "y"]).select("vec_id", "z")


# ---- element-wise ----


_PART = "p_partkey AS i"


@query(f"SELECT {_PART}, p_retailprice AS c, 3.0 * p_retailprice AS s, p_retailprice + p_size AS a, -p_retailprice AS n FROM part")
def stream_copy_scale_add(spark, sf_dir):
    a, b = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), blas.copy(a).alias("c"), blas.scale(3.0, a).alias("s"), blas.add(a, b).alias("a"), (-a).alias("n"))


@query(f"SELECT {_PART}, round(p_retailprice + 3.0 * p_size, 6) AS v FROM part")
def triad(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(blas.triad(F.col("p_retailprice"), 3.0, F.col("p_size")), 6).alias("v"))


@query(f"SELECT {_PART}, round(p_size + (0.5 * p_retailprice + p_partkey), 6) AS v FROM part")
def triad_acc(spark, sf_dir):
    v = blas.triad_accumulate(F.col("p_size").cast("double"), 0.5, F.col("p_retailprice"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(v, 6).alias("v"))


@query(f"SELECT {_PART}, round(p_size + 2.5 * p_retailprice, 6) AS axpy, round(2.5 * p_size + p_retailprice, 6) AS xpay FROM part")
def axpy(spark, sf_dir):
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(blas.axpy(2.5, x, y), 6).alias("axpy"), F.round(blas.xpay(x, 2.5, y), 6).alias("xpay"))


@query("SELECT o_custkey AS i, round(sum(o_totalprice), 2) AS v FROM (SELECT o_custkey, o_totalprice FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer) GROUP BY 1")
def accumulate(spark, sf_dir):
    targets = coo.vec(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")
    return rounded(blas.accumulate(targets, coo.vec(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")), "v", digits=2)


@query("SELECT p_partkey AS i, round(p_retailprice * coalesce(q, 0), 4) AS v FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def diagonal_scale(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i")).agg(F.sum("l_quantity").alias("v"))
    return rounded(blas.diagonal_scale(m, prices(spark, sf_dir)), "v")


@query("SELECT n_nationkey::BIGINT AS i, round(n_regionkey * (SELECT sum(c_acctbal) FROM customer), 2) AS v FROM nation")
def outer_accumulate(spark, sf_dir):
    x = coo.vec(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")
    return rounded(blas.outer_accumulate(x, coo.vec(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")), "v", digits=2)


@query("SELECT c_custkey AS i, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS v FROM customer")
def mean_projection(spark, sf_dir):
    return rounded(blas.mean_projection(coo.vec(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")), "v")


@query("""SELECT p_partkey AS i, round(sqrt(p_size), 8) AS sqrt, round(ln(p_size), 8) AS log, round(log2(p_size), 8) AS log2, round(log10(p_size), 8) AS log10,
  round(exp(p_size / 50.0), 8) AS exp, round(pow(2.0, p_size / 10.0), 8) AS exp2, round(pow(10.0, p_size / 50.0), 8) AS exp10, round(sin(p_size), 8) AS sin, round(cos(p_size), 8) AS cos,
  round(pow(p_size, 1.5), 6) AS pow, greatest(p_size, 25.0)::DOUBLE AS max, least(p_size, 25.0)::DOUBLE AS min, abs(p_size - 25.0)::DOUBLE AS abs,
  round(CASE WHEN p_size = 25 THEN 0 ELSE 1 / (p_size - 25.0) END, 8) AS div, round(1 / sqrt(p_size), 8) AS rsqrt,
  round(p_size * p_retailprice + 1, 4) AS fmadd, round(1 - p_size * p_retailprice, 4) AS fnmadd, round(p_size * p_retailprice - 1, 4) AS fmsub,
  CASE WHEN p_size < 25 THEN p_retailprice ELSE p_size END AS blend FROM part""")
def scalar_math(spark, sf_dir):
    x, y, one = F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(1.0)
    f = {k: v for k, (_, v) in scalar.SURFACE.items()}
    unary = {k: F.round(f[k](x), 8) for k in ("sqrt", "log", "log2", "log10", "sin", "cos", "rsqrt")}
    rest = {
        "exp": F.round(f["exp"](x / 50.0), 8), "exp2": F.round(f["exp2"](x / 10.0), 8), "exp10": F.round(f["exp10"](x / 50.0), 8), "pow": F.round(f["pow"](x, F.lit(1.5)), 6),
        "max": f["max"](x, F.lit(25.0)), "min": f["min"](x, F.lit(25.0)), "abs": f["abs"](x - 25.0), "div": F.round(f["div"](one, x - 25.0), 8),
        "fmadd": F.round(f["fmadd"](x, y, one), 4), "fnmadd": F.round(f["fnmadd"](x, y, one), 4), "fmsub": F.round(f["fmsub"](x, y, one), 4), "blend": scalar.blend(x, y, x < 25),
    }
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), *[v.alias(k) for k, v in (unary | rest).items()])


# ---- reductions ----


@query("SELECT round(sum(p_retailprice * p_size), 4) AS dot FROM part")
def dot(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.round(blas.dot(F.col("p_retailprice"), F.col("p_size")), 4).alias("dot"))


@query("SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS nrm2 FROM customer")
def nrm2(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.round(blas.nrm2(F.col("c_acctbal")), 4).alias("nrm2"))


@query("SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS nrm2 FROM customer")
def nrm2_safe(spark, sf_dir):
    return rounded(blas.nrm2_safe(table(spark, sf_dir, "customer"), "c_acctbal"), "nrm2")


@query("""SELECT round(max(abs(l_extendedprice - l_quantity * 1000)), 4) AS max_abs_error, round(max(abs(l_extendedprice - l_quantity * 1000) / abs(l_quantity * 1000)), 6) AS max_rel_error,
  round(sqrt(sum(pow(l_extendedprice - l_quantity * 1000, 2))) / sqrt(sum(pow(l_quantity * 1000, 2))), 8) AS frobenius_rel_error FROM lineitem""")
def rel_error(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").agg(*blas.errors(F.col("l_extendedprice"), F.col("l_quantity") * 1000.0))
    return out.select(F.round("max_abs_error", 4).alias("max_abs_error"), F.round("max_rel_error", 6).alias("max_rel_error"), F.round("frobenius_rel_error", 8).alias("frobenius_rel_error"))


@query("SELECT c_nationkey, round(sum(c_acctbal), 4) AS value FROM customer GROUP BY 1")
def reduce_sum(spark, sf_dir):
    return rounded(blas.reduce_ranks(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal"), "sum"), "value")


@query("SELECT c_nationkey, bool_and(c_acctbal > -900) AS value FROM customer GROUP BY 1")
def reduce_and(spark, sf_dir):
    return blas.reduce_ranks(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal") > -900, "and")


@query("SELECT round(sum(s_acctbal), 4) AS trace FROM supplier WHERE s_nationkey = s_suppkey % 25")
def trace(spark, sf_dir):
    a = coo.coo(table(spark, sf_dir, "supplier").withColumn("c", F.col("s_suppkey") % 25), "s_nationkey", "c", "s_acctbal")
    return rounded(blas.trace(a), "trace")


@query("SELECT l_partkey AS j, round(sqrt(sum(l_quantity * l_quantity)), 6) AS norm FROM lineitem GROUP BY 1")
def col_norms(spark, sf_dir):
    return rounded(blas.column_norms(lineitem(spark, sf_dir)), "norm", digits=6)


@query("SELECT j, norm FROM (SELECT l_partkey AS j, sum(l_quantity * l_quantity) AS norm FROM lineitem GROUP BY 1) ORDER BY norm DESC, j LIMIT 1")
def pivot_column(spark, sf_dir):
    squares = lineitem(spark, sf_dir).groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))  # whole numbers: exact
    return blas.pivot_column(squares)


@query("""SELECT * FROM (SELECT 0 AS a, 0 AS b, round(sum(l_quantity * l_quantity), 4) AS v FROM lineitem UNION ALL SELECT 0, 1, round(sum(l_quantity * l_tax), 4) FROM lineitem
  UNION ALL SELECT 1, 0, round(sum(l_quantity * l_tax), 4) FROM lineitem UNION ALL SELECT 1, 1, round(sum(l_tax * l_tax), 4) FROM lineitem
  UNION ALL SELECT 0, -1, round(sum(l_quantity * l_discount), 4) FROM lineitem UNION ALL SELECT 1, -1, round(sum(l_tax * l_discount), 4) FROM lineitem)""")
def small_gram(spark, sf_dir):
    return rounded(blas.small_gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_discount"), "v")


@query("SELECT l_orderkey AS i, count(*) AS n FROM lineitem GROUP BY 1")
def row_histogram(spark, sf_dir):
    return coo.row_counts(lineitem(spark, sf_dir))


# ---- windows, order ----


@query("SELECT c_custkey AS i, (sum(c_nationkey) OVER (ORDER BY c_custkey) - c_nationkey)::BIGINT AS displacement FROM customer")
def displacements(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").cast("long").alias("n"))
    return coo.prefix_sum(d, "i", "n", "displacement", inclusive=False).select("i", "displacement")


@query("SELECT part, count(*) AS n, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM (SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey) AS part FROM supplier) GROUP BY 1")
def equal_split(spark, sf_dir):
    return blas.equal_split(table(spark, sf_dir, "supplier"), "s_suppkey", 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))


@query("SELECT q, (SELECT count(*) FROM orders WHERE o_totalprice < q) AS position FROM (SELECT DISTINCT s_acctbal * 40 AS q FROM supplier)")
def lower_bound(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    return blas.lower_bound(values, table(spark, sf_dir, "supplier").select((F.col("s_acctbal") * 40).alias("q")).distinct())


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + 100 AS fetched FROM events")
def fetch_add(spark, sf_dir):
    return blas.fetch_and_add(table(spark, sf_dir, "events"), "user_id", "event_id", 100).select("user_id", "event_id", F.col("fetched").cast("long").alias("fetched"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT l_orderkey AS i, l_partkey AS j, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1)::BIGINT AS place FROM lineitem")
def bucket_sort(spark, sf_dir):
    """Each entry with its place in its row as the sorted partitions hold it: by a count of the rows that a task sees, not by a window."""
    import numpy as np
    import pyarrow as pa

    def placed(batches):
        row, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            i = batch.column("i").to_numpy()
            first = np.r_[i[0] != row, i[1:] != i[:-1]]
            at = np.arange(len(i))
            begin = np.maximum.accumulate(np.where(first, at, 0))
            place = at - begin + np.where(np.cumsum(first) == 0, count, 0)  # a row may go on from the batch before
            row, count = i[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(place, pa.int64())], names=["i", "j", "place"])

    entries = lineitem(spark, sf_dir).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
    return coo.sorted_rows(entries).select("i", "j").mapInArrow(placed, "i long, j long, place long")


@query()
def sample_rows(spark, sf_dir):
    """Deterministic by hash order; DuckDB has no such hash."""
    return coo.sample_rows(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 128)


@query("""SELECT c_custkey, round(2 / sqrt(pi()) * x / 2000 / 3 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(x * k / 2000.0, 2))), 8) + 0.0 AS erf
  FROM (SELECT c_custkey, c_acctbal / 5000.0 AS x FROM customer) CROSS JOIN range(2001) t(k) GROUP BY c_custkey, x""")
def erf(spark, sf_dir):
    """DuckDB has no erf; its SQL integrates by Simpson's rule."""
    return table(spark, sf_dir, "customer").select("c_custkey", (F.round(scalar.erf(F.col("c_acctbal") / 5000.0), 8) + 0.0).alias("erf"))
