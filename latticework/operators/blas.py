"""Element-wise vector operations and reductions. Vectors are columns of one table where they share an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticework.functions.scalar import safe_div


def copy(a: Column) -> Column:
    return a


def scale(s: float, c: Column) -> Column:
    return c * s


def add(a: Column, b: Column) -> Column:
    return a + b


def triad(b: Column, s: float, c: Column) -> Column:
    return b + c * s


def triad_accumulate(z: Column, alpha: float, x: Column, y: Column) -> Column:
    """z + (alpha x + y): unlike ``triad`` it adds to what is there."""
    return z + (x * alpha + y)


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return y + x * alpha


def xpay(x: Column, alpha: float, y: Column) -> Column:
    return y * alpha + x


def vector_add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha a + beta b of two vector tables; an index that only one has counts as zero in the other. One shuffle: a
    grouped sum of the union, combined before it is sent."""
    return a.select("i", (F.col("v") * alpha).alias("v")).unionByName(b.select("i", (F.col("v") * beta).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def diagonal_scale(m: DataFrame, r: DataFrame) -> DataFrame:
    """m .* r; indices without an entry in m give zero."""
    return r.join(m.withColumnRenamed("v", "m"), "i", "left").select("i", (F.coalesce("m", F.lit(0.0)) * F.col("v")).alias("v"))


def outer_accumulate(x: DataFrame, y: DataFrame) -> DataFrame:
    """z[j] = (sum of x) y[j]: what adding x[i] y[j] over all i gives, without the product table."""
    total = x.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("t"))
    return y.crossJoin(total).select("i", (F.col("v") * F.col("t")).alias("v"))


def mean_projection(x: DataFrame) -> DataFrame:
    """x less its mean: the mean is one row, joined back."""
    mean = x.agg(F.avg("v").alias("m"))
    return x.crossJoin(F.broadcast(mean)).select("i", (F.col("v") - F.col("m")).alias("v"))


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def nrm2(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def nrm2_safe(df: DataFrame, x: str, out: str = "nrm2") -> DataFrame:
    """2-norm without overflow: scaled by the largest magnitude, which a first pass finds."""
    top = df.agg(F.max(F.abs(F.col(x))).alias("m"))
    s = safe_div(F.col(x), F.col("m"))
    return df.crossJoin(F.broadcast(top)).agg((F.max("m") * F.sqrt(F.sum(s * s))).alias(out))


def relative_error(x: Column, reference: Column) -> Column:
    d = x - reference
    return safe_div(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(reference * reference)))


def errors(x: Column, reference: Column) -> list[Column]:
    """max_abs_error, max_rel_error (over non-zero references) and frobenius_rel_error, in one pass."""
    d = F.abs(x - reference)
    return [
        F.max(d).alias("max_abs_error"),
        F.max(F.when(reference != 0, safe_div(d, F.abs(reference)))).alias("max_rel_error"),
        relative_error(x, reference).alias("frobenius_rel_error"),
    ]


def reduce_ranks(df: DataFrame, key: str, value: Column, how: str) -> DataFrame:
    """Per key the sum or logical AND of the ranks' values."""
    made = {"sum": F.sum, "and": F.bool_and, "max": F.max, "min": F.min}[how](value)
    return df.groupBy(key).agg(made.alias("value"))


def accumulate(targets: DataFrame, updates: DataFrame) -> DataFrame:
    """Each target (i, v) plus the sum of the updates sent to it."""
    return vector_add(targets, updates)


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def column_norms(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def pivot_column(norms: DataFrame) -> DataFrame:
    """The column of the largest norm; the lowest index among equals."""
    return norms.agg(F.min_by("j", F.struct((-F.col("norm")).alias("n"), F.col("j"))).alias("j"), F.max("norm").alias("norm"))


def small_gram(df: DataFrame, columns: list[str], other: str) -> DataFrame:
    """F'F and F'f for the vectors in ``columns`` and ``other``, all sums in one pass: rows (a, b, v), b = -1 for f."""
    pairs = [(p, q) for p in range(len(columns)) for q in range(len(columns))] + [(p, -1) for p in range(len(columns))]
    sums = [F.sum(F.col(columns[p]) * F.col(columns[q] if q >= 0 else other)).alias(f"s{k}") for k, (p, q) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"s{k}").alias("v")) for k, (p, q) in enumerate(pairs)])
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum in a total order without a task that sees all rows: rows are dealt into ranges of the order and written,
    ranges' sums are added up (a row for each), and each range adds its own rows to what comes before it."""
    from latticework.tables import cut, n_partitions

    n = n_partitions(df.sparkSession, df)
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(before, "_p").withColumn(out, within + F.col("_b")).drop("_p", "_b")


def equal_split(df: DataFrame, order: str | list[str], parts: int) -> DataFrame:
    """Rows in order (no ties) dealt into equal runs, the first ones with the remainder: column ``part`` from 1."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), [order] if isinstance(order, str) else order, "_one", "_r")
    total = ranked.agg(F.count(F.lit(1))).first()[0]
    size, rest = divmod(total, parts)
    at = F.col("_r") - 1
    part = F.when(at < (size + 1) * rest, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - (size + 1) * rest) / max(1, size)))
    return ranked.withColumn("part", (part + 1).cast("int")).drop("_one", "_r")


def fetch_and_add(df: DataFrame, counter: str, order: str, base: int = 0) -> DataFrame:
    """What each row would have fetched from its counter, in ``order``: the reference's order is the race's. A counter's rows may be
    in many ranges of the order, so a busy one is many tasks' work."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), [counter, order], "_one", "_rank").drop("_one")
    starts = ranked.groupBy(F.col(counter).alias("_counter")).agg(F.min("_rank").alias("_first"))
    return ranked.join(starts, F.col(counter).eqNullSafe(F.col("_counter"))).withColumn("fetched", (F.col("_rank") - F.col("_first") + base).cast("int")).drop("_rank", "_first", "_counter")


def lower_bound(sorted_values: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query (q) the number of values (v) below it: one sort of the union, no pair of a query and a value."""
    both = sorted_values.select(F.col("v"), F.lit(1).alias("n"), F.lit(1).alias("kind")).unionByName(queries.select(F.col("q").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("kind")))
    return running_total(both, ["v", "kind"], "n", "position").where("kind = 0").select(F.col("v").alias("q"), "position")
