"""All-pairs sums over point sets (id, x, y, z, q or qx, qy, qz; or id and an array of coordinates).

Every target meets every source: that is the operator. Targets and sources are dealt into blocks and meet by an
key on the pair of block numbers, so the work spreads over blocks^2 steps of tasks without broadcasting a side. A step goes over tiles of its
pair of blocks and gives one part of a sum for each point: no pair of points is ever a row. Points are sent once for each block, of which there
are few: what is sent grows with the points. Products with kernels of coordinate arrays
take a pair of blocks as three matrix products in one task; with a tolerance, blocks that are far apart become products
of two thin factors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import kernels
from latticework.operators.trees import kd_tree
from latticework.tables import n_partitions


BLOCK_ROWS, MOST_ROWS = 4096, 1 << 16
FEW_BLOCKS = 32
KERNEL_TILE = 256, 512  # of products with coordinate arrays: a megabyte, which a core's cache holds
TILE = 16, 960  # an array of a tile is below what the C library maps anew each time, and stays in a core's cache


def blocks_of(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """As many blocks as keep one at ``block_rows``; no more than ``FEW_BLOCKS`` while they then stay within ``MOST_ROWS``, as a row is sent once
    for each block."""
    return max(min(FEW_BLOCKS, -(-rows // block_rows)), -(-rows // max(block_rows, MOST_ROWS)))


def block_count(targets: DataFrame, sources: DataFrame) -> int:
    return max(4, blocks_of(max(targets.count(), sources.count())))


def pairs(targets: DataFrame, sources: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (a, b) of structs: each target with each source."""
    blocks = blocks or block_count(targets, sources)
    block = lambda d: F.pmod(F.xxhash64(*d.columns), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = targets.select(F.struct("*").alias("a"), block(targets).alias("ba")).withColumn("bb", every)
    b = sources.select(F.struct("*").alias("b"), block(sources).alias("bb")).withColumn("ba", every)
    return a.join(b, ["ba", "bb"]).select("a", "b")


def _position(p: str) -> list[Column]:
    return [F.col(f"{p}.{c}") for c in "xyz"]


def _sums(targets: DataFrame, sources: DataFrame, given: tuple[list[str], list[str]], step: Callable, out: list[str], blocks: int | None) -> DataFrame:
    """Rows (side, id, *out) with parts of sums, for the targets (side 0) and, where ``step`` gives them, the sources (side 1).

    ``given``: the columns of both sides, x, y, z first. A pair of blocks is a step of one task, over tiles of it: ``step(a, b, va, vb)``
    adds to va (targets x out) and vb (sources x out) what a tile gives, a and b being its columns. What has a null counts as SQL's
    sums count it: a point without a place gets null, one without a charge gives nothing."""
    spark = targets.sparkSession
    blocks = blocks or block_count(targets, sources)
    width = max(map(len, given))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def side(d: DataFrame, k: int) -> DataFrame:
        own = F.pmod(F.xxhash64(*d.columns), F.lit(blocks)).cast("int")
        held = d.select(own.alias("own"), every.alias("other"), F.col("id").cast("long").alias("id"), *[(F.col(given[k][c]) if c < len(given[k]) else F.lit(None)).cast("double").alias(f"c{c}") for c in range(width)])
        at = F.col("own") * blocks + F.col("other") if k == 0 else F.col("other") * blocks + F.col("own")
        return held.select(at.alias("key"), F.lit(k).alias("side"), "id", *[f"c{c}" for c in range(width)])

    def products(held: list[pa.RecordBatch]):
        met = pa.Table.from_batches(held)
        sides = met.column("side").to_numpy()
        cut = int(np.searchsorted(sides, 1))
        ids, columns, placed, charged, sums = [], [], [], [], []
        for k, (lo, hi) in enumerate(((0, cut), (cut, len(sides)))):
            part = met.slice(lo, hi - lo).combine_chunks()
            whole = [part.column(f"c{c}").is_valid().to_numpy() for c in range(len(given[k]))]
            placed.append(np.logical_and.reduce(whole[:3]))
            charged.append(np.logical_and.reduce(whole))
            ids.append(part.column("id").combine_chunks())
            columns.append([part.column(f"c{c}").to_numpy(zero_copy_only=False) for c in range(len(given[k]))])
            sums.append(np.zeros((hi - lo, len(out))))
        two = len(given[0]) > 3  # the targets have charges, too
        a, b = [c[placed[0]] for c in columns[0]], [c[placed[1]] for c in columns[1]]
        if two:  # nothing from a point that has no whole charge
            a[3:] = [np.where(charged[0][placed[0]], c, 0.0) for c in a[3:]]
        b[3:] = [np.where(charged[1][placed[1]], c, 0.0) for c in b[3:]]
        va, vb = np.zeros((len(a[0]), len(out))), np.zeros((len(b[0]), len(out)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(0, len(va), TILE[0]):
                for m in range(0, len(vb), TILE[1]):
                    n2, m2 = n + TILE[0], m + TILE[1]
                    step([c[n:n2] for c in a], [c[m:m2] for c in b], va[n:n2], vb[m:m2])
        for k, (v, other) in enumerate(((va, charged[1]), (vb, charged[0]))[: 1 + two]):
            if len(ids[k]):
                sums[k][placed[k]] = v
                none = ~placed[k] | ~other.any() if len(other) else None
                if none is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(none), k, np.int32)), ids[k], *[pa.array(sums[k][:, c], mask=none) for c in range(len(out))]], names=["side", "id", *out])

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[lo] != key:
                    if held:
                        yield from products(held)
                    key, held = keys[lo], []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from products(held)

    tasks = min(blocks * blocks, max(n_partitions(spark, targets), 4 * spark.sparkContext.defaultParallelism))
    met = side(targets, 0).unionByName(side(sources, 1)).repartitionById(tasks, F.col("key")).sortWithinPartitions("key", "side")
    return met.mapInArrow(run, ", ".join(["side int, id long", *(f"{c} double" for c in out)]))


def _tile(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Separations and their squared length, targets x sources."""
    return kernels.separation([x[:, None] for x in a[:3]], [y[None, :] for y in b[:3]])


def _vector_tile(a: list[np.ndarray], b: list[np.ndarray], kernel) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Separations, t1, and t2 over the squared length (0 where points coincide)."""
    d, r2 = _tile(a, b)
    inv = kernels.reciprocal(r2)
    t1, t2 = kernel(r2, np.sqrt(r2), inv)
    inv *= inv
    inv *= t2
    return d, t1, inv


def _act(d: list[np.ndarray], t1: np.ndarray, t2: np.ndarray, q: list[np.ndarray], v: np.ndarray, sources: bool) -> None:
    """Adds the kernel times (qx, qy, qz) of one side to the other's sums."""
    along = sum((x * c for x, c in zip(d[1:], q[1:])), d[0] * q[0])
    along *= t2
    for k in range(3):
        line = q[k].ravel()
        v[:, k] += line @ t1 + np.einsum("ij,ij->j", along, d[k]) if sources else t1 @ line + np.einsum("ij,ij->i", along, d[k])


def _side() -> Column:
    return F.when(F.col("side") == 0, "left").otherwise("right").alias("side")


def scalar_sum(targets: DataFrame, sources: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = kernels.reciprocal, blocks: int | None = None) -> DataFrame:
    """Per target the sum of kernel(r^2) q over all sources: rows (id, v). ``kernel`` takes and gives numpy arrays."""

    def step(a, b, va, vb):
        va[:, 0] += kernel(_tile(a, b)[1]) @ b[3]

    return _sums(targets, sources, ([*"xyz"], [*"xyzq"]), step, ["v"], blocks).groupBy("id").agg(F.sum("v").alias("v"))


def vector_sum(targets: DataFrame, sources: DataFrame, kernel=kernels.rpy, blocks: int | None = None) -> DataFrame:
    """Per target the sum of a 3 x 3 kernel times (qx, qy, qz): rows (id, vx, vy, vz)."""

    def step(a, b, va, vb):
        _act(*_vector_tile(a, b, kernel), [q[None, :] for q in b[3:]], va, False)

    out = ["vx", "vy", "vz"]
    return _sums(targets, sources, ([*"xyz"], [*"xyz", "qx", "qy", "qz"]), step, out, blocks).groupBy("id").agg(*[F.sum(c).alias(c) for c in out])


def symmetric_sum(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = kernels.reciprocal, blocks: int | None = None) -> DataFrame:
    """K q(right) at the left points and K' q(left) at the right points from one sweep: rows (side, id, v). The kernel is evaluated
    once for both."""

    def step(a, b, va, vb):
        k = kernel(_tile(a, b)[1])
        va[:, 0] += k @ b[3]
        vb[:, 0] += a[3] @ k

    return _sums(left, right, ([*"xyzq"], [*"xyzq"]), step, ["v"], blocks).groupBy(_side(), "id").agg(F.sum("v").alias("v"))


def symmetric_vector_sum(left: DataFrame, right: DataFrame, kernel=kernels.rpy, blocks: int | None = None) -> DataFrame:
    """As symmetric_sum for a symmetric 3 x 3 kernel, which is even in the separation: rows (side, id, vx, vy, vz). The kernel's terms are
    evaluated once for both."""

    def step(a, b, va, vb):
        d, t1, t2 = _vector_tile(a, b, kernel)
        _act(d, t1, t2, [q[None, :] for q in b[3:]], va, False)
        _act(d, t1, t2, [q[:, None] for q in a[3:]], vb, True)

    given, out = [*"xyz", "qx", "qy", "qz"], ["vx", "vy", "vz"]
    return _sums(left, right, (given, given), step, out, blocks).groupBy(_side(), "id").agg(*[F.sum(c).alias(c) for c in out])


def _met(targets: DataFrame, sources: DataFrame, kernel, blocks: int | None) -> DataFrame:
    """Pairs with the kernel's t1 and t2 and the unit separation e0, e1, e2, each a column of its own: inlined into the
    products, they would outgrow a generated method."""
    met = pairs(targets, sources, blocks)
    met = met.select("a", "b", *[(x - y).alias(f"d{k}") for k, (x, y) in enumerate(zip(_position("a"), _position("b")))])
    d = [F.col(f"d{k}") for k in range(3)]
    met = met.withColumn("r2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).withColumn("r", F.sqrt("r2")).withColumn("inv", kernels.reciprocal(F.col("r2")))
    t1, t2 = kernel(F.col("r2"), F.col("r"), F.col("inv"))
    return met.select("a", "b", t1.alias("t1"), t2.alias("t2"), *[(x * F.col("inv")).alias(f"e{k}") for k, x in enumerate(d)])


def squared_distance(a: Column, b: Column) -> Column:
    """Of two coordinate arrays of any equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _block_pairs(points: DataFrame, rows: int, apart: bool) -> DataFrame:
    """(i, j, block, leaf, id, p, q): each point with each block. Where they are to be ``apart`` points are in leaves of a k-d tree of at most ``rows``,
    and a block is a subtree; else blocks are any even ones."""
    if apart:
        dealt, levels = kd_tree(points, rows)
        below = max(0, levels - (blocks_of(rows << levels, rows) - 1).bit_length())
        dealt, blocks = dealt.withColumn("block", F.shiftright("leaf", below)), 1 << (levels - below)
    else:
        blocks = max(1, blocks_of(points.count(), rows))
        dealt = points.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "leaf": F.lit(0).cast("long")})
    dealt = dealt.select("block", "leaf", "id", "p", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    return dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "leaf", "id", "p", "q")


PROBE = 16


def may_be_thin(a: np.ndarray, b: np.ndarray, entry, tolerance: float) -> bool:
    """Whether a few rows and columns let a rank of a third of the smaller side be hoped for; where not, making thin factors would only take time."""
    most = min(len(a), len(b)) // 3
    if most <= PROBE:
        return most > 0
    some = lambda x: x[np.linspace(0, len(x) - 1, PROBE).astype(np.int64)]
    s = np.linalg.svd(entry(some(a), some(b)), compute_uv=False)
    return s[-1] <= s[0] * tolerance ** (PROBE / most)


def thin_factors(a: np.ndarray, b: np.ndarray, entry, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """U and V with U V' near the kernel's matrix of two point blocks, by cross approximation with partial pivoting: rows and columns of
    the matrix are made one at a time, and None is given where the rank passes a third of the smaller side."""
    most = min(len(a), len(b)) // 3
    u, v = np.zeros((len(a), 0)), np.zeros((len(b), 0))
    used, size, row = np.zeros(len(a), bool), 0.0, 0
    while u.shape[1] < most:
        used[row] = True
        line = entry(a[row : row + 1], b)[0] - u[row] @ v.T
        column = int(np.abs(line).argmax())
        if line[column] != 0.0:
            x, y = entry(a, b[column : column + 1])[:, 0] - u @ v[column], line / line[column]
            size += 2 * ((u.T @ x) * (v.T @ y)).sum() + (x @ x) * (y @ y)
            u, v = np.column_stack([u, x]), np.column_stack([v, y])
            if np.sqrt((x @ x) * (y @ y)) <= tolerance * np.sqrt(max(size, 0.0)):
                return u, v
        elif used.all():
            return u, v
        left = np.where(used, -1.0, np.abs(u[:, -1]) if u.shape[1] else 0.0)
        row = int(left.argmax())
        if used[row]:
            return u, v
    return None


def kernel_matvec(points: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], mu: float = 0.0, rows: int = 2048, tolerance: float = 0.0) -> DataFrame:
    """Per point of (id, p, q) the sum of kernel(r^2) q over all, the diagonal being 1 + mu: rows (id, v, thin). ``kernel`` takes and
    gives numpy arrays; ids are unique. A pair of blocks is one task's step and serves both: memory is that of two blocks and a tile. Blocks have
    ``rows`` points, or more where there would be more than a few of them.

    With a positive ``tolerance`` blocks are subtrees of a k-d tree with leaves of at most ``rows``, and a pair of different leaves is compressed to two
    thin factors first, where their rank allows; ``thin`` counts the leaves that a point met so."""
    spark = points.sparkSession
    given = points.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"), F.col("q").cast("double").alias("q"))

    def entry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return kernel(np.maximum(r2, 0.0))

    def dense(x, y, p, q, v):
        """Adds what two ranges of points give each other, or one itself (the diagonal is set, not computed), a bounded tile at a time."""
        # one matrix product gives a tile's squared distances: (a, a a, 1) times (-2 b, 1, b b)
        left = np.column_stack([p[x], (p[x] * p[x]).sum(1), np.ones(x.stop - x.start)])
        right = np.column_stack([-2.0 * p[y], np.ones(y.stop - y.start), (p[y] * p[y]).sum(1)]).T
        for at in range(x.start, x.stop, KERNEL_TILE[0]):
            n = slice(at, min(at + KERNEL_TILE[0], x.stop))
            for to in range(y.start, y.stop, KERNEL_TILE[1]):
                m = slice(to, min(to + KERNEL_TILE[1], y.stop))
                r2 = left[n.start - x.start : n.stop - x.start] @ right[:, m.start - y.start : m.stop - y.start]
                tile = kernel(np.maximum(r2, 0.0, out=r2))
                if x == y:
                    both = np.arange(max(n.start, m.start), min(n.stop, m.stop))
                    tile[both - n.start, both - m.start] = 1.0 + mu
                else:
                    v[m] += q[n] @ tile
                v[n] += tile @ q[m]

    def products(key, held):
        block, leaf, ids, p, q = (np.concatenate(x) for x in held)
        v, thin = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        cuts = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1), len(ids)]
        leaves = [(block[lo], slice(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:])]
        for k, (own, x) in enumerate(leaves):
            for other, y in leaves[k if key[0] == key[1] else k + 1 :]:
                if key[0] != key[1] and own == other:
                    continue  # met where the block meets itself
                made = thin_factors(p[x], p[y], entry, tolerance) if tolerance > 0 and x != y and may_be_thin(p[x], p[y], entry, tolerance) else None
                if made is None:
                    dense(x, y, p, q, v)
                    continue
                v[x] += made[0] @ (made[1].T @ q[y])
                v[y] += made[1] @ (made[0].T @ q[x])
                thin[x] += 1
                thin[y] += 1
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v), pa.array(thin)], names=["id", "v", "thin"])

    def run(batches):
        key, held = None, ([], [], [], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j"))
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), len(i)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if key != (i[lo], j[lo]):
                    if held[0]:
                        yield products(key, held)
                    key, held = (i[lo], j[lo]), ([], [], [], [], [])
                part = batch.slice(lo, hi - lo)
                for h, c in zip(held, ("block", "leaf", "id", "p", "q")):
                    column = part.column(c)
                    h.append((column.flatten() if c == "p" else column).to_numpy(zero_copy_only=False).copy())
                held[3][-1] = held[3][-1].reshape(hi - lo, -1)
        if held[0]:
            yield products(key, held)

    met = _block_pairs(given, rows, tolerance > 0).repartition(n_partitions(spark, points), "i", "j").sortWithinPartitions("i", "j", "block", "leaf")
    return met.mapInArrow(run, "id long, v double, thin long").groupBy("id").agg(F.sum("v").alias("v"), F.sum("thin").alias("thin"))


MOST_TERMS = 1 << 13
MOMENT_TILE = 1 << 20  # entries of the terms of some points at a time


def gauss_degree(reach: float) -> int:
    """The least m for which exp(-|u - v|^2 / 2) over points no farther than ``reach`` from the origin is its terms of total degree m at most, to
    2^-60: what is left out is below reach^(2 m + 2) / (m + 1)!, and a double keeps 2^-53."""
    m, rest = 0, reach * reach
    while rest > 2.0**-60:
        m += 1
        rest *= reach * reach / (m + 1)
    return m


def gauss_terms(dims: int, degree: int) -> np.ndarray:
    """Exponents (terms x dims) of total degree ``degree`` at most."""
    out = np.zeros((1, 0), np.int64)
    for _ in range(dims):
        each = [np.column_stack([out, np.full(len(out), k)]) for k in range(degree + 1)]
        out = np.concatenate(each)
        out = out[out.sum(1) <= degree]
    return out


def gauss_matvec(points: DataFrame, length: float, mu: float = 0.0) -> DataFrame:
    """``kernel_matvec`` with the kernel exp(-r^2 / length^2), all pairs to a double's rounding: rows (id, v).

    With u = (x - centre) sqrt(2) / length, the kernel is the sum over exponents a of f_a(u) f_a(v), f_a(u) = exp(-|u|^2 / 2) u^a / sqrt(a!). The points' sums of q f_a are
    made once and each point takes its value from them, so work is the points times the terms. The terms go so far that those left out are below
    a double's rounding (``gauss_degree``), and none is greater than the kernel's one, so nothing cancels. Where that takes over ``MOST_TERMS`` terms (points far
    apart for the length, many coordinates) or a place is not finite, all pairs are summed one by one."""
    given = points.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"), F.col("q").cast("double").alias("q"))
    sides = given.agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("held"), F.min(F.size("p")).alias("least"), F.max(F.size("p")).alias("most")).first()
    every = lambda: kernel_matvec(points, kernels.gauss_array(length), mu).select("id", "v")
    if not sides["n"] or sides["held"] < sides["n"] or not 0 < sides["least"] == sides["most"] <= 8:
        return every()
    dims = sides["most"]
    box = given.agg(*[f(F.col("p")[k]).alias(f"{name}{k}") for k in range(dims) for name, f in (("lo", F.min), ("hi", F.max))], *[F.count(F.col("p")[k]).alias(f"n{k}") for k in range(dims)]).first()
    lo, hi = (np.array([np.nan if box[f"{name}{k}"] is None else box[f"{name}{k}"] for k in range(dims)]) for name in ("lo", "hi"))
    scale = np.sqrt(2.0) / length
    with np.errstate(over="ignore", invalid="ignore"):
        centre = (lo + hi) / 2
        reach = float(np.sqrt((((hi - lo) / 2) ** 2).sum()) * scale)
    if min(box[f"n{k}"] for k in range(dims)) < sides["n"] or not reach <= 8.0 or math.comb((degree := gauss_degree(reach)) + dims, dims) > MOST_TERMS:
        return every()
    terms = gauss_terms(dims, degree)
    rows = max(1, MOMENT_TILE // len(terms))

    def tiles(batch: pa.RecordBatch):
        """Some points at a time: their place in the batch and the terms of each."""
        p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for at in range(0, len(p), rows):
            u = (p[at : at + rows] - centre) * scale
            out = np.exp(-(u * u).sum(1) / 2)[:, None]
            for k in range(dims):
                power = np.ones((len(u), degree + 1))
                for m in range(1, degree + 1):
                    power[:, m] = power[:, m - 1] * u[:, k] / math.sqrt(m)
                out = out * power[:, terms[:, k]]
            yield slice(at, at + len(u)), out

    def charges(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("q").to_numpy(zero_copy_only=False)

    def moments(batches):
        sums = np.zeros(len(terms))
        for batch in batches:
            for these, out in tiles(batch):
                sums += charges(batch)[these] @ out
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(sums)], names=["term", "v"])

    # as many rows as there are terms
    found = given.select("p", "q").mapInArrow(moments, "term long, v double").groupBy("term").agg(F.sum("v").alias("v")).orderBy("term").collect()
    of = np.array([r["v"] for r in found])

    def values(batches):
        for batch in batches:
            v = mu * charges(batch)
            for these, out in tiles(batch):
                v[these] += out @ of
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(v)], names=["id", "v"])

    return given.mapInArrow(values, "id long, v double")


def kernel_matrix(points: DataFrame, kernel: Callable[[Column], Column], mu: float = 0.0, blocks: int | None = None) -> DataFrame:
    """The kernel matrix itself as (i, j, v)."""
    entry = F.when(F.col("a.id") == F.col("b.id"), F.lit(1.0 + mu)).otherwise(kernel(squared_distance(F.col("a.p"), F.col("b.p"))))
    return pairs(points, points, blocks).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), entry.alias("v"))


def stokes_rows(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows of the same matrix, each added up, and added up times the columns: (i, total, weighted). Entries are made a tile at a time, in tasks,
    and none leaves its task."""

    def step(a, b, va, vb):
        d, t1, t2 = _vector_tile(a, b, kernels.stokes)
        once = np.ones(len(b[3]))
        for k in range(3):
            for c in range(3):
                if k <= c:
                    entries = d[k] * d[c]
                    entries *= t2
                    if k == c:
                        entries += t1
                    va[:, 2 * k : 2 * k + 2] += entries @ np.stack([once, 3 * b[3] + c], 1)
                    if k < c:  # the entry of c and k is the same
                        va[:, 2 * c : 2 * c + 2] += entries @ np.stack([once, 3 * b[3] + k], 1)

    given = points.select("id", *"xyz", F.col("id").alias("column"))
    out = [f"{s}{k}" for k in range(3) for s in ("total", "weighted")]
    sums = _sums(given, given, ([*"xyz"], [*"xyz", "column"]), step, out, blocks).groupBy("id").agg(*[F.sum(c).alias(c) for c in out])
    rows = F.array(*[F.struct((F.col("id") * 3 + k).alias("i"), F.col(f"total{k}").alias("total"), F.col(f"weighted{k}").alias("weighted")) for k in range(3)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def stokes_matrix(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """The 3n x 3n Stokes kernel matrix as (i, j, v): row 3 id + k, column 3 id + l."""
    met = _met(points, points, kernels.stokes, blocks)
    entry = lambda k, c: F.col("t2") * F.col(f"e{k}") * F.col(f"e{c}") + (F.col("t1") if k == c else F.lit(0.0))
    cells = F.array(*[F.struct((F.col("a.id") * 3 + k).alias("i"), (F.col("b.id") * 3 + c).alias("j"), entry(k, c).alias("v")) for k in range(3) for c in range(3)])
    return met.select(F.explode(cells).alias("c")).select("c.*")
