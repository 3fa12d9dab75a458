"""Factorizations. Tall matrices are rows (i, v array) of one bounded width: Spark reduces them to width x width, a small
dense kernel runs on the driver, and row-local steps go back to Spark. The sequential dense algorithms at the end
run on the driver in numpy and say so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.rows import by_row
from latticework.operators.sparse import gram_rows


def tall(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("i"), F.col(column).cast("array<double>").alias("v"))


def small(entries: DataFrame) -> np.ndarray:
    """A small coordinate matrix (its size bounded by the width) as an array."""
    rows = entries.collect()
    n, m = (1 + max((r[c] for r in rows), default=-1) for c in ("i", "j"))
    out = np.zeros((n, m))
    for r in rows:
        out[r["i"], r["j"]] += r["v"]
    return out


def _map_rows(rows: DataFrame, f) -> DataFrame:
    """Replaces each batch's matrix of rows by f of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"i": batch["i"], "v": list(f(np.stack(batch["v"].to_numpy())))})

    return rows.mapInPandas(run, "i long, v array<double>")


def times(rows: DataFrame, right: np.ndarray) -> DataFrame:
    """Rows times a small matrix."""
    return _map_rows(rows, lambda x: x @ right)


def solve_right(rows: DataFrame, r: np.ndarray) -> DataFrame:
    """Rows times the inverse of an upper triangular matrix."""
    return times(rows, np.linalg.inv(r))


def cholesky_qr(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Q (rows) and R with A = Q R from one Gram reduction; needs full column rank."""
    r = np.linalg.cholesky(small(gram_rows(rows, "v"))).T
    return solve_right(rows, r), r


def cholesky_qr2(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Twice, which makes Q orthogonal to rounding."""
    q, r1 = cholesky_qr(rows)
    q, r2 = cholesky_qr(q)
    return q, r2 @ r1


def tsqr_r(rows: DataFrame) -> np.ndarray:
    """R of a tall matrix: each batch keeps the R of itself and what it has kept, so a partition sends one small block, and
    the driver factors the stack of as many blocks as partitions."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({"v": list(r)})

    blocks = rows.select("v").mapInPandas(local, "v array<double>").collect()
    r = np.linalg.qr(np.array([b["v"] for b in blocks]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_qr(rows: DataFrame, block: int = 1024, fan: int = 8) -> tuple[DataFrame, np.ndarray]:
    """Q (rows) and R with A = Q R by a tree of Householder factorizations; R has a positive diagonal.

    Blocks of rows are factored where they are and keep their Q; the R of ``fan`` blocks are stacked and factored, level by level, and what
    each child has of the Q of that is multiplied back down. Q is never A R^-1, so it is orthogonal to rounding whatever the
    condition of A; nothing is stacked on the driver, which gets one R."""
    from latticework.operators.blas import running_total
    from latticework.tables import cut

    width = rows.select(F.max(F.size("v"))).first()[0] or 0

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        k, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                q, r = np.linalg.qr(np.array(some.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_pylist([{"key": part << 32 | k, "ids": some.column(0).to_pylist(), "q": q.tobytes(), "r": r.tobytes()}], schema=pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("q", pa.binary()), ("r", pa.binary())]))
                k += 1

    blocks = cut(rows.select("i", "v").mapInArrow(local, "key long, ids array<long>, q binary, r binary"))
    numbers = running_total(blocks.select("key").withColumn("one", F.lit(1).cast("long")), ["key"], "one", "node").select("key", (F.col("node") - 1).alias("node"))
    blocks = cut(blocks.join(numbers, "key").drop("key"))
    n, level, shares = blocks.count(), blocks.select("node", "r"), []
    if not n:
        return rows, np.zeros((0, 0))

    def array(raw) -> np.ndarray:
        return np.frombuffer(raw, np.float64).reshape(-1, width)

    def stack(row):
        parts = [array(c["r"]) for c in row["children"]]
        q, r = np.linalg.qr(np.vstack(parts))
        ends = np.cumsum([len(p) for p in parts])
        return [{"parent": row["node"], "node": c["node"], "share": q[e - len(p) : e].tobytes(), "r": r.tobytes()} for c, p, e in zip(row["children"], parts, ends)]

    while n > 1:
        above = level.groupBy(F.expr(f"node div {fan}L").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "r"))).alias("children"))
        made = cut(by_row(above, stack, "parent long, node long, share binary, r binary"))
        shares.append(made.drop("r"))
        level, n = made.groupBy(F.col("parent").alias("node")).agg(F.first("r").alias("r")), -(-n // fan)
    r = array(level.first()["r"])
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    turn = rows.sparkSession.createDataFrame([(0, bytearray(np.diag(sign).tobytes()))], "node long, turn binary")
    k = len(sign)  # rows of the last R: the width, or all rows where they are fewer

    def down(row):
        t = np.frombuffer(row["turn"], np.float64).reshape(-1, k)
        return [{"node": row["node"], "turn": (np.frombuffer(row["share"], np.float64).reshape(-1, len(t)) @ t).tobytes()}]

    for share in reversed(shares):
        turn = by_row(share.join(turn.withColumnRenamed("node", "parent"), "parent"), down, "node long, turn binary")

    def apply(row):
        t = np.frombuffer(row["turn"], np.float64).reshape(-1, k)
        q = np.frombuffer(row["q"], np.float64).reshape(len(row["ids"]), -1) @ t
        return [{"i": i, "v": v} for i, v in zip(row["ids"], q.tolist())]

    return by_row(blocks.join(turn, "node").select("ids", "q", "turn"), apply, "i long, v array<double>"), r * sign[:, None]


def randomized_xr(rows: DataFrame, width: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Preconditions by the R of 2 x width sampled rows: A R^-1 is well conditioned, not orthogonal."""
    from latticework.operators.coo import sample_rows

    picked = np.array([r["v"] for r in sample_rows(rows, "i", 2 * width, seed).collect()])
    r = np.linalg.qr(picked, mode="r")
    return solve_right(rows, r), r


def block_gram_schmidt(rows: DataFrame, width: int, panel: int, passes: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Block modified Gram-Schmidt: panels are made orthogonal by their Gram matrix and taken out of what follows;
    ``passes`` of 2 restores orthogonality. Each panel is one reduction and one row-local update."""
    from latticework.tables import cut

    total, q = np.eye(width), rows
    for _ in range(passes):
        r = np.zeros((width, width))
        for a in range(0, width, panel):
            b = min(a + panel, width)
            g = small(gram_rows(q, "v"))
            r[a:b, a:b] = np.linalg.cholesky(g[a:b, a:b]).T
            inv = np.linalg.inv(r[a:b, a:b])
            r[a:b, b:] = inv.T @ g[a:b, b:]
            step = np.eye(width)
            step[a:b, a:b] = inv
            step[a:b, b:] = -inv @ r[a:b, b:]
            q = cut(times(q, step))
        total = r @ total
    return q, total


def pivoted_qr(a: np.ndarray, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """Column-pivoted QR of a small matrix: Q, R, the column order and the rank at which the largest column left falls to
    ``tolerance`` times the first. Ties go to the lower column."""
    a = np.array(a, float)
    m, n = a.shape
    q, order, rank, first = np.eye(m), list(range(n)), 0, None
    for k in range(min(m, n)):
        norms = np.sqrt((a[k:, k:] ** 2).sum(0))
        p = k + int(np.argmax(norms))
        first = norms[p - k] if first is None else first
        if norms[p - k] <= tolerance * first or norms[p - k] == 0:
            break
        a[:, [k, p]], order[k], order[p] = a[:, [p, k]], order[p], order[k]
        v, beta = householder(a[k:, k])
        a[k:] -= beta * np.outer(v, v @ a[k:])
        q[:, k:] -= beta * np.outer(q[:, k:] @ v, v)
        rank += 1
    return q, np.triu(a), order, rank


def tall_pivoted(rows: DataFrame, tolerance: float = 1e-12) -> tuple[np.ndarray, list[int], int]:
    """R, column order and rank of a tall matrix: pivoting on its R chooses the same columns, norms being equal."""
    _, r, order, rank = pivoted_qr(tsqr_r(rows), tolerance)
    return r, order, rank


def eigh_gram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors of A'A."""
    w, v = np.linalg.eigh(small(gram_rows(rows, "v")))
    return w[::-1], v[:, ::-1]


# ---- dense kernels on the driver (numpy), for matrices that fit there ----


def householder(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v') x = alpha e1, alpha of the sign opposite to x[0]."""
    v = np.array(x, float)
    norm = np.linalg.norm(v)
    if norm == 0:
        return v, 0.0
    v[0] += norm if v[0] >= 0 else -norm
    return v, 2.0 / (v @ v)


def householder_qr(a: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Reflectors (v, beta) and R."""
    a, out = np.array(a, float), []
    for k in range(min(a.shape)):
        v, beta = householder(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        out.append((v, beta))
    return out, np.triu(a)


def apply_q(reflectors: list[tuple[np.ndarray, float]], x: np.ndarray, transpose: bool = False) -> np.ndarray:
    """Q x, or Q' x, from the reflectors: forward order for Q', backward for Q."""
    x = np.array(x, float)
    steps = list(enumerate(reflectors))
    for k, (v, beta) in steps if transpose else reversed(steps):
        x[k:] -= beta * np.outer(v, v @ x[k:]) if x.ndim == 2 else beta * v * (v @ x[k:])
    return x


def wy(reflectors: list[tuple[np.ndarray, float]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """W and Y with Q = I - W Y'."""
    y = np.zeros((n, len(reflectors)))
    w = np.zeros_like(y)
    for k, (v, beta) in enumerate(reflectors):
        y[k:, k] = v
        w[:, k] = beta * (y[:, k] - w[:, :k] @ (y[:, :k].T @ y[:, k]))
    return w, y


def blocked_qr(a: np.ndarray, panel: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Q and R with panels applied as one matrix product each."""
    a = np.array(a, float)
    m, n = a.shape
    q = np.eye(m)
    for k in range(0, min(m, n), panel):
        e = min(k + panel, n)
        reflectors, r = householder_qr(a[k:, k:e])
        w, y = wy(reflectors, m - k)
        a[k:, k:e] = r
        a[k:, e:] -= y @ (w.T @ a[k:, e:])
        q[:, k:] -= (q[:, k:] @ w) @ y.T
    return q, np.triu(a)


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with P A = L U, rows pivoted."""
    u = np.array(a, float)
    n = len(u)
    low, order = np.eye(n), np.arange(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if u[p, k] == 0:
            continue
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return np.eye(n)[order], low, np.triu(u)


def lu_inverse(a: np.ndarray) -> np.ndarray:
    p, low, up = lu(a)
    return np.linalg.solve(up, np.linalg.solve(low, p))


def cholesky_inverse(a: np.ndarray) -> np.ndarray:
    inv = np.linalg.inv(np.linalg.cholesky(a))
    return inv.T @ inv


def gauss_jordan_inverse(a: np.ndarray, block: int = 16) -> np.ndarray:
    """Blockwise: each diagonal block is inverted and swept out of all other rows."""
    a = np.array(a, float)
    n = len(a)
    for k in range(0, n, block):
        s = slice(k, min(k + block, n))
        rest = np.r_[0 : s.start, s.stop : n]
        inv = np.linalg.inv(a[s, s])
        row, col = inv @ a[s][:, rest], a[rest][:, s]
        a[np.ix_(rest, rest)] -= col @ row
        a[rest, s] = -col @ inv
        a[s, rest] = row
        a[s, s] = inv
    return a


def generalized_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of A x = lambda B x, B positive definite, by B's Cholesky factor."""
    inv = np.linalg.inv(np.linalg.cholesky(b))
    w, v = np.linalg.eigh(inv @ a @ inv.T)
    return w, inv.T @ v


def tridiagonalize(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and T with A = Q T Q', T tridiagonal, for symmetric A."""
    t = np.array(a, float)
    n = len(t)
    q = np.eye(n)
    for k in range(n - 2):
        v, beta = householder(t[k + 1 :, k])
        t[k + 1 :] -= beta * np.outer(v, v @ t[k + 1 :])
        t[:, k + 1 :] -= beta * np.outer(t[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= beta * np.outer(q[:, k + 1 :] @ v, v)
    return q, np.triu(np.tril(t, 1), -1)


def to_band(a: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First stage: Q and B with A = Q B Q', B of ``width`` off-diagonals, panel by panel."""
    b = np.array(a, float)
    n = len(b)
    q = np.eye(n)
    for k in range(0, n - width - 1, width):
        s = k + width
        reflectors, _ = householder_qr(b[s:, k:s])
        w, y = wy(reflectors, n - s)
        b[s:] -= y @ (w.T @ b[s:])
        b[:, s:] -= (b[:, s:] @ w) @ y.T
        q[:, s:] -= (q[:, s:] @ w) @ y.T
    return q, np.triu(np.tril(b, width), -width)


def band_to_tridiagonal(a: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Second stage: each column's entries below the first off-diagonal are reflected away and the bulge is chased down
    the band, a window of ``width`` rows at a time."""
    t = np.array(a, float)
    n = len(t)
    q = np.eye(n)
    for k in range(n - 2):
        col, top = k, k + 1
        while top < n - 1:
            rows = slice(top, min(top + width, n))
            if rows.stop - rows.start < 2:
                break
            v, beta = householder(t[rows, col])
            t[rows] -= beta * np.outer(v, v @ t[rows])
            t[:, rows] -= beta * np.outer(t[:, rows] @ v, v)
            q[:, rows] -= beta * np.outer(q[:, rows] @ v, v)
            col, top = top, top + width
    return q, np.triu(np.tril(t, 1), -1)


def two_stage(a: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    q1, b = to_band(a, width)
    q2, t = band_to_tridiagonal(b, width)
    return q1 @ q2, t


def apply_two_stage(to_band_q: np.ndarray, to_tridiagonal_q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q x for the Q of both stages, one after the other: eigenvectors of T become those of the matrix without Q itself."""
    return to_band_q @ (to_tridiagonal_q @ x)


def tridiagonal_eigh(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divide and conquer: two halves and a rank-one coupling, whose secular equation is solved by bisection in each
    interval; equal or uncoupled entries are deflated first."""
    n = len(d)
    if n == 1:
        return np.array(d, float), np.eye(1)
    h = n // 2
    rho = float(e[h - 1])
    d1, d2 = np.array(d[:h], float), np.array(d[h:], float)
    if rho == 0:
        parts = [tridiagonal_eigh(d1, e[: h - 1]), tridiagonal_eigh(d2, e[h:])]
    else:
        d1[-1] -= abs(rho)
        d2[0] -= abs(rho)
        parts = [tridiagonal_eigh(d1, e[: h - 1]), tridiagonal_eigh(d2, e[h:])]
    w = np.concatenate([parts[0][0], parts[1][0]])
    q = np.zeros((n, n))
    q[:h, :h], q[h:, h:] = parts[0][1], parts[1][1]
    order = np.argsort(w, kind="stable")
    w, q = w[order], q[:, order]
    if rho == 0:
        return w, q
    z = np.sign(rho) * q[h] + q[h - 1]
    return _rank_one(w, z, abs(rho), q)


def _rank_one(w: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(w) + rho z z' (w ascending, rho > 0) in the basis q."""
    w, z, q = w.copy(), z.copy(), q.copy()
    scale = max(1.0, np.abs(w).max(), rho * (z @ z))
    for k in range(len(w) - 1):  # a rotation moves the weight of near-equal entries to the later one
        if w[k + 1] - w[k] <= 1e-14 * scale:
            r = np.hypot(z[k], z[k + 1])
            if r > 0:
                c, s = z[k + 1] / r, z[k] / r
                q[:, [k, k + 1]] = q[:, [k, k + 1]] @ np.array([[c, s], [-s, c]])
                z[k], z[k + 1] = 0.0, r
    live = np.flatnonzero(np.abs(z) > 1e-15 * np.sqrt(scale))
    out_w, out_q = w.copy(), q.copy()
    if len(live):
        d, y = w[live], z[live]
        m = len(d)
        ends = np.append(d[1:], d[-1] + rho * (y @ y) * (1 + 1e-12) + 1e-300)

        def differences(origin: np.ndarray, shift: np.ndarray) -> np.ndarray:
            """Root k less pole j, exact for small offsets from the origin's pole."""
            gap = (d[origin][:, None] - d[None, :]) + shift[:, None]
            return np.where(gap == 0, 1e-300, gap)

        def secular(origin: np.ndarray, shift: np.ndarray) -> np.ndarray:
            return 1.0 - rho * (y[None, :] ** 2 / differences(origin, shift)).sum(1)

        # each root is an offset from its nearer pole: the right one where the middle lies left of the root
        left = np.arange(m)
        origin = np.where((secular(left, (ends - d) / 2) < 0) & (left < m - 1), left + 1, left)
        base = d[origin]
        lo, hi = d - base, ends - base
        for _ in range(1100):  # to the last bit, also of tiny offsets
            shift = 0.5 * (lo + hi)
            if ((shift == lo) | (shift == hi)).all():
                break
            f = secular(origin, shift)
            lo, hi = np.where(f < 0, shift, lo), np.where(f < 0, hi, shift)
        gap = differences(origin, shift)
        # weights for which the computed roots are exact, so that vectors stay orthogonal
        ratio = np.ones(m)
        for k in range(m):
            other = np.r_[0:k, k + 1 : m]
            ratio[k] = gap[k, k] * np.prod(gap[other, k] / (d[other] - d[k])) / rho
        fixed = np.sign(y) * np.sqrt(np.abs(ratio))
        vec = fixed[None, :] / gap
        vec /= np.linalg.norm(vec, axis=1)[:, None]
        out_w[live] = base + shift
        out_q[:, live] = q[:, live] @ vec.T
    order = np.argsort(out_w, kind="stable")
    return out_w[order], out_q[:, order]
