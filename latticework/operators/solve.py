"""Iterative solvers: the loop runs on the driver, every vector step is a DataFrame plan over one written state table.

``apply`` maps a vector (i, v) to A times it. Scalars come from single-row aggregates. Each iteration writes its state
to the shared folder, so plans stay of one size and a lost executor costs a read; the states before it are dropped then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.blas import mean_projection
from latticework.operators.sparse import spmv
from latticework.tables import Steps

Apply = Callable[[DataFrame], DataFrame]


@dataclass
class Solution:
    x: DataFrame
    residuals: list[float] = field(default_factory=list)  # 2-norms, the first before any step
    converged: bool = False

    @property
    def iterations(self) -> int:
        return len(self.residuals) - 1


def operator(a: DataFrame, rows: DataFrame | None = None) -> Apply:
    """A matrix as an operator; its rows without entries give zero."""
    domain = rows if rows is not None else a.select("i").distinct()
    return lambda x: spmv(a, x, domain)


def _with(state: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    return state.join(vector.select("i", F.col("v").alias(name)), "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _sums(state: DataFrame, **products: Column) -> dict[str, float]:
    row = state.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in products.items()]).first()
    return {k: float(row[k]) for k in products}


def _vector(state: DataFrame, name: str) -> DataFrame:
    return state.select("i", F.col(name).alias("v"))


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def conjugate_gradient(apply: Apply, b: DataFrame, tolerance: float = 1e-10, max_iterations: int = 100, x0: DataFrame | None = None, precondition: Apply | None = None) -> Solution:
    """CG, preconditioned if ``precondition`` (a symmetric positive operator) is given. Stops at ||r|| <= tolerance ||b||."""
    c, steps = F.col, Steps()
    state = b.select("i", c("v").alias("r")).withColumn("x", F.lit(0.0))
    if x0 is not None:
        state = _with(_with(b.select("i", c("v").alias("b")), x0, "x"), apply(x0), "ax").select("i", (c("b") - c("ax")).alias("r"), "x")
    state = steps.cut(state)
    z = (lambda s: _with(s, precondition(_vector(s, "r")), "z")) if precondition else (lambda s: s.withColumn("z", c("r")))
    state = steps.cut(z(state).withColumn("p", c("z")))
    norm_b = sqrt(_sums(b, s=c("v") * c("v"))["s"])
    now = _sums(state, rr=c("r") * c("r"), rz=c("r") * c("z"))
    out = Solution(_vector(state, "x"), [sqrt(now["rr"])])
    for _ in range(max_iterations):
        if out.residuals[-1] <= tolerance * norm_b:
            break
        mark = steps.mark()
        moved = steps.cut(_with(state, apply(_vector(state, "p")), "ap"))
        alpha = _ratio(now["rz"], _sums(moved, pap=c("p") * c("ap"))["pap"])
        stepped = moved.select("i", (c("x") + c("p") * alpha).alias("x"), (c("r") - c("ap") * alpha).alias("r"), "p")
        stepped = steps.cut(z(stepped) if precondition is None else z(steps.cut(stepped)))
        new = _sums(stepped, rr=c("r") * c("r"), rz=c("r") * c("z"))
        beta, now = _ratio(new["rz"], now["rz"]), new
        state = stepped.withColumn("p", c("z") + c("p") * beta)
        out.x = _vector(stepped, "x")
        out.residuals.append(sqrt(now["rr"]))
        steps.forget(mark)
    out.converged = out.residuals[-1] <= tolerance * norm_b
    return out


def bicgstab(apply: Apply, b: DataFrame, tolerance: float = 1e-10, max_iterations: int = 100) -> Solution:
    c, steps = F.col, Steps()
    state = steps.cut(b.select("i", c("v").alias("r"), c("v").alias("r0"), c("v").alias("p"), F.lit(0.0).alias("x")))
    state = steps.cut(_with(state, apply(_vector(state, "p")), "ap"))
    norm_b = sqrt(_sums(b, s=c("v") * c("v"))["s"])
    out = Solution(_vector(state, "x"), [norm_b])
    for _ in range(max_iterations):
        if out.residuals[-1] <= tolerance * norm_b:
            break
        mark = steps.mark()
        s1 = _sums(state, rho=c("r") * c("r0"), d=c("ap") * c("r0"))
        alpha = _ratio(s1["rho"], s1["d"])
        half = steps.cut(state.withColumn("s", c("r") - c("ap") * alpha))
        half = steps.cut(_with(half, apply(_vector(half, "s")), "as"))
        s2 = _sums(half, a=c("as") * c("s"), d=c("as") * c("as"))
        omega = _ratio(s2["a"], s2["d"])
        half = half.withColumn("x", c("x") + c("p") * alpha + c("s") * omega).withColumn("r", c("s") - c("as") * omega)
        s3 = _sums(half, rho=c("r") * c("r0"), rr=c("r") * c("r"))
        beta = _ratio(s3["rho"], s1["rho"]) * _ratio(alpha, omega)
        state = steps.cut(half.select("i", "x", "r", "r0", (c("r") + (c("p") - c("ap") * omega) * beta).alias("p")))
        state = steps.cut(_with(state, apply(_vector(state, "p")), "ap"))
        out.x = _vector(state, "x")
        out.residuals.append(sqrt(s3["rr"]))
        steps.forget(mark)
    out.converged = out.residuals[-1] <= tolerance * norm_b
    return out


def anderson_richardson(apply: Apply, b: DataFrame, diagonal: float, tolerance: float = 1e-8, max_iterations: int = 60, history: int = 7, period: int = 6, omega: float = 0.6, beta: float = 0.6) -> Solution:
    """Alternating Anderson-Richardson: every ``period``-th step extrapolates over the last ``history`` differences, the
    others are damped Richardson steps; ``diagonal`` is the operator's. The residual norm, and so the stop test, is
    fresh after each extrapolation only."""
    import numpy as np

    c, steps = F.col, Steps()
    dx, df = [f"dx{k}" for k in range(history)], [f"df{k}" for k in range(history)]
    zero = [F.lit(0.0).alias(n) for n in (*dx, *df, "x", "x0", "f0")]
    state = steps.cut(b.select("i", c("v").alias("b"), c("v").alias("r"), *zero))
    norm_b = sqrt(_sums(b, s=c("v") * c("v"))["s"])
    out, known = Solution(_vector(state, "x"), [norm_b]), norm_b
    for k in range(1, max_iterations + 1):
        mark = steps.mark()
        state = state.withColumn("f", c("r") * (1.0 / diagonal))
        if k > 1:
            at = (k - 2) % history
            state = state.withColumn(dx[at], c("x") - c("x0")).withColumn(df[at], c("f") - c("f0"))
        state = steps.cut(state.withColumn("x0", c("x")).withColumn("f0", c("f")))
        extrapolate = k % period == 0
        if extrapolate:
            names = [(p, q) for p in range(history) for q in range(history)]
            sums = _sums(state, **{f"s{p}_{q}": c(df[p]) * c(df[q]) for p, q in names}, **{f"t{p}": c(df[p]) * c("f") for p in range(history)})
            gram = np.array([[sums[f"s{p}_{q}"] for q in range(history)] for p in range(history)])
            w = np.linalg.lstsq(gram, np.array([sums[f"t{p}"] for p in range(history)]), rcond=None)[0]
            step = c("x0") + c("f") * beta
            for p in range(history):
                step = step - (c(dx[p]) + c(df[p]) * beta) * float(w[p])
        else:
            step = c("x0") + c("f") * omega
        state = steps.cut(state.withColumn("x", step))
        state = steps.cut(_with(state, apply(_vector(state, "x")), "ax").withColumn("r", c("b") - c("ax")).drop("ax", "f"))
        if extrapolate:
            known = sqrt(_sums(state, rr=c("r") * c("r"))["rr"])
        out.x = _vector(state, "x")
        out.residuals.append(known)
        steps.forget(mark)
        if known < tolerance * norm_b:
            out.converged = True
            break
    return out


def gmres(apply: Apply, b: DataFrame, restart: int = 10, tolerance: float = 1e-8, max_iterations: int = 100, precondition: Apply | None = None) -> Solution:
    """Restarted GMRES, preconditioned from the right. The basis is columns of one table; all inner products of a step
    are one aggregate (classical Gram-Schmidt, done twice). The tolerance is relative to ||b|| throughout."""
    import numpy as np

    c, steps = F.col, Steps()
    m = precondition or (lambda v: v)
    state = steps.cut(b.select("i", c("v").alias("b"), F.lit(0.0).alias("x"), c("v").alias("r")))
    norm_b = sqrt(_sums(b, s=c("v") * c("v"))["s"])
    out = Solution(_vector(state, "x"), [norm_b])
    while out.residuals[-1] > tolerance * norm_b and out.iterations < max_iterations:
        beta, start = out.residuals[-1], steps.mark()
        basis = steps.cut(state.withColumn("q0", c("r") * (1.0 / beta)))
        h = np.zeros((restart + 1, restart))
        g = np.zeros(restart + 1)
        g[0] = beta
        for k in range(restart):
            mark = steps.mark()
            w = steps.cut(_with(basis, apply(m(_vector(basis, f"q{k}"))), "w"))
            for _ in range(2):
                s = _sums(w, **{f"h{p}": c("w") * c(f"q{p}") for p in range(k + 1)})
                less = c("w")
                for p in range(k + 1):
                    less = less - c(f"q{p}") * s[f"h{p}"]
                    h[p, k] += s[f"h{p}"]
                w = steps.cut(w.withColumn("w", less))
            h[k + 1, k] = sqrt(_sums(w, n=c("w") * c("w"))["n"])
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], g[: k + 2], rcond=None)
            out.residuals.append(float(np.linalg.norm(h[: k + 2, : k + 1] @ y - g[: k + 2])))
            last = out.residuals[-1] <= tolerance * norm_b or out.iterations >= max_iterations or h[k + 1, k] < 1e-14 * beta
            basis = w.withColumn(f"q{k + 1}", c("w") * _ratio(1.0, h[k + 1, k])).drop("w")
            steps.forget(mark, start)
            if last:
                break
        step = sum((c(f"q{p}") * float(y[p]) for p in range(1, len(y))), c("q0") * float(y[0]))
        basis = steps.cut(basis)
        state = steps.cut(_with(basis.select("i", "b", "x", step.alias("d")), m(basis.select("i", step.alias("v"))), "e").select("i", "b", (c("x") + c("e")).alias("x")))
        state = steps.cut(_with(state, apply(_vector(state, "x")), "ax").select("i", "b", "x", (c("b") - c("ax")).alias("r")))
        out.x = _vector(state, "x")
        out.residuals[-1] = sqrt(_sums(state, rr=c("r") * c("r"))["rr"])
        steps.forget(steps.mark() - 1)
    out.converged = out.residuals[-1] <= tolerance * norm_b
    return out


def power_iteration(apply: Apply, x0: DataFrame, iterations: int) -> tuple[DataFrame, float]:
    """x <- A x / ||A x||: the vector after the last step (of unit length) and the last norm."""
    x, norm, steps = x0, 0.0, Steps()
    for _ in range(iterations):
        mark = steps.mark()
        y = steps.cut(apply(x))
        norm = sqrt(_sums(y, s=F.col("v") * F.col("v"))["s"])
        x = y.select("i", (F.col("v") * _ratio(1.0, norm)).alias("v"))
        steps.forget(mark)
    return x, norm


#: unknowns up to which the coarsest system is solved by a dense pseudo-inverse on the driver
COARSEST = 4096


class Multigrid:
    """Geometric multigrid for the grid Laplacian: trilinear transfer, R A P on each coarser grid, damped diagonal
    smoothing. The coarsest grid has a pseudo-inverse (which a periodic problem needs) if it has no more than ``COARSEST`` unknowns; grids
    are coarsened beyond ``levels`` to come down to that, and a coarsest grid that can't be is solved by conjugate gradients."""

    def __init__(self, spark, sizes, bcs, cell, radius: int = 2, levels: int = 2, damping: float = 0.75):
        import numpy as np

        from latticework.operators import coo, grid
        from latticework.operators.sparse import matmul

        self.spark, self.a, self.r, self.p, self.m, keep = spark, [], [], [], [], Steps()
        a, s = keep.cut(grid.laplacian_coo(spark, sizes, bcs, cell, radius)), tuple(sizes)
        while True:
            self.a.append(a)
            n = s[0] * s[1] * s[2]
            if len(self.m) >= levels and (n <= COARSEST or any(k % 2 or k < 4 for k in s)):
                break
            self.m.append(keep.cut(coo.diagonal(a).select("i", F.when(F.col("v") != 0, damping / F.col("v")).otherwise(0.0).alias("v"))))
            r = keep.cut(grid.restriction(spark, s, bcs))
            p = r.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * 8.0).alias("v"))
            self.r.append(r)
            self.p.append(p)
            a = keep.cut(matmul(matmul(r, a), p))
            s = tuple(k // 2 for k in s)
        self.coarse = None
        if n <= COARSEST:
            last = np.zeros((n, n))
            for row in a.collect():
                last[row["i"], row["j"]] += row["v"]
            self.coarse = np.linalg.pinv(last)

    def _coarse_solve(self, r: DataFrame) -> DataFrame:
        import numpy as np

        if self.coarse is None:  # minus the Laplacian is positive, but for constants, which a consistent right-hand side has none of
            minus = self.a[-1].withColumn("v", -F.col("v"))
            return conjugate_gradient(operator(minus), r.withColumn("v", -F.col("v")), 1e-3, 200).x
        v = np.zeros(len(self.coarse))
        for row in r.collect():
            v[row["i"]] = row["v"]
        e = self.coarse @ v
        return self.spark.createDataFrame([(k, float(x)) for k, x in enumerate(e)], "i long, v double")

    def cycle(self, r: DataFrame, steps: Steps | None = None) -> DataFrame:
        """One V-cycle: an approximate solution of A e = r."""
        from latticework.operators.blas import diagonal_scale, vector_add

        cut = (steps or Steps()).cut
        e, rs = [], [r]
        for k in range(len(self.m)):
            e.append(cut(diagonal_scale(self.m[k], rs[k])))
            t = vector_add(rs[k], spmv(self.a[k], e[k]), 1.0, -1.0)
            rs.append(cut(spmv(self.r[k], t)))
        up = self._coarse_solve(rs[-1])
        for k in range(len(self.m) - 1, -1, -1):
            ek = cut(vector_add(e[k], spmv(self.p[k], up)))
            t = vector_add(rs[k], spmv(self.a[k], ek), 1.0, -1.0)
            up = cut(vector_add(ek, diagonal_scale(self.m[k], t)))
        return up

    def solve(self, b: DataFrame, tolerance: float = 1e-8, max_cycles: int = 300, project: bool = False) -> Solution:
        from latticework.operators.blas import vector_add

        steps = Steps()
        b = Steps().cut(mean_projection(b) if project else b)
        c = F.col
        norm_b = sqrt(_sums(b, s=c("v") * c("v"))["s"])
        x, r = b.select("i", F.lit(0.0).alias("v")), b
        out = Solution(x, [norm_b])
        for _ in range(max_cycles):
            if out.residuals[-1] <= tolerance * norm_b:
                break
            x = steps.cut(vector_add(x, self.cycle(r, steps)))
            r = steps.cut(vector_add(b, spmv(self.a[0], x), 1.0, -1.0))
            steps.forget(steps.mark() - 2)
            out.x = x
            out.residuals.append(sqrt(_sums(r, s=c("v") * c("v"))["s"]))
        out.converged = out.residuals[-1] <= tolerance * norm_b
        return out
