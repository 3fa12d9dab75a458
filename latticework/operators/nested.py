"""Kernel matrices as nested low-rank blocks on a k-d tree: products and a direct solve in nearly linear work and memory.

A node's rows of the matrix against everything outside it are interpolated from a few of its own points, its skeleton, found by a pivoted QR of
its kernel values at proxy points. A parent's skeleton is chosen from its children's, so bases are nested and only skeletons move up: a leaf's
points meet no other leaf's. The block between two siblings is the kernel between their skeletons. With W the interpolation and M
what acts inside a node (a leaf's own dense block, a parent's blocks between its children's skeletons), a product is

    up:    h = W' x, a parent's x being its children's h side by side
    down:  y = M x + W g, a parent's y being its children's g side by side

The inverse has the same form: with D a leaf's M (a parent's with its children's C on the diagonal), C = (W' D^-1 W)^-1, it has D^-1 W C
for W and D^-1 - D^-1 W C W' D^-1 for M, made level by level from the leaves. Each level is one row a node: (node, w, m) of a size
that leaf and rank bound. All steps are joins on node numbers and sums of two rows; nothing of the size of the data meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.coo import sample_rows
from latticework.operators.rows import by_row
from latticework.operators.trees import kd_tree
from latticework.tables import cut

PROXIES = 1024

_LEVEL = "node long, size int, rank int, w binary, m binary"
_BUILT = f"{_LEVEL}, ids array<long>, skeleton binary, error double"


def row_skeleton(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows J of ``a`` and W with a = W a[J] to the tolerance (relative to the longest row), by QR of the transpose with pivots."""
    work, rows = a.copy(), []
    q = np.zeros((0, a.shape[1]))
    r = np.zeros((0, len(a)))
    first = np.sqrt((a * a).sum(1).max(initial=0.0))
    while len(rows) < min(a.shape):
        norms = (work * work).sum(1)
        k = int(norms.argmax())
        if np.sqrt(norms[k]) <= tolerance * first:
            break
        line = work[k] - (work[k] @ q.T) @ q
        line /= np.sqrt(line @ line)
        along = work @ line
        work -= np.outer(along, line)
        rows.append(k)
        q, r = np.vstack([q, line]), np.vstack([r, a @ line])
    rows = np.array(rows, np.int64)
    return rows, (np.linalg.solve(r[:, rows], r).T if len(rows) else np.zeros((len(a), 0)))


def _floats(raw, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, columns) if columns else np.zeros((0, 0))


def _level_row(node: int, w: np.ndarray, m: np.ndarray) -> dict:
    return {"node": node, "size": len(m), "rank": w.shape[1], "w": w.tobytes(), "m": np.ascontiguousarray(m).tobytes()}


def _matrices(row: dict) -> tuple[np.ndarray, np.ndarray]:
    w = _floats(row["w"], row["rank"]) if row["rank"] else np.zeros((row["size"], 0))
    return w, _floats(row["m"], row["size"])


def _pairs(children: DataFrame, *columns: str) -> DataFrame:
    """Two children's columns side by side, left first: (node, both)."""
    side = F.struct((F.col("node") % 2).alias("side"), *columns)
    return children.groupBy(F.expr("node div 2").alias("node")).agg(F.array_sort(F.collect_list(side)).alias("both"))


@dataclass
class Nested:
    """Levels of (node, size, rank, w, m), the root first, and the leaves' members (node, ids). ``error``: the greatest that the audit of the
    bases saw, in parts of the greatest entry."""

    levels: list[DataFrame]
    members: DataFrame
    error: float = 0.0

    def apply(self, x: DataFrame) -> DataFrame:
        """The matrix times a vector (i, v): rows (i, v) for all points; missing entries are zero."""
        place = self.members.select("node", F.posexplode("ids").alias("at", "i"))
        given = place.join(x.select("i", "v"), "i").select("node", "at", "v")
        leaf = given.groupBy("node").agg(F.collect_list(F.struct("at", "v")).alias("entries"))
        bottom = self.levels[-1].join(self.members, "node").join(leaf, "node", "left").withColumn("both", F.lit(None).cast("array<struct<side:long,h:binary>>"))

        def vector(row) -> np.ndarray:
            if row.get("both") is not None:
                return np.concatenate([np.frombuffer(b["h"], np.float64) for b in row["both"]])
            out = np.zeros(row["size"])
            for e in row.get("entries") or ():
                out[e["at"]] += e["v"]
            return out

        def up(row):
            w, _ = _matrices(row)
            v = vector(row)
            return [{"node": row["node"], "x": v.tobytes(), "h": (w.T @ v).tobytes()}]

        below, vectors = bottom, []
        for k in range(len(self.levels) - 1, -1, -1):
            vectors.insert(0, cut(by_row(below, up, "node long, x binary, h binary")))
            if k:
                below = self.levels[k - 1].join(_pairs(vectors[0], "h"), "node")

        def down(row):
            w, m = _matrices(row)
            y = m @ np.frombuffer(row["x"], np.float64)
            if row["g"] is not None:
                y = y + w @ np.frombuffer(row["g"], np.float64)
            if row["ids"] is not None:
                return [{"node": i, "g": np.float64(v).tobytes()} for i, v in zip(row["ids"], y)]
            left = row["left"]
            return [{"node": 2 * row["node"], "g": y[:left].tobytes()}, {"node": 2 * row["node"] + 1, "g": y[left:].tobytes()}]

        above = None
        for k, level in enumerate(self.levels):
            met = level.join(vectors[k].select("node", "x"), "node")
            met = met.join(above, "node") if above is not None else met.withColumn("g", F.lit(None).cast("binary"))
            if k + 1 < len(self.levels):
                ranks = self.levels[k + 1].where("node % 2 = 0").select(F.expr("node div 2").alias("node"), F.col("rank").alias("left"))
                met = met.join(ranks, "node").withColumn("ids", F.lit(None).cast("array<long>"))
            else:
                met = met.join(self.members, "node").withColumn("left", F.lit(0))
            above = by_row(met, down, "node long, g binary") if k + 1 < len(self.levels) else by_row(met, lambda row: [{"i": r["node"], "v": float(np.frombuffer(r["g"])[0])} for r in down(row)], "i long, v double")
        return above

    def inverse(self) -> Nested:
        """The inverse, for a symmetric positive definite matrix."""

        def step(row):
            w, m = _matrices(row)
            d = m.copy()
            at = 0
            for b in row["both"] or ():
                c = np.frombuffer(b["c"], np.float64)
                k = int(round(len(c) ** 0.5))
                d[at : at + k, at : at + k] += c.reshape(k, k)
                at += k
            inv = np.linalg.inv(d)
            inv = (inv + inv.T) / 2
            if not w.shape[1]:
                return [_level_row(row["node"], w, inv) | {"c": b""}]
            dw = inv @ w
            c = np.linalg.inv(w.T @ dw)
            c = (c + c.T) / 2
            return [_level_row(row["node"], dw @ c, inv - dw @ c @ dw.T) | {"c": c.tobytes()}]

        out, below = [], None
        for level in reversed(self.levels):
            met = level.join(below, "node") if below is not None else level.withColumn("both", F.lit(None).cast("array<struct<side:long,c:binary>>"))
            made = cut(by_row(met, step, f"{_LEVEL}, c binary"))
            out.insert(0, made.drop("c"))
            below = _pairs(made, "c")
        return Nested(out, self.members, self.error)

    def storage(self) -> DataFrame:
        """Per level: nodes, those whose basis is smaller than they are (``compressed``), the largest rank, and stored numbers."""
        rows = None
        for k, level in enumerate(self.levels):
            of = level.agg(
                F.lit(k).alias("level"),
                F.count(F.lit(1)).alias("nodes"),
                F.count_if((F.col("rank") < F.col("size")) & F.lit(k > 0)).alias("compressed"),
                F.max("rank").alias("rank"),
                F.sum(F.col("size").cast("long") * (F.col("size") + F.col("rank"))).alias("stored"),
            )
            rows = of if rows is None else rows.unionByName(of)
        return rows


def nested_kernel(points: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], mu: float = 0.0, leaf_rows: int = 256, tolerance: float = 1e-8, proxies: int = PROXIES, audits: int = 256) -> Nested:
    """The kernel matrix of points (id, p), with 1 + mu on the diagonal, as nested blocks. ``kernel`` takes and gives numpy arrays of squared
    distances. Every point is in the tree and in its leaf's dense block.

    Bases are fitted to ``proxies`` points of the whole set, the first in hash order, which is a bound on what travels to each task, and audited on
    the ``audits`` next ones: where an entry is missed by more than a thousand tolerances, they are fitted again to twice as many proxies, up
    to the whole set. Kernels that are smooth between neighbours need few."""
    given = points.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"))
    tree, depth = kd_tree(given, leaf_rows)
    tree = cut(tree)
    while True:
        sample = sample_rows(tree, "id", proxies + audits).collect()
        made = _nested(tree, depth, kernel, mu, tolerance, sample[:proxies], sample[proxies:])
        if made.error <= 1e3 * tolerance or len(sample) <= proxies:
            return made
        proxies = 2 * proxies if len(sample) == proxies + audits else len(sample)


def _nested(tree: DataFrame, depth: int, kernel, mu: float, tolerance: float, proxies: list, audits: list) -> Nested:
    def arrays(rows) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["p"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["p"]) if rows else 0), np.array([r["leaf"] for r in rows], np.int64)

    (far_p, far_leaf), (audit_p, audit_leaf) = arrays(proxies), arrays(audits)
    dims = far_p.shape[1] if len(far_p) else 0

    def entry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return kernel(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))

    def basis(node: int, level: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        if not level:
            return np.zeros((len(p), 0)), p[:0], 0.0
        rows, w = row_skeleton(entry(p, far_p[far_leaf >> (depth - level) != node]), tolerance)
        seen = audit_leaf >> (depth - level) != node
        if not seen.any():
            return w, p[rows], 0.0
        a = entry(p, audit_p[seen])
        return w, p[rows], float(np.abs(a - w @ a[rows]).max() / (np.abs(a).max() or 1.0))

    def leaf(row):
        p = np.array([m["p"] for m in row["members"]])
        d = entry(p, p)
        np.fill_diagonal(d, 1.0 + mu)
        w, skeleton, error = basis(row["node"], depth, p)
        return [_level_row(row["node"], w, d) | {"ids": [m["id"] for m in row["members"]], "skeleton": skeleton.tobytes(), "error": error}]

    grouped = tree.groupBy(F.col("leaf").alias("node")).agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("members"))
    built = cut(by_row(grouped, leaf, _BUILT))
    members, tables = built.select("node", "ids"), [built]
    for level in range(depth - 1, -1, -1):

        def parent(row, level=level):
            a, b = (_floats(x["skeleton"], dims) for x in row["both"])
            p, m = np.concatenate([a, b]), np.zeros((len(a) + len(b),) * 2)
            m[: len(a), len(a) :] = entry(a, b)
            m[len(a) :, : len(a)] = m[: len(a), len(a) :].T
            w, skeleton, error = basis(row["node"], level, p)
            return [_level_row(row["node"], w, m) | {"ids": None, "skeleton": skeleton.tobytes(), "error": error}]

        built = cut(by_row(_pairs(built, "skeleton"), parent, _BUILT))
        tables.insert(0, built)
    errors = [t.agg(F.max("error")).first()[0] or 0.0 for t in tables]
    return Nested([t.drop("ids", "skeleton", "error") for t in tables], members, max(errors))
