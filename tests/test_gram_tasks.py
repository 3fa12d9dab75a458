"""Gram matrices: as many tasks as the entries ask for."""

import numpy as np

from latticework.operators import sparse


def test_gram_goes_in_tasks_of_bounded_entries(spark, monkeypatch):
    monkeypatch.setattr(sparse, "TASK_ENTRIES", 16)
    rng = np.random.default_rng(2)
    rows = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 40, 200), rng.integers(0, 6, 200), rng.normal(size=200))]
    a = np.zeros((40, 6))
    for i, j, v in rows:
        a[i, j] += v
    got = sparse.gram(spark.createDataFrame(rows, "i long, j long, v double"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count(", 13") >= 2  # both sides of the join
    back = np.zeros((6, 6))
    for r in got.collect():
        back[r["i"], r["j"]] = r["v"]
    assert np.allclose(back, a.T @ a)
