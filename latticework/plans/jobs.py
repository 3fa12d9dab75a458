"""The runnable jobs over the driver's tables: each runs twice into one new folder, and its whole output is what comes back."""

from __future__ import annotations

import uuid

from jobs import drain_channel, term_matrix
from latticework.plans.linear import rounded
from latticework.plans.registry import query
from latticework.tables import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(term_matrix.ORACLE)
def job1_term_matrix(spark, sf_dir):
    out = _folder(spark, "term-matrix")
    term_matrix.run(spark, f"{sf_dir}/documents.parquet", out)
    return term_matrix.run(spark, f"{sf_dir}/documents.parquet", out)


@query(drain_channel.ORACLE)
def job2_drain_channel(spark, sf_dir):
    out = _folder(spark, "drain-channel")
    drain_channel.run(spark, f"{sf_dir}/events.parquet", f"{out}/out", f"{out}/checkpoint")
    return rounded(drain_channel.run(spark, f"{sf_dir}/events.parquet", f"{out}/out", f"{out}/checkpoint"), "total")
