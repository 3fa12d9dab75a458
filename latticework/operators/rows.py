"""Rows that are blocks: a step of numpy on each, wherever Spark has it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def by_row(df: DataFrame, step: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """``step`` on each row, a node's, a few at a time."""
    fields = [c.split(" ") for c in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
    out = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                made = [x for row in batch.slice(at, 16).to_pylist() for x in step(row)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=out)

    return df.mapInArrow(run, schema)
