"""A message channel: producers put numbered messages into a ring of slots, a consumer drains them in order.

The ring's slot is the index modulo its size and its flag turns with every round, so a slot is known to be filled for
the round. In Structured Streaming the source is any stream of (issue_idx, value); back-pressure is the rate of
the source (files or rows a trigger); the running sum is an aggregation whose state Spark keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "issue_idx long, value double"


def slot(issue_idx: Column, log2_size: int) -> Column:
    return issue_idx.bitwiseAND(F.lit((1 << log2_size) - 1))


def flag(issue_idx: Column, log2_size: int) -> Column:
    """1 in even rounds, 0 in odd ones."""
    return F.lit(1) - F.shiftright(issue_idx, log2_size).bitwiseAND(F.lit(1))


def produce(messages: DataFrame, log2_size: int) -> DataFrame:
    """Messages (issue_idx, value) with their slot, round and flag."""
    i = F.col("issue_idx")
    return messages.withColumn("slot", slot(i, log2_size)).withColumn("round", F.shiftright(i, log2_size)).withColumn("flag", flag(i, log2_size))


def file_source(spark: SparkSession, path: str, max_files: int = 1, schema: str = MESSAGE) -> DataFrame:
    """A stream over the Parquet files of a folder, at most ``max_files`` a trigger: the consumer's pace holds the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def rate_source(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("issue_idx"), F.col("value").cast("double").alias("value"))


def totals(stream: DataFrame) -> DataFrame:
    """Messages and their sum so far; works on a stream (complete mode) and on a table."""
    return stream.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("issue_idx").alias("last_idx"))


def ring_totals(stream: DataFrame, log2_size: int) -> DataFrame:
    return produce(stream, log2_size).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("round").alias("last_round"))


def drain(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> bool:
    """Runs ``consume`` on each micro-batch, sorted by issue_idx, until what is there now has been read; the processed
    index is known after the batch. True if it ended within ``timeout`` seconds."""
    query = stream.writeStream.foreachBatch(lambda batch, k: consume(batch.orderBy("issue_idx"), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ended = query.awaitTermination(timeout) if timeout is not None else (query.awaitTermination() or True)
    if not ended:
        query.stop()
    return bool(ended)


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """The stream's aggregate as a table in memory after all that is there now."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def in_order(messages: DataFrame) -> DataFrame:
    """Messages (channel, number, value) released in the order of their numbers, from 0 in each channel, with ``total``, the sum so far.

    A stateful consumer: a channel's state is the next number, its sum, and the messages that came before their turn; what has come before is
    released in runs, and what comes again is dropped. The state is as large as arrivals are out of order: a producer that
    keeps to its credits (next + ring size) never has more than a ring of messages out.
    """
    import numpy as np
    import pandas as pd

    def release(key, frames, state):
        after, total, numbers, values = state.get if state.exists else (0, 0.0, [], [])
        number, value = np.array(numbers, np.int64), np.array(values, np.float64)
        for frame in frames:
            number = np.concatenate([number, frame["number"].to_numpy()])
            value = np.concatenate([value, frame["value"].to_numpy()])
            number, first = np.unique(number, return_index=True)  # ascending, each once
            value = value[first]
            number, value = number[number >= after], value[number >= after]
            run = int((number == after + np.arange(len(number))).sum())
            if run:
                sums = np.cumsum(np.concatenate([[total], value[:run]]))[1:]
                yield pd.DataFrame({"channel": key[0], "number": number[:run], "value": value[:run], "total": sums})
                after, total, number, value = after + run, float(sums[-1]), number[run:], value[run:]
        state.update((int(after), float(total), number.tolist(), value.tolist()))

    return messages.groupBy("channel").applyInPandasWithState(
        release, "channel long, number long, value double, total double", "after long, total double, numbers array<long>, values array<double>", "append", "NoTimeout"
    )
