"""The message channel over the event table: as a table, and as a stream of its files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticework.plans.linear import rounded
from latticework.plans.registry import query
from latticework.streaming import channel
from latticework.tables import scratch, table


def messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("issue_idx"), F.col("value").cast("double").alias("value"))


@query("SELECT event_id AS issue_idx, (event_id & 255)::BIGINT AS slot, (event_id >> 8)::BIGINT AS round, (1 - ((event_id >> 8) & 1))::BIGINT AS flag FROM events")
def channel_slots(spark, sf_dir):
    return channel.produce(messages(spark, sf_dir), 8).select("issue_idx", F.col("slot").cast("long").alias("slot"), F.col("round").cast("long").alias("round"), F.col("flag").cast("long").alias("flag"))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_idx FROM events")
def channel_sum(spark, sf_dir):
    return rounded(channel.totals(messages(spark, sf_dir)), "total")


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_idx FROM events")
def channel_stream(spark, sf_dir):
    """The same totals by Structured Streaming over the messages written as files."""
    base = scratch(spark, "channel")
    messages(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = channel.totals(channel.file_source(spark, f"{base}/in", 2))
    return rounded(channel.run_to_table(stream, f"channel_{uuid.uuid4().hex}", f"{base}/state"), "total")


@query("SELECT (event_id & 15)::BIGINT AS slot, count(*) AS n, round(sum(value), 4) AS total, max(event_id >> 4)::BIGINT AS last_round FROM events GROUP BY 1")
def channel_ring(spark, sf_dir):
    return rounded(channel.ring_totals(messages(spark, sf_dir), 4), "total")


@query("SELECT (event_id // 1000)::BIGINT AS thousand, count(*) AS n, true AS in_order FROM events GROUP BY 1")
def channel_drain(spark, sf_dir):
    """Batches drained until none is left: what the consumer was given, by thousands, and whether each batch came in order."""
    base = scratch(spark, "channel")
    messages(spark, sf_dir).repartitionByRange(4, "issue_idx").write.parquet(f"{base}/in")

    def consume(batch, k):
        before = F.lag("issue_idx").over(W.partitionBy("part").orderBy("at"))
        seen = batch.select("issue_idx", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).withColumn("ok", F.coalesce(before < F.col("issue_idx"), F.lit(True)))
        seen.select("issue_idx", "ok").write.mode("append").parquet(f"{base}/out")

    if not channel.drain(channel.file_source(spark, f"{base}/in", 2), consume, f"{base}/state", 600):
        raise TimeoutError("the channel was not drained")
    return spark.read.parquet(f"{base}/out").groupBy(F.floor(F.col("issue_idx") / 1000).alias("thousand")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("in_order"))
