"""An incremental drain of the event table: messages leave each channel in the order of their issue, whatever order they arrive in.

    python -m jobs.drain_channel --events DIR/events.parquet --out DIR --checkpoint DIR [--config FILE]

A message belongs to channel ``event_id mod channels`` with number ``event_id div channels`` there. A run takes the files that have come since
the last one, ``max_files`` at a time. A message is released when all before it in its channel have been; until then it is held
in the stream's state, across runs. Below ``out``, partitioned by ``channel``: event_id, number, slot and flag of its ring of 2^ring_log2
slots, value, total (the channel's sum so far, in order) and credit (the number up to which the producer may write, once this is out).

Messages that come again are released once. A null value counts as zero; messages without an id have no place in a channel and are left out. Spark's
checkpoint and file sink make each batch's output appear once, so a run that was cut off is simply repeated. ``channels`` and
the checkpoint go together: they can't change between runs.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from latticework.streaming import channel

log = logging.getLogger("drain_channel")
DEFAULTS = {"channels": 16, "ring_log2": 8, "max_files": 4}
OUT = "event_id long, number long, slot long, flag long, value double, total double, credit long, channel long"


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Drains what is new and returns all that has been released so far, read back."""
    config = DEFAULTS | (config or {})
    n, log2 = int(config["channels"]), int(config["ring_log2"])
    whole = events.rstrip("/")
    # file streams take folders and patterns: as a pattern, one file is read like a folder of it
    stream = channel.file_source(spark, f"{whole[:-1]}[{whole[-1]}]", int(config["max_files"]), "event_id long, value double").where("event_id is not null")
    messages = stream.select((F.col("event_id") % n).alias("channel"), F.expr(f"event_id div {n}").alias("number"), F.coalesce("value", F.lit(0.0)).alias("value"))
    number = F.col("number")
    done = channel.in_order(messages).select(
        (number * n + F.col("channel")).alias("event_id"),
        "number",
        channel.slot(number, log2).alias("slot"),
        channel.flag(number, log2).cast("long").alias("flag"),
        "value",
        "total",
        (number + (1 << log2)).alias("credit"),
        "channel",
    )
    query = done.writeStream.format("parquet").partitionBy("channel").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    held = sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"])
    log.info("read %d messages of %s in %d batches; %d channels have state", sum(p["numInputRows"] for p in batches), events, len(batches), held)
    released = spark.read.schema(OUT).parquet(out)
    log.info("%s has %d messages now", out, released.count())
    return released


#: The same rows, for DuckDB: the messages of each channel before its first gap.
ORACLE = """
with messages as (select event_id % 16 as channel, event_id // 16 as number, coalesce(any_value(value), 0) as value from events where event_id is not null group by 1, 2),
placed as (select *, row_number() over (partition by channel order by number) - 1 as place from messages)
select channel * 1::bigint as channel, number * 16 + channel as event_id, number, (number & 255)::bigint as slot, (1 - ((number >> 8) & 1))::bigint as flag, value,
  round(sum(value) over (partition by channel order by number), 4) as total, number + 256 as credit
from placed where number = place
"""

if __name__ == "__main__":
    main(run, "drain_channel", {"events": "the folder of message files", "out": "where released messages go", "checkpoint": "the stream's checkpoint"}, DEFAULTS)
