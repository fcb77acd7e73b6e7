"""Streaming queries. Each reads a table's files as a stream until they are used up; results go to a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import read, read_stream
from ..sources.tables import scratch
from . import stateful


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream of the files that are there emits, as a table. Complete mode keeps the last batch's rows, other modes all rows."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    drain(stream, mode, out, scratch(spark, "stream-state"))
    return emitted(spark, stream, mode, out)


def drain(stream: DataFrame, mode: str, out: str, state: str) -> list[dict]:
    """Run a query on the files that its state hasn't seen; what each batch reports. A batch that is tried again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def emitted(spark: SparkSession, stream: DataFrame, mode: str, out: str, *more: str) -> DataFrame:
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.select(*stream.columns, *more)


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All that ``build`` emits while the parts arrive one after the other.

    Each part's files are a batch of their own; the query ends after it and goes on
    from its checkpoint with the next, so that state and watermark are read back.
    """
    spark = parts[0].sparkSession
    source, out, state = (scratch(spark, name) for name in ("stream-source", "stream", "stream-state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(part.schema).parquet(source))
        drain(stream, mode, out, state)
    return emitted(spark, stream, mode, out)


def decades(table: DataFrame) -> list[DataFrame]:
    """The events of the month's first ten days, the next ten, and the rest."""
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    return [table.where(third == k) for k in range(3)]


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream with a zoned time, which watermarks need; the session's zone is UTC."""
    return read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each hour and type, complete mode."""
    found = events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return run(found, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start_"), "event_type", "n")


def closed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Counts of hours that the watermark has passed, append mode; the last hour stays open."""
    found = events(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return run(found, "append").select(F.col("window.start").cast("timestamp_ntz").alias("start_"), "n")


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, within a watermark of a day, of a stream with repeated and late rows.

    The events come in three parts. Every event with an id divisible by ten comes
    twice in its part, and again in the next one, days later. Events of the first
    part whose id ends in 1 are held back to the second: those before the watermark
    by then are dropped, the others are still let in.
    """
    first, second, third = decades(read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")))
    late, again = F.col("event_id") % 10 == 1, F.col("event_id") % 10 == 0
    on_time = first.where(~late)
    parts = [on_time.union(on_time.where(again)), second.union(second.where(again)).union(first.where(late | again)), third.union(second.where(again))]
    return run_in_parts(parts, lambda s: s.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]), "append").select("event_id", "user_id")


def stream_static(spark: SparkSession, d: str) -> DataFrame:
    """Events with the segment of the customer of the same number, a table; each batch joins it anew."""
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return run(events(spark, d).join(customers, "user_id").select("event_id", "c_mktsegment"), "append")


def stream_stream(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within an hour after a click of the same user, both sides streams whose state the watermarks bound."""
    clicks = events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    bought = events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts").withWatermark("ts", "1 hour")
    joined = bought.join(clicks, F.expr("user_id = u and ts between clicked and clicked + interval 1 hour"))
    return run(joined.select("event_id", "click_id"), "append")


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events and sum of values by user after the last of three parts, held in a state of one's own across batches."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, cents = state.get if state.exists else (0, 0)
        for pdf in batches:
            n, cents = n + len(pdf), cents + int((pdf["value"] * 100).round().sum())
        state.update((n, cents))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})

    build = lambda s: s.groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, cents long", "n long, cents long", "update", GroupStateTimeout.NoTimeout)
    kept = run_in_parts(decades(read(spark, d, "events").select("user_id", "value", "ts")), build, "update")
    last = kept.groupBy("user_id").agg(F.max(F.struct("n", "cents")).alias("s"))
    return last.select("user_id", "s.n", "s.cents")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Events whose type differs from the user's event before, by a processor with a state store of its own across three parts."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        build = lambda s: s.groupBy("user_id").transformWithStateInPandas(LastType(), "user_id long, event_id long, event_type string", "append", "none")
        return run_in_parts(decades(read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")), build, "append")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


class LastType(StatefulProcessor):
    """Keeps each user's last type, and gives the events that change it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_type string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        pdf = pd.concat(rows).sort_values(["ts", "event_id"])
        held = self.last.get()
        before = pdf["event_type"].shift(1, fill_value=held[0] if held is not None else "")
        self.last.update((pdf["event_type"].iloc[-1],))
        yield pdf.loc[pdf["event_type"] != before, ["user_id", "event_id", "event_type"]]

    def close(self) -> None:
        pass


STREAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "b04_b42_stream_complete": (hourly, "select time_bucket(interval '1 hour', ts) as start_, event_type, count(*) as n from events group by 1, 2"),
    "b42_stream_append": (
        closed_hours,
        "select time_bucket(interval '1 hour', ts) as start_, count(*) as n from events group by 1 having time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)",
    ),
    "b43_stream_dedup": (
        deduplicated,
        """select event_id, user_id from events where not (event_id % 10 = 1 and day(ts) <= 10 and epoch_us(ts) <= (
             select epoch_us(max(ts)) // 1000 * 1000 - 86400000000 from events where day(ts) <= 10 and event_id % 10 <> 1))""",
    ),
    "b44_stream_state": (running_totals, "select user_id, count(*) as n, cast(sum(round(value * 100)) as bigint) as cents from events group by 1"),
    "b44_transform_with_state": (
        changes,
        "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type",
    ),
    "b45_stream_static_join": (stream_static, "select event_id, c_mktsegment from events join customer on user_id = c_custkey"),
    "b45_stream_stream_join": (
        stream_stream,
        "select a.event_id, b.event_id as click_id from events a join events b on a.user_id = b.user_id and a.ts between b.ts and b.ts + interval '1 hour' where a.event_type = 'purchase' and b.event_type = 'click'",
    ),
    **stateful.queries(decades, run_in_parts),
}
