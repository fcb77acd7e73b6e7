"""Streams that keep state of their own: timers for keys that fall silent, entries that expire, outer joins, sessions that late rows merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..sources import read

#: A user without events for so long is silent.
SILENT_MS = 12 * 3_600_000
DELAY = "1 day"
SESSION = "6 hours"
#: How long a type that a user had counts as known.
KNOWN_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """The state store that processors with states of several kinds need, for the streams started within.

    A stream whose state expires by the clock would go on with empty batches for
    ever; without ``empty_batches`` it ends with the last rows.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Silent(StatefulProcessor):
    """Counts each user's events by type, and tells of them once the watermark is ``after`` milliseconds past the last one; the state is then dropped.

    Each call to the state store is a round trip to it, so a user's state is one
    value, read and written once a batch, and its timer is known from that.
    """

    def __init__(self, after: int = SILENT_MS) -> None:
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, n long, types map<string, long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        held = self.seen.get()
        last, n, types = (None, 0, {}) if held is None else (held[0], held[1], dict(held[2]))
        newest = last
        for _, kind, micros, _ in rows:
            n += 1
            if kind is not None:
                types[kind] = types.get(kind, 0) + 1
            if micros is not None and (newest is None or micros > newest):
                newest = micros
        self.seen.update((newest, n, types))
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(last // 1000 + self.after)
            self.handle.registerTimer(newest // 1000 + self.after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        last, n, types = self.seen.get()
        self.seen.clear()
        yield Row(user_id=key[0], micros=last, n=n, kinds=len(types), clicks=types.get("click", 0))

    def close(self) -> None:
        pass


def silences(stream: DataFrame, after: int = SILENT_MS) -> DataFrame:
    """(user_id, micros, n, kinds, clicks) of users that have fallen silent, of a stream with user_id, event_type and a watermark on ts."""
    rows = stream.select("user_id", "event_type", F.unix_micros("ts").alias("micros"), "ts")
    return rows.groupBy("user_id").transformWithState(Silent(after), "user_id long, micros long, n long, kinds long, clicks long", "append", "eventTime")


class News(StatefulProcessor):
    """The first event of each type that a user hasn't had for ``known`` milliseconds of the clock; entries of the state expire by themselves."""

    def __init__(self, known: int = KNOWN_MS) -> None:
        self.known = known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_type string", "event_id long", ttlDurationMs=self.known)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        first: dict[str | None, int | None] = {}
        for _, kind, event in rows:
            held = first.setdefault(kind, event)
            if held is None or event is not None and event < held:
                first[kind] = event
        known = {kind for (kind,) in self.seen.keys()}  # all at once, as each call is a round trip
        for kind, event in first.items():
            if kind not in known:
                self.seen.updateValue((kind,), (event,))
                yield Row(user_id=key[0], event_type=kind, event_id=event)

    def close(self) -> None:
        pass


def news(stream: DataFrame, known: int = KNOWN_MS) -> DataFrame:
    """(user_id, event_type, event_id) of types that are new to a user."""
    return stream.select("user_id", "event_type", "event_id").groupBy("user_id").transformWithState(News(known), "user_id long, event_type string, event_id long", "append", "processingTime")


def sessions(stream: DataFrame, gap: str = SESSION) -> DataFrame:
    """Sessions of each user that the watermark has closed; a late row joins those that it lies between."""
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"), "n")


def purchases_and_clicks(stream: DataFrame) -> DataFrame:
    """Each purchase with the user's clicks within the hour before, or none once the watermark rules them out."""
    clicks = stream.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("clicked"))
    bought = stream.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return bought.join(clicks, F.expr("user_id = u and ts between clicked and clicked + interval 1 hour"), "left").select("event_id", "click_id")


def _parts(spark: SparkSession, d: str, columns: list[str], late: str, decades: Callable[[DataFrame], list[DataFrame]]) -> list[DataFrame]:
    """The events in three parts; those of the first that meet ``late`` come with the second."""
    first, second, third = decades(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns))
    return [first.where(f"not ({late})"), second.union(first.where(late)), third]


def queries(decades: Callable, run_in_parts: Callable) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """The queries of this module, given the ways to part events and to run a stream over the parts."""

    def watermarked(stream: DataFrame, delay: str = DELAY) -> DataFrame:
        return stream.withWatermark("ts", delay)

    def silent_users(spark: SparkSession, d: str) -> DataFrame:
        """Users that fall silent for twelve hours while events come in three parts; some come back later."""
        ship(spark)
        with state_store(spark):
            found = run_in_parts(_parts(spark, d, ["user_id", "event_type", "ts"], "false", decades), lambda s: silences(watermarked(s, "1 hour")), "append")
        return found.select("user_id", F.timestamp_micros("micros").cast("timestamp_ntz").alias("last_seen"), "n", "kinds", "clicks")

    def new_types(spark: SparkSession, d: str) -> DataFrame:
        """The first event of each type of each user; types stay known longer than the run lasts."""
        ship(spark)
        with state_store(spark, empty_batches=False):
            return run_in_parts(_parts(spark, d, ["user_id", "event_type", "event_id", "ts"], "false", decades), news, "append")

    def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
        """Sessions over three parts. Every tenth event of the first part comes with the second: those of the tenth day in time, those up to the eighth too late."""
        parts = _parts(spark, d, ["user_id", "event_id", "ts"], "event_id % 10 = 1 and (day(ts) <= 8 or day(ts) = 10)", decades)
        found = run_in_parts(parts, lambda s: sessions(watermarked(s)), "append")
        return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_", "end_")], "n")

    def outer_join(spark: SparkSession, d: str) -> DataFrame:
        """Purchases with or without clicks over three parts; every tenth event of the first part's days comes with the second, too late up to the eighth."""
        parts = _parts(spark, d, ["user_id", "event_id", "event_type", "ts"], "event_id % 10 = 1 and event_type = 'click' and (day(ts) <= 8 or day(ts) = 10)", decades)

        def build(stream: DataFrame) -> DataFrame:
            return purchases_and_clicks(watermarked(stream))

        return run_in_parts(parts, build, "append")

    return {
        "b41_stream_sessions": (
            stream_sessions,
            """with e as (select user_id, ts from events where not (event_id % 10 = 1 and day(ts) <= 8)),
               s as (select *, sum(new) over (partition by user_id order by ts) as k from (
                 select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval '6 hours' then 0 else 1 end as new from e))
               select user_id, min(ts) as start_, max(ts) + interval '6 hours' as end_, count(*) as n from s group by user_id, k
               having max(ts) + interval '6 hours' <= (select max(ts) - interval '1 day' from events)""",
        ),
        "b44_new_types": (new_types, "select user_id, event_type, min(event_id) as event_id from events group by 1, 2"),
        "b44_timers": (
            silent_users,
            """with e as (select user_id, event_type, ts, least((day(ts) - 1) // 10, 2) as p from events),
               m as (select max(ts) filter (p = 0) - interval '1 hour' as w0, max(ts) filter (p <= 1) - interval '1 hour' as w1, max(ts) - interval '1 hour' as w2 from e),
               u as (select user_id, m.*, """
            + ", ".join(f"list(event_type) filter (p = {p}) as t{p}, max(ts) filter (p = {p}) as l{p}" for p in range(3))
            + """ from e, m group by all),
               a as (select *, coalesce(t0, []) as s0, l0 as x0, coalesce(l0 + interval '12 hours' <= w0, false) as e0 from u),
               b as (select *, list_concat(case when e0 then [] else s0 end, coalesce(t1, [])) as s1, coalesce(l1, case when not e0 then x0 end) as x1 from a),
               c as (select *, coalesce(x1 + interval '12 hours' <= w1, false) as e1 from b),
               f as (select *, list_concat(case when e1 then [] else s1 end, coalesce(t2, [])) as s2, coalesce(l2, case when not e1 then x1 end) as x2 from c),
               g as (select *, coalesce(x2 + interval '12 hours' <= w2, false) as e2 from f)
               select user_id, x as last_seen, cast(len(s) as bigint) as n, cast(len(list_distinct(s)) as bigint) as kinds, cast(len(list_filter(s, lambda t: t = 'click')) as bigint) as clicks
               from (select user_id, s0 as s, x0 as x from g where e0 union all select user_id, s1, x1 from g where e1 union all select user_id, s2, x2 from g where e2)""",
        ),
        "b45_stream_outer_join": (
            outer_join,
            """with e as (select * from events where not (event_id % 10 = 1 and event_type = 'click' and day(ts) <= 8)),
               j as (select a.event_id, a.ts, b.event_id as click_id from (select * from events where event_type = 'purchase') a
                 left join (select * from e where event_type = 'click') b on a.user_id = b.user_id and a.ts between b.ts and b.ts + interval '1 hour')
               select event_id, click_id from j where click_id is not null or ts < (select max(ts) - interval '1 day' from events)""",
        ),
    }
