"""State that timers and the clock drop, and what the watermark lets in, on small made-up streams."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.session import ship
from loomline.sources.tables import scratch
from loomline.streaming import stateful
from loomline.streaming.queries import drain, emitted

T0 = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, event_type string, ts timestamp"


class Arriving:
    """A stream whose rows arrive in parts; what each part's batches report."""

    def __init__(self, spark, build, mode="append"):
        self.spark, self.build, self.mode = spark, build, mode
        self.source, self.out, self.state = (scratch(spark, name) for name in ("source", "out", "state"))

    def part(self, *rows):
        made = [(u, e, kind, None if h is None else T0 + timedelta(hours=h)) for u, e, kind, h in rows]
        self.spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        self.stream = self.build(self.spark.readStream.schema(SCHEMA).parquet(self.source))
        return drain(self.stream, self.mode, self.out, self.state)

    def rows(self):
        return emitted(self.spark, self.stream, self.mode, self.out).collect()


@pytest.fixture(scope="module", autouse=True)
def narrow(spark):
    """Two partitions of state are enough."""
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def held(reports):
    return reports[-1]["stateOperators"][0]["numRowsTotal"]


def test_silent_users_are_told_and_forgotten(spark):
    with stateful.state_store(spark):
        arriving = Arriving(spark, lambda s: stateful.silences(s.withWatermark("ts", "1 hour"), 10 * 3_600_000))
        first = arriving.part((1, 1, "click", 0), (1, 2, "click", 1), (1, 3, "view", 0), (2, 4, "view", 2), (3, 5, "view", 5))
        second = arriving.part((2, 6, "click", 4.5), (2, 60, "click", 4), (4, 7, "view", 20))  # 4 is late; the watermark comes to 19: users 1 to 3 are silent
        third = arriving.part((1, 8, "buy", 21), (5, 9, "view", 60), (5, 10, "view", 3))  # one comes back, and falls silent again
    got = sorted((r.user_id, r.n, r.kinds, r.clicks) for r in arriving.rows())
    assert got == [(1, 1, 1, 0), (1, 3, 2, 2), (2, 2, 2, 1), (3, 1, 1, 0), (4, 1, 1, 0)]
    assert held(first) > held(third) and held(second) < held(first)


class Store:
    """A state store of one value for each user, and of timers; counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802, ARG002
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_a_user_costs_few_calls_to_the_state_store():
    """Whatever the number of types; rows without a type or a time count, and move no timer."""
    store, silent = Store(), stateful.Silent(1_000)
    silent.init(store)
    rows = [(7, kind, 5_000_000 + i, None) for i, kind in enumerate(["click", "view", "buy", "click", None, "sell", "ask"])]
    assert list(silent.handleInputRows((7,), iter(rows), None)) == [] and store.calls == 3 and store.timers == [6_000]
    list(silent.handleInputRows((7,), iter([(7, "click", 9_000_000, None), (7, "view", 4_000_000, None)]), None))
    assert store.calls == 7 and store.timers == [10_000]
    list(silent.handleInputRows((7,), iter([(7, "view", None, None)]), None))
    assert store.calls == 9 and store.timers == [10_000]
    assert [r.asDict() for r in silent.handleExpiredTimer((7,), None, None)] == [{"user_id": 7, "micros": 9_000_000, "n": 10, "kinds": 5, "clicks": 3}]
    assert store.value is None


def test_known_types_expire(spark):
    with stateful.state_store(spark, empty_batches=False):
        kept = Arriving(spark, lambda s: stateful.news(s, 3_600_000))
        kept.part((1, 1, "click", 0), (1, 2, "click", 1), (2, 3, "click", 0))
        kept.part((1, 4, "click", 2), (1, 5, "view", 2))
        short = Arriving(spark, lambda s: stateful.news(s, 1))
        short.part((1, 1, "click", 0))
        time.sleep(0.1)
        short.part((1, 4, "click", 2))
    assert sorted(map(tuple, kept.rows())) == [(1, "click", 1), (1, "view", 5), (2, "click", 3)]
    assert sorted(map(tuple, short.rows())) == [(1, "click", 1), (1, "click", 4)]


def test_a_late_row_joins_two_sessions(spark):
    arriving = Arriving(spark, lambda s: stateful.sessions(s.withWatermark("ts", "12 hours"), "6 hours"))
    arriving.part((1, 1, "a", 0), (1, 2, "a", 10), (2, 3, "a", 10), (1, 4, "a", 10.5))
    arriving.part((1, 5, "a", 5), (2, 6, "a", 15), (3, 7, "a", 18))  # 5 lies between 0 and 10
    last = arriving.part((4, 8, "a", 80), (3, 9, "a", 2))  # 2 + 6 is behind the watermark, which is at 6 in that batch: let in; all but the last close
    got = sorted((r.user_id, r.n, int((r.end_ - r.start_).total_seconds() // 1800)) for r in arriving.rows())
    assert (1, 4, 33) in got and (2, 2, 22) in got
    assert sum(g[1] for g in got) in (7, 8) and held(last) == 1


def test_outer_rows_come_when_the_watermark_has_passed(spark):
    arriving = Arriving(spark, lambda s: stateful.purchases_and_clicks(s.withWatermark("ts", "2 hours")))
    first = arriving.part((1, 1, "purchase", 5), (1, 2, "click", 4.5), (2, 3, "purchase", 5), (9, 4, "click", 5))
    early = {(r.event_id, r.click_id) for r in arriving.rows()}
    assert early == {(1, 2)}
    arriving.part((2, 5, "click", 4.25), (3, 6, "purchase", 12), (9, 7, "click", 12))  # late, but still let in: the watermark was at 3
    arriving.part((3, 8, "click", 2), (4, 9, "purchase", 40), (9, 10, "click", 40))  # too late
    last = arriving.part((9, 11, "click", 41), (9, 12, "purchase", 41))
    got = {(r.event_id, r.click_id) for r in arriving.rows()}
    assert got >= {(1, 2), (2 + 1, 5), (6, None)} and (9, None) not in got and not any(c == 8 for _, c in got)
    assert held(last) < 8 and first


def test_rows_that_are_not_there(spark):
    arriving = Arriving(spark, lambda s: stateful.sessions(s.withWatermark("ts", "1 hour")))
    arriving.part()
    arriving.part((1, 1, "a", None))
    assert arriving.stream.isStreaming and arriving.rows() == []


def test_the_settings_are_as_before(spark):
    names = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ZeroDivisionError), stateful.state_store(spark, empty_batches=False):
        assert spark.conf.get(names[1]) == "false"
        1 / 0  # noqa: B018
    assert [spark.conf.get(n) for n in names] == before
    assert spark.range(1).select(F.lit(1)).count() == 1
