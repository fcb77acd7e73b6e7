"""Joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a key that a range of time holds, about.
RANGE = 100_000


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _span(left: DataFrame, right: DataFrame, by: list[str], on: str) -> int:
    """Seconds of a range in which the most frequent key has some RANGE rows."""
    times = left.select(*by, _micros(F.col(on)).alias("_t")).unionByName(right.select(*by, _micros(F.col(on)).alias("_t")))
    r = times.groupBy(*by).agg(F.count("*").alias("n"), F.min("_t").alias("low"), F.max("_t").alias("high")).agg(F.max("n"), F.min("low"), F.max("high")).first()
    return max(1, ((r[2] or 0) - (r[1] or 0)) // 1_000_000 * RANGE // max(1, r[0] or 0) + 1)


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], prefix: str = "last_", span: int | None = None) -> DataFrame:
    """Each left row with the ``take`` columns of the latest right row of the same ``by`` at or before its ``on``.

    A key's time is cut in ranges of ``span`` seconds, by default so that the most
    frequent key has some RANGE rows in each. Both sides go through one shuffle by
    key and range, and a window fills the latest right values forward within it;
    what a range begins with comes from the last right values of the key's ranges, a
    row each. So a busy key spreads over its ranges. Left rows without an earlier
    right row keep nulls; where several right rows share key and time, the one whose
    taken values are largest counts. Null keys and times match nothing, and their
    rows are set aside.
    """
    span = span or _span(left, right, by, on)
    known = F.lit(True)
    for c in (*by, on):
        known = known & F.col(c).isNotNull()
    range_ = F.floor(_micros(F.col(on)) / F.lit(span * 1_000_000))
    key = F.struct(*[F.col(t) for t in take])
    ends = right.where(known).select(*by, on, key.alias("_right"), range_.alias("_range"))
    kind = ends.schema["_right"].dataType
    tagged = left.where(known).withColumns({"_right": F.lit(None).cast(kind), "_range": range_, "_left": F.lit(1)})
    every = tagged.unionByName(ends.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    within = W.partitionBy(*by, "_range").orderBy(F.col(on), F.col("_left"), F.col("_right")).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = every.withColumn("_right", F.last("_right", ignorenulls=True).over(within)).where("_left = 1")
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    asked = tagged.select(*by, "_range", F.lit(None).cast(f"struct<t:timestamp_ntz,v:{kind.simpleString()}>").alias("_tail"))
    tails = ends.select(*by, "_range", F.struct(F.col(on).cast("timestamp_ntz").alias("t"), F.col("_right").alias("v")).alias("_tail"))
    tails = asked.unionByName(tails).groupBy(*by, "_range").agg(F.max("_tail").alias("_tail")).withColumn("_carried", F.last("_tail", ignorenulls=True).over(before)["v"])
    found = filled.join(tails.select(*by, "_range", "_carried"), [*by, "_range"], "left").withColumn("_right", F.coalesce("_right", "_carried"))
    found = found.select(*left.columns, *[F.col(f"_right.{t}").alias(prefix + t) for t in take])
    none = [F.lit(None).cast(right.schema[t].dataType).alias(prefix + t) for t in take]
    return found.unionByName(left.where(~known).select(*left.columns, *none))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, seconds: int) -> DataFrame:
    """Pairs of the same key whose right time lies in [left time, left time + seconds]; right columns get the prefix ``r_``.

    Times fall in bins as wide as the interval, and each left row looks in its own
    bin and the next, so key and bin make up an equi-join: a busy key spreads over
    its bins, and no task compares a key's rows all with all.
    """
    bin_ = lambda c: F.floor(_micros(F.col(c)) / F.lit(seconds * 1_000_000))
    a = left.withColumn("_bin", F.explode(F.array(bin_(left_on), bin_(left_on) + 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rbin", bin_(f"r_{right_on}"))
    same = F.col("_bin") == F.col("_rbin")
    for k in by:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    upper = F.col(left_on) + F.expr(f"interval {int(seconds)} seconds")
    return a.join(b, same & F.col(f"r_{right_on}").between(F.col(left_on), upper)).drop("_bin", "_rbin")
