"""Pairs of overlapping intervals: each interval as few bins of several widths, each pair in the bin of the later start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Starts that a bin holds, about; a bin with more of them is dealt to several tasks.
BIN = 2_000


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest aligned bins that make up the bins ``first`` to ``last``, as (level, bin): bin b of a level is bins 2b and 2b + 1 of the one below.

    A level gives the bins that lie in the range at its edges and whose parent
    doesn't: one at either end, at most.
    """
    def bins(level: int) -> Column:
        width, wider = F.lit(1 << level), F.lit(1 << (level + 1))
        low, high = F.ceil(first / width), F.floor((last + 1) / width)
        up, down = F.ceil(first / wider), F.floor((last + 1) / wider)
        apart = (up >= down) if level + 1 < levels else F.lit(True)
        edges = F.filter(F.array_distinct(F.array(low, high - 1)), lambda b: (b >= low) & (b < high) & (apart | (b < 2 * up) | (b >= 2 * down)))
        return F.transform(edges, lambda b: F.struct(F.lit(level).alias("level"), b.cast("long").alias("bin")))

    return F.flatten(F.array(*map(bins, range(levels))))


def starts_within(starts: DataFrame, spans: DataFrame, by: list[str], width: int, origin: int, levels: int, strict: bool, most: int) -> DataFrame:
    """(point, span): the rows of ``starts`` (by, id, at, row) and ``spans`` (by, low, high, row) with low <= at <= high; low < at where ``strict``.

    A point stands in a bin of each level, a span in the bins that make it up, so
    they meet in one bin at most. Spans look in bins that hold points alone; a bin
    with more than ``most`` points is dealt to several tasks, and a span that covers
    it goes to all of these. Both bring their rows, so that pairs, of which there may
    be as many as the square of the rows, are made where they are used and never
    move; of a bin, a task holds its points.
    """
    bin_ = lambda c: F.floor((c - origin) / width)
    keys = [*by, "level", "bin"]
    points = starts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("bin", F.call_function("shiftright", bin_(F.col("at")), F.col("level")))
    sizes = points.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    pieces = spans.where("low <= high").withColumn("piece", F.explode(cover(bin_(F.col("low")), bin_(F.col("high")), levels))).select(*by, F.col("row").alias("span"), "low", "high", "piece.level", "piece.bin")
    pieces = pieces.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    points = points.join(sizes.where("parts > 1"), keys, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    after = F.col("at") > F.col("low") if strict else F.col("at") >= F.col("low")
    return pieces.join(points.hint("merge"), [*keys, "part"]).where(after & (F.col("at") <= F.col("high"))).select(F.col("row").alias("point"), "span")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, prefix: str = "r_", most: int = BIN) -> DataFrame:
    """Pairs of rows of the same ``by`` whose closed intervals from ``start`` to ``end`` have a moment in common; right columns get a prefix.

    Either the right interval starts within the left one, or the left one starts
    within the right one and later; each pair is found once, in a bin that holds the
    later start. Bins are as narrow as makes some ``most`` starts each on average,
    and double from level to level up to the whole time, so an interval over the
    whole time is a few bins and not all of them, and no task holds more than a bin.

    Intervals that end before they start, or lack an end, a start or a key, match
    nothing. Rows that are equal give a pair each.
    """
    spark = left.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("id"), F.struct(*df.columns).alias("row"), *[F.col(b).alias(f"_{k}") for k, b in enumerate(by)], _micros(F.col(start)).alias("low"), _micros(F.col(end)).alias("high"))
        rows = rows.where(F.col("low") <= F.col("high")).where(" and ".join(["true", *(f"_{k} is not null" for k in range(len(by)))]))
        path = scratch(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    a, b = kept(left, "left-spans"), kept(right, "right-spans")
    keys = [f"_{k}" for k in range(len(by))]
    ends = a.select("low", "high").union(b.select("low", "high")).agg(F.min("low"), F.max("high"), F.count("*")).first()
    origin, last, n = ends[0] or 0, ends[1] or 0, ends[2]
    width = max(1, (last - origin + 1) * most // max(1, n))
    levels = ((last - origin) // width).bit_length() + 1
    point = lambda df: df.select(*keys, "id", "row", F.col("low").alias("at"))
    span = lambda df: df.select(*keys, "row", "low", "high")
    found = starts_within(point(b), span(a), keys, width, origin, levels, False, most).select(F.col("span").alias("_left"), F.col("point").alias("_right"))
    found = found.union(starts_within(point(a), span(b), keys, width, origin, levels, True, most).select(F.col("point").alias("_left"), F.col("span").alias("_right")))
    return found.select("_left.*", *[F.col(f"_right.`{c}`").alias(f"{prefix}{c}") for c in right.columns])
