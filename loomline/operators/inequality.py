"""Joins on inequalities of two growing tables, as counts: sorted ranges, sums of the ranges before, and merges within a range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from ..sources.tables import scratch

#: Rows of a range, about.
STRIP = 200_000

#: By operator, for "left op right": whether right values must be the smaller ones, and whether equal ones count.
SMALLER = {">": (True, False), ">=": (True, True), "<": (False, False), "<=": (False, True)}


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list[Column], value: str, ranges: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows before a row in the given order.

    Rows are dealt into ranges by sampled bounds and summed up where they stand; the
    sums of whole ranges, a row each, are added to those within.
    """
    ship(df.sparkSession)
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _range int, _within long"

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, range_ = 0, TaskContext.get().partitionId()
        for batch in batches:
            x = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), range_, np.int32)), pa.array(ends - x)], [*columns, "_range", "_within"])
            total = int(ends[-1]) if len(ends) else total

    summed = stored(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(sum_up, schema), "sums")
    # A row a range.
    before = F.coalesce(F.sum("all").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = summed.groupBy("_range").agg(F.sum(value).alias("all")).withColumn("_offset", before).select("_range", "_offset")
    return summed.join(F.broadcast(offsets), "_range").select(*columns, (F.col("_offset") + F.col("_within")).alias("before"))


def earlier_and_smaller(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place of a permutation: the weight of what stands earlier and has a smaller number.

    The numbers' bits part the places from the highest on, each part in its first
    order: at a bit, those with a one have all earlier zeros of their part below them.
    """
    n = len(rank)
    out, place = np.zeros(n, np.int64), np.arange(n)
    for bit in range(max(0, n - 1).bit_length() - 1, -1, -1):
        r = rank[place]
        one = (r >> bit) & 1 > 0
        first = np.flatnonzero(np.concatenate([[True], r[1:] >> (bit + 1) != r[:-1] >> (bit + 1)]))
        size = np.diff(first, append=n)
        start = np.repeat(first, size)
        low = np.where(one, 0, weight[place])
        below = np.cumsum(low) - low
        out[place[one]] += (below - below[start])[one]
        zeros = np.cumsum(~one) - ~one
        zeros = zeros - zeros[start]
        many = np.repeat(np.add.reduceat(~one, first, dtype=np.int64), size)
        moved = np.where(one, start + many + (np.arange(n) - start - zeros), start + zeros)
        place[moved] = place.copy()
    return out


def _within(key: str, first: list[str], second: list[str]):
    """Counts of a range's rows by merging both orders; a left row doesn't count what is equal to it in the first one."""

    def within(table: pa.Table) -> pa.Table:
        sort = lambda names: np.lexsort([table.column(c).to_numpy() for c in reversed(names)])
        order = sort([*first, "side"])
        rank = np.empty(len(order), np.int64)
        rank[sort(second)] = np.arange(len(order))
        w, side = table.column("w").to_numpy(), table.column("side").to_numpy()
        n = np.empty(len(order), np.int64)
        n[order] = earlier_and_smaller(rank[order], w[order])
        asks = pa.array(side == 0)
        return pa.table({"ra": table.column("ra").filter(asks), "ia": table.column("ia").filter(asks), "n": pa.array(n).filter(asks)})

    return within


def _placed(df: DataFrame, order: list[Column], name: str, ranges: int) -> DataFrame:
    """``df`` with the number of its range in an order, r<name>, and its place there, i<name>."""
    numbered = stored(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), f"order-{name}")
    return numbered.withColumns({f"r{name}": F.shiftright("_at", 33).cast("int"), f"i{name}": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def inequality_counts(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, str]], name: str = "n", strip: int = STRIP) -> DataFrame:
    """``left`` with the number of rows of ``right`` for which every (left column, operator, right column) holds.

    One or two inequalities of <, <=, >, >=. No pairs are made. With one, the right
    rows are counted by value and summed up in order. With two, both orders are cut
    into ranges of some ``strip`` rows: rows in earlier ranges of both orders come
    from a table of range by range, summed both ways; those in the same range of
    either order from merging the two orders within the range. Rows with the same
    values are folded first, and equal values of one column spread over ranges.

    A null on either side matches nothing. NaN counts as the largest number. Left
    rows keep their number and columns; an empty right side gives zeros.
    """
    if len(conditions) not in (1, 2) or any(op not in SMALLER for _, op, _ in conditions):
        raise ValueError("one or two conditions with <, <=, > or >=")
    values = ["a", "b"][: len(conditions)]
    known = lambda df, names: df.select(*[F.col(c).alias(v) for c, v in zip(names, values, strict=True)]).where(" and ".join(f"{v} is not null" for v in values))
    asked = known(left, [c for c, _, _ in conditions]).distinct()
    held = known(right, [c for _, _, c in conditions]).groupBy(*values).agg(F.count("*").alias("w"))
    both = asked.withColumns({"w": F.lit(0).cast("long"), "side": F.lit(0)}).unionByName(held.withColumn("side", F.lit(1)))
    both = stored(both, "values")
    ranges = max(1, -(-both.count() // strip))
    counts = (_one if len(conditions) == 1 else _two)(both, [SMALLER[op] for _, op, _ in conditions], ranges)
    same = F.lit(True)
    for (c, _, _), v in zip(conditions, values, strict=True):
        same = same & (F.col(f"_row.`{c}`") == F.col(v))
    found = left.select(F.struct(*left.columns).alias("_row")).join(counts, same, "left")
    return found.select("_row.*", F.coalesce("_n", F.lit(0).cast("long")).alias(name))


def _one(both: DataFrame, rules: list[tuple[bool, bool]], ranges: int) -> DataFrame:
    (smaller, equal), = rules
    per = both.groupBy("a").agg(F.sum("w").alias("w"))
    order = F.col("a").asc() if smaller else F.col("a").desc()
    return prefix_sums(per, [order], "w", ranges).select("a", (F.col("before") + F.col("w") if equal else F.col("before")).alias("_n"))


def _two(both: DataFrame, rules: list[tuple[bool, bool]], ranges: int) -> DataFrame:
    for name, (smaller, equal) in zip(("a", "b"), rules, strict=True):
        # Of equal values those of the right side come first where they count.
        tie = F.col("side").desc() if equal else F.col("side").asc()
        other = F.xxhash64("b" if name == "a" else "a")
        both = _placed(both, [F.col(name).asc() if smaller else F.col(name).desc(), tie, other], name, ranges)
    strip_a = both.groupBy("ra").applyInArrow(_within("ra", ["ia"], ["rb", "ib"]), "ra int, ia long, n long")
    strip_b = both.groupBy("rb").applyInArrow(_within("rb", ["ra"], ["ib"]), "ra int, ia long, n long")
    # A row for each pair of ranges.
    grid = both.sparkSession.range(ranges * ranges).select((F.col("id") % ranges).cast("int").alias("rb"), F.floor(F.col("id") / ranges).cast("int").alias("ra"))
    grid = grid.join(both.groupBy("ra", "rb").agg(F.sum("w").alias("w")), ["ra", "rb"], "left")
    earlier = lambda by, along: W.partitionBy(by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("above", F.coalesce(F.sum("w").over(earlier("rb", "ra")), F.lit(0)))
    grid = grid.select("ra", "rb", F.coalesce(F.sum("above").over(earlier("ra", "rb")), F.lit(0)).alias("n"))
    asked = both.where("side = 0").select("a", "b", "ra", "rb", "ia")
    parts = asked.join(grid, ["ra", "rb"]).select("ra", "ia", "n").union(strip_a).union(strip_b)
    return asked.join(parts.groupBy("ra", "ia").agg(F.sum("n").alias("_n")), ["ra", "ia"]).select("a", "b", "_n")
