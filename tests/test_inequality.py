"""Joins on inequalities and on overlapping intervals on small made-up rows, against brute force."""

from __future__ import annotations

import math
import operator
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import inequality_counts, overlap_join, prefix_sums
from loomline.operators.inequality import earlier_and_smaller
from loomline.registry import QUERIES

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def test_earlier_and_smaller():
    draw = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 200):
        rank, weight = draw.permutation(n), draw.integers(0, 4, n)
        assert earlier_and_smaller(rank, weight).tolist() == [sum(int(weight[j]) for j in range(i) if rank[j] < rank[i]) for i in range(n)]


def test_prefix_sums(spark):
    rows = [((k * 37) % 101, f"s{k % 3}", k % 5) for k in range(101)]
    df = spark.createDataFrame(rows, "k int, s string, v long")
    for order, key in (([F.col("k")], lambda r: r[0]), ([F.col("s").desc(), F.col("k")], lambda r: (-int(r[1][1]), r[0]))):
        want, total = {}, 0
        for r in sorted(rows, key=key):
            want[r[0]], total = total, total + r[2]
        got = prefix_sums(df, order, "v", 7)
        assert got.columns == ["k", "s", "v", "before"] and {r.k: r.before for r in got.collect()} == want


SCHEMA = "x double, y int, n string, a int, side int, w int"


def numbers(seed, n, nulls=True):
    """Ties, one value in a third of all rows, nulls, NaN and infinities."""
    draw = random.Random(seed)
    some = [0.5, -1.0, math.nan, math.inf, -math.inf, -0.0, 0.0]
    x = lambda: 3.0 if draw.random() < 0.35 else draw.choice(some) if draw.random() < 0.2 else draw.randint(0, 20) / 4
    return [(None if nulls and draw.random() < 0.08 else x(), None if nulls and draw.random() < 0.08 else draw.randint(0, 9), "n", 1, 2, 3) for _ in range(n)]


def holds(op, a, b):
    if a is None or b is None:
        return False
    rank = lambda v: (1, 0.0) if math.isnan(v) else (0, v)
    return OPS[op](rank(a), rank(b))


@pytest.mark.parametrize("op", list(OPS))
@pytest.mark.parametrize("strip", [9, 200_000])
def test_one_inequality(spark, op, strip):
    left, right = numbers(1, 70), numbers(2, 90)
    got = inequality_counts(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), [("x", op, "x")], "found", strip)
    assert got.columns == ["x", "y", "n", "a", "side", "w", "found"]
    want = Counter((repr(a[0] if a[0] != 0 else 0.0), a[1], sum(holds(op, a[0], b[0]) for b in right)) for a in left)
    assert Counter((repr(r.x if r.x != 0 else 0.0), r.y, r.found) for r in got.collect()) == want


@pytest.mark.parametrize(("first", "second"), [("<", ">"), ("<=", ">="), (">", ">"), (">=", "<"), ("<=", "<=")])
@pytest.mark.parametrize("strip", [13, 200_000])
def test_two_inequalities(spark, first, second, strip):
    left, right = numbers(3, 80), numbers(4, 120)
    got = inequality_counts(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), [("x", first, "x"), ("y", second, "y")], "found", strip)
    want = Counter((repr(a[0] if a[0] != 0 else 0.0), a[1], sum(holds(first, a[0], b[0]) and holds(second, a[1], b[1]) for b in right)) for a in left)
    assert Counter((repr(r.x if r.x != 0 else 0.0), r.y, r.found) for r in got.collect()) == want


def test_inequalities_of_nothing(spark):
    some, none = spark.createDataFrame(numbers(5, 9), SCHEMA), spark.createDataFrame([], SCHEMA)
    for on in ([("x", "<", "x")], [("x", "<", "x"), ("y", ">", "y")]):
        assert [r.k for r in inequality_counts(some, none, on, "k").collect()] == [0] * 9
        assert inequality_counts(none, some, on, "k").count() == 0


@pytest.mark.parametrize("name", ["b10_inequality_counts", "b10_two_inequalities", "b11_overlaps"])
def test_no_nested_loop(spark, sf_dir, capsys, name):
    QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


T0 = datetime(2024, 1, 1)
SPANS = "id long, k int, start_ timestamp_ntz, end_ timestamp_ntz, bin int, part int"


def spans(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        s = draw.choice([0, 50, 1000, 1000, 1000]) if draw.random() < 0.4 else draw.randint(0, 3000)
        e = s + draw.choice([0, 0, 1, 5, 60, 400, -3])
        if i % 17 == 0:
            s, e = 0, 3600
        out.append((i, None if i % 23 == 5 else draw.randint(0, 1), None if i % 29 == 3 else T0 + timedelta(seconds=s), None if i % 31 == 4 else T0 + timedelta(seconds=e), 1, 2))
    return [*out, out[7], out[7]]


@pytest.mark.parametrize("most", [1, 7, 2_000])
def test_overlaps(spark, most):
    """Points, equal starts, intervals over the whole time, backward ones and nulls; bins of one start and of all."""
    left, right = spans(1, 120), spans(2, 90)
    got = overlap_join(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), ["k"], "start_", "end_", most=most)
    assert got.columns == [*SPANS.replace(" long", "").replace(" int", "").replace(" timestamp_ntz", "").split(", "), *[f"r_{c}" for c in ("id", "k", "start_", "end_", "bin", "part")]]
    good = lambda x: None not in x[:4] and x[2] <= x[3]
    want = Counter((a[0], b[0]) for a in left for b in right if good(a) and good(b) and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert Counter((r.id, r.r_id) for r in got.collect()) == want


def test_pairs_of_overlaps_do_not_move(spark, capsys):
    """There may be as many as the square of the rows."""
    some = spark.createDataFrame(spans(3, 20), SPANS)
    overlap_join(some, some, ["k"], "start_", "end_", most=3).explain()
    above = capsys.readouterr().out.split("Union")[0]
    assert "Plan" in above and "Exchange" not in above and "Join" not in above


def test_overlaps_without_keys_or_rows(spark):
    some, none = spark.createDataFrame(spans(3, 20), SPANS), spark.createDataFrame([], SPANS)
    assert overlap_join(some, none, ["k"], "start_", "end_").count() == 0 and overlap_join(none, none, ["k"], "start_", "end_").count() == 0
    good = [x for x in spans(3, 20) if None not in x[2:4] and x[2] <= x[3]]
    assert overlap_join(some, some, [], "start_", "end_", most=3).count() == sum(a[2] <= b[3] and b[2] <= a[3] for a in good for b in good)


def test_an_interval_over_the_whole_time_is_few_bins(spark):
    from loomline.operators.overlaps import cover

    df = spark.createDataFrame([(a, b) for a in range(33) for b in range(a, 33)], "a long, b long")
    for r in df.select("a", "b", cover(F.col("a"), F.col("b"), 7).alias("bins")).collect():
        held = sorted(x for p in r.bins for x in range(p.bin << p.level, (p.bin + 1) << p.level))
        assert held == list(range(r.a, r.b + 1)) and len(r.bins) <= 2 * 6
