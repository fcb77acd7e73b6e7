"""Exact vector search and the inverted-file index on small made-up rows, against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import build_index, nearest_neighbours, open_index
from loomline.operators import search
from loomline.session import ship
from loomline.sources.tables import scratch

SCHEMA = "id long, x array<float>, cell int, part string, side int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "p", 2) for i, x in rows], SCHEMA)


def by_hand(rows, asks, k):
    fine = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = []
    for i, x in fine:
        if asks(i):
            near = {(-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y in fine if j != i and len(y) == len(x)}
            out += [(i, j, -s) for s, j in sorted(near)[:k]]
    return sorted(out)


def found(df):
    return sorted((r.query, r.neighbour, round(r.similarity, 9)) for r in df.collect())


ODD = [(900, None), (901, []), (902, [0.0, 0.0, 0.0]), (903, [1.0, None, 2.0]), (904, [math.nan, 1.0, 1.0]), (905, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-30, 1e-30, 0.0]), (909, [1e30, 1e30, 0.0])]


def points(n, seed=0):
    draw = np.random.default_rng(seed)
    return [(k, draw.normal(size=3).round(1).tolist() if k % 3 else [1.0, 1.0, 0.0]) for k in range(n)]


@pytest.mark.parametrize("k", [1, 4, 1000])
@pytest.mark.parametrize("small", [False, True])
def test_exact_neighbours(spark, monkeypatch, k, small):
    """Ties, equal vectors in a third of all rows, unusable vectors; one block, and many blocks and parts."""
    if small:
        monkeypatch.setattr(search, "BLOCK_BYTES", 100)
        monkeypatch.setattr(search, "ROWS", 9)
    rows = [*points(60), *ODD]
    rows = [(i, x) for i, x in rows if x != [0.0, 0.0, 0.0] or i == 902]
    got = nearest_neighbours(frame(spark, rows).repartition(3), F.col("id") % 4 == 0, "id", "x", k)
    assert found(got) == by_hand(rows, lambda i: i % 4 == 0, k)


def test_a_vector_that_is_not_finite_takes_no_place(spark):
    rows = [(k, [1.0, float(k)]) for k in range(8)]
    clean, nan = (found(nearest_neighbours(frame(spark, r), F.lit(True), "id", "x", 10)) for r in (rows, [*rows, (8, [math.nan, 0.0])]))
    assert clean == nan and len(clean) == 56


def test_exact_neighbours_of_nothing(spark):
    assert nearest_neighbours(frame(spark, []), F.lit(True), "id", "x", 3).count() == 0
    assert nearest_neighbours(frame(spark, points(5)), F.lit(False), "id", "x", 3).count() == 0


def clusters(n, width=16, centres=12, seed=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    return [(k, (middle[k % centres] + 0.4 * draw.normal(size=width)).astype(np.float32).tolist()) for k in range(n)]


def test_index_recall_and_pruning(spark, capsys):
    rows = [*clusters(1500), (5000, None), (5001, [math.nan] * 16), (5002, [1.0] * 4)]
    df = frame(spark, rows)
    path = scratch(spark, "index")
    built = build_index(df, "id", "x", path)
    index = open_index(spark, path)
    assert index.probes == built.probes < len(index.centroids) / 2
    assert index.rows().count() == 1500 and {r.id for r in index.rows().collect()} == set(range(1500))
    asks = df.where("id % 20 = 0")
    got = found(index.search(asks, "id", "x", 10))
    want = by_hand(rows, lambda i: i % 20 == 0, 10)
    assert len(got) == len(want) == 750
    assert len({g[:2] for g in got} & {w[:2] for w in want}) >= 0.9 * len(want)
    capsys.readouterr()
    found_few = index.search(df.where("id = 40"), "id", "x", 10)
    found_few.explain("formatted")
    plan = capsys.readouterr().out
    cells = re.search(r"PartitionFilters: \[.*?cell#\d+L? (?:IN \(([\d,]+)\)|INSET ([\d, ]+)|= (\d+))", plan)
    assert cells and len((cells[1] or cells[2] or cells[3]).split(",")) == index.probes
    files = {r[0] for r in index.rows().where(F.col("cell").isin([0])).select(F.input_file_name()).distinct().collect()}
    assert files and all("cell=0/" in f for f in files)


def test_all_cells_give_the_exact_result(spark):
    rows = points(90)
    rows = [(i, x) for i, x in rows if any(x)]
    df = frame(spark, rows)
    index = build_index(df.where("id < 50"), "id", "x", scratch(spark, "index"), cells=7)
    index.add(df.where("id >= 50"), "id", "x")
    assert found(index.search(df.where("id % 5 = 0"), "id", "x", 4, probes=7)) == by_hand(rows, lambda i: i % 5 == 0, 4)


def test_index_of_nothing(spark):
    index = build_index(frame(spark, []), "id", "x", scratch(spark, "index"))
    assert index.rows().count() == 0 and index.search(frame(spark, points(3)), "id", "x", 2).count() == 0
