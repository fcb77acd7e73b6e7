"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same vertices as (a, b) does: each vertex to the smallest of its component."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of links shrinks to a forest of at most as many links as it has vertices."""
    for pdf in batches:
        if len(pdf):
            a, b = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(id, component_id) for every vertex of ``links`` (columns a, b: long) that isn't its own component's smallest.

    Alternates large-star and small-star steps (Kiveris et al., 2014): neighbours
    are only ever reduced to their minimum, so no list of a hub's neighbours is
    built, and each join can be split by adaptive execution where a hub is hot.
    Null ends and self-links are ignored; no links give an empty table.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = work.write(links.mapInPandas(_contract, "a long, b long").where("a <> b").distinct(), f"{name}-0")
    seen = None
    for step in range(1, 200):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Here a > b in every row: the neighbours of a that are smaller than it, and a itself, all go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = work.write(stars, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{step - 1}")
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        seen = now
    raise RuntimeError("components did not settle")
