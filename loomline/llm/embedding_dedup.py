"""Embedding near-dedup: int8 tile products with per-vector error bounds, double precision where the bounds leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .hot import join_hot
from .workspace import Workspace

LEAST = 0.95
TILE = 4096
STRIP = 512
PIVOTS = 64
#: What float32 may round in the screening comparison, far above its error for products of int8 sums.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, and one not zero."""
    one = vector.cast("array<double>")
    fine = F.forall(one, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(one, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge components under- or overflow."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Quantised:
    """Unit vectors as int8 with a scale each: x = scale * q + rest, with the exact lengths of ``rest`` and of scale * q."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.scale = np.abs(x).max(1) / 127
        self.q = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.rest = np.sqrt(((x - near) ** 2).sum(1)) + 1e-12
        self.size = np.sqrt((near**2).sum(1)) + 1e-12


def strip_links(a: Quantised, b: Quantised, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """By strip of STRIP rows: index pairs of cosine >= ``least`` and how many were recomputed; each unordered pair once where both tiles are one.

    |x.y - s_x s_y q_x.q_y| <= rest_x |y| + |s_x q_x| rest_y, with |y| = 1. Sums of
    at most 1,000 products of int8 are exact in float32; for longer vectors the
    bound takes in what each further sum may round.
    """
    slack = SLACK + (a.x.shape[1] * 2.0**-23 if a.x.shape[1] > 1000 else 0)
    qb = b.q.astype(np.float32).T.copy()
    column = b.scale.astype(np.float32)
    worst = float(b.rest.max())
    for at in range(0, len(a.x), STRIP):
        rows = slice(at, min(at + STRIP, len(a.x)))
        product = a.q[rows].astype(np.float32) @ qb
        product *= column
        floor = (least - a.rest[rows] - a.size[rows] * worst - slack) / a.scale[rows]
        i, j = np.nonzero(product >= floor[:, None].astype(np.float32))
        near = product[i, j].astype(np.float64) * a.scale[rows][i]
        i = i + at
        if same:
            keep = i < j
            i, j, near = i[keep], j[keep], near[keep]
        bound = a.rest[i] + a.size[i] * b.rest[j] + slack
        maybe = near + bound >= least
        i, j, near, bound = i[maybe], j[maybe], near[maybe], bound[maybe]
        sure = near - bound >= least
        doubt = np.flatnonzero(~sure)
        for some in np.array_split(doubt, -(-len(doubt) // 100_000) or 1):
            sure[some] = (a.x[i[some]] * b.x[j[some]]).sum(1) >= least
        yield i[sure], j[sure], len(doubt)


def tile_links(a: Quantised, b: Quantised, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """All of ``strip_links`` at once."""
    left, right, doubted = zip(*strip_links(a, b, least, same), strict=True)
    return np.concatenate(left), np.concatenate(right), sum(doubted)


def _cells(pivots: np.ndarray):
    """Nearest pivot of each vector and the angle to it."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cosine = np.clip(unit(np.stack(pdf["vector"])) @ pivots.T, -1, 1)
                pdf["cell"] = cosine.argmax(1)
                pdf["angle"] = np.arccos(cosine.max(1))
                yield pdf[["rep", "copies", "vector", "cell", "angle"]]

    return cells


def _blob(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["vector"])
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "kind": [x.dtype.str]})


def _multiply(least: float):
    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for r in pdf.sort_values("tile").itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            sides.append((ids, np.frombuffer(r.copies, np.int64), Quantised(unit(np.frombuffer(r.x, r.kind).reshape(len(ids), -1)))))
        (ids_a, copies_a, a), (ids_b, copies_b, b) = sides[0], sides[-1]
        if a.x.shape[1] != b.x.shape[1]:
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        same = len(sides) == 1
        count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        child = root = np.zeros(0, np.int64)
        for i, j, _ in strip_links(a, b, least, same):
            count_a += np.bincount(i, copies_b[j], len(ids_a)).astype(np.int64)
            count_b += np.bincount(j, copies_a[i], len(ids_b)).astype(np.int64)
            child, root = forest(np.concatenate([child, ids_a[i]]), np.concatenate([root, ids_b[j]]))
        rep, links = (ids_a, count_a + count_b) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([count_a, count_b]))
        order = np.argsort(rep)
        order = order[links[order] > 0]
        rep, links = rep[order], links[order]
        to = rep.copy()
        to[np.searchsorted(rep, child)] = root
        return pd.DataFrame({"rep": rep, "links": links, "to": to})

    return multiply


def near_duplicates(vectors: DataFrame, work: Workspace, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Equal vectors are folded into one class first, so a common vector costs one row.
    Classes go to the cell of their nearest pivot, and cells split by hash into tiles
    of about ``tile`` classes. Pairs of cells too far apart for any pair within the
    threshold are left out, by the triangle inequality on angles; all other pairs of
    tiles are multiplied. A pair of tiles returns a count and one link per vector,
    and a task holds those of one strip at most, never all one by one.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without vec_id, link with nothing and stay by themselves. Vectors of other
    lengths don't compare. Rows that repeat a vec_id are vectors of their own: each
    has its own links, and its component is the smallest vec_id of the rows it
    reaches. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # A class has a number of its own, as a vec_id may repeat; a written table keeps it.
    classes = fine.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = work.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    parts = [_of_length(classes.where(F.size("vector") == r[0]), work, r[0], r[1], least, tile) for r in classes.groupBy(F.size("vector")).count().collect()]
    other = rows.where(~(usable(F.col("vector")) & F.col("vec_id").isNotNull()))
    alone = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not parts:
        return alone
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = work.write(found.groupBy("rep").agg(F.sum("links").alias("links"), F.collect_set("to").alias("to")), "links")
    joined = found.select(F.col("rep").alias("a"), F.explode("to").alias("b"))
    roots = components(joined, work)
    placed = classes.select("rep", "low", "copies").join(found.select("rep", "links"), "rep", "left").join(roots.select(F.col("id").alias("rep"), F.col("component_id").alias("root")), "rep", "left")
    placed = work.write(placed.select("rep", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "placed")
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"))
    known = join_hot(placed, smallest, "root", "classes", work, "smallest").select("rep", "n_links", "component_id")
    out = join_hot(fine, classes.select("vector", "rep", "copies").join(known, "rep"), "vector", "copies", work, "known")
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def _of_length(classes: DataFrame, work: Workspace, length: int, count: int, least: float, tile: int) -> DataFrame:
    """(rep, links, to) of the classes of one vector length, a row for each pair of tiles in which a class has links."""
    name = f"d{length}"
    # At most PIVOTS vectors, and as many cells.
    some = classes.orderBy(F.xxhash64("vector"), "rep").limit(min(PIVOTS, -(-count // tile))).collect()
    pivots = unit(np.array([r.vector for r in some]))
    ddl = f"rep long, copies long, vector {classes.schema['vector'].dataType.simpleString()}, cell int, angle double"
    placed = work.write(classes.mapInPandas(_cells(pivots), ddl), f"{name}-cells")
    cells = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}
    first, tiles = {}, {}
    total = 0
    for cell, (n, _) in sorted(cells.items()):
        k = -(-n // tile)
        first[cell], tiles[cell] = total, k
        total += k
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    meets = {c: [d for d in cells if angle[c, d] <= cells[c][1] + cells[d][1] + np.arccos(least) + 1e-6] for c in cells}
    lookup = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("cell"))
    number = lookup(first) + F.pmod(F.xxhash64("rep"), lookup(tiles)).cast("int")
    blobs = placed.withColumn("tile", number).groupBy("tile").applyInPandas(_blob, "tile int, ids binary, copies binary, x binary, kind string")
    ranges = {c: sorted(ds) for c, ds in meets.items()}
    edges = sorted((first[c], first[c] + tiles[c], c) for c in cells)
    partner = F.coalesce(*[F.when((F.col("tile") >= a) & (F.col("tile") < b), F.flatten(F.array(*[F.sequence(F.lit(first[d]), F.lit(first[d] + tiles[d] - 1)) for d in ranges[c]]))) for a, b, c in edges])
    blobs = work.write(blobs.withColumn("partner", partner), f"{name}-tiles")
    dealt = blobs.withColumn("other", F.explode("partner")).drop("partner").withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    return work.write(dealt.groupBy("low", "high").applyInPandas(_multiply(least), "rep long, links long, to long"), f"{name}-links")
