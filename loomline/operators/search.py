"""Nearest neighbours of a stated set of queries: exact, and by an inverted-file index that is stored as a partitioned table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import usable
from .shaping import top_per_group

#: Bytes of doubles of a block of queries. Rows that a block meets in one task, about, and rows and queries that are multiplied at once.
BLOCK_BYTES = 32_000_000
ROWS = 20_000
TILE, STRIP = 4_096, 256
#: Rows that centroids and the number of probes are fitted on, and cells, at most.
SAMPLE = 50_000
CELLS = 1_024
#: Queries of the sample by which the number of probes is chosen.
TRIALS = 400
ROUNDS = 8

FOUND = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])
FOUND_DDL = "query long, neighbour long, similarity double"


def unit(column: pa.Array) -> np.ndarray:
    """Vectors as rows of length one; scaled first, so that neither tiny nor huge components under- or overflow."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Nearest:
    """The k most similar rows of each query so far, ties by smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(self.ids), STRIP):
            # Equal vectors have equal similarities wherever they stand in a product.
            score = np.round(self.x[at : at + STRIP] @ x.T, 12)
            i, j = np.nonzero(score >= self.least[at : at + STRIP, None])
            other = self.ids[at + i] != ids[j]
            i, j = i[other], j[other]
            if len(i):
                self._keep(at + i, score[i, j], ids[j])

    def _keep(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        touched = np.zeros(len(self.ids), bool)
        touched[query] = True
        old = touched[self.query]
        query, score, id_ = np.concatenate([self.query[old], query]), np.concatenate([self.score[old], score]), np.concatenate([self.id[old], id_])
        order = np.lexsort([id_, -score, query])
        query, score, id_ = query[order], score[order], id_[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.query, self.score, self.id = np.concatenate([self.query[~old], query[keep]]), np.concatenate([self.score[~old], score[keep]]), np.concatenate([self.id[~old], id_[keep]])

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.id), pa.array(self.score)], schema=FOUND)


def _pass_by(k: int):
    """The queries of a key come first, then its rows pass by; a task holds one block of queries and one batch of rows."""

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, block = None, [], None
        for batch in batches:
            keys, sides = batch.column("key").to_numpy(), batch.column("side").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])])) if len(keys) else np.zeros(0, np.int64)
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != key:
                    if block is not None:
                        yield block.found()
                    key, asked, block = keys[s], [], None
                part = batch.slice(s, e - s)
                if sides[s] == 0:
                    asked.append((part.column("id").to_numpy(), unit(part.column("x"))))
                elif asked or block is not None:
                    if block is None:
                        block, asked = Nearest(*(np.concatenate(c) for c in zip(*asked, strict=True)), k), []
                    for at in range(0, part.num_rows, TILE):
                        some = part.slice(at, TILE)
                        block.meet(some.column("id").to_numpy(), unit(some.column("x")))
        if block is not None:
            yield block.found()

    return pass_by


def _best(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, similarity) of the queries (cell, id, x) among the rows (cell, id, x) of the same cells.

    A cell's queries fall in blocks of bounded size, and its rows in parts; each
    block meets each part in a task. So a cell that holds most of the rows, or that
    most queries ask, spreads over many tasks.
    """
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A row a cell: Spark sends these to all tasks where they are below its broadcast limit.
    sizes = asked.groupBy("cell").agg(F.count("*").alias("m"), F.max(F.size("x")).alias("dim")).join(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    blocks = F.ceil(F.col("m") * F.col("dim") * 8 / BLOCK_BYTES).cast("int")
    sizes = sizes.select("cell", blocks.alias("blocks"), F.least(F.ceil(F.col("n") / ROWS), F.greatest(F.lit(1), F.ceil(F.lit(4 * width) / blocks))).cast("int").alias("parts"))
    deal = lambda to, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    left = asked.join(sizes, "cell").withColumns({"block": deal("blocks", 0), "part": every("parts"), "side": F.lit(0)})
    right = rows.join(sizes, "cell").withColumns({"part": deal("parts", 1), "block": every("blocks"), "side": F.lit(1)})
    both = left.unionByName(right).select(F.xxhash64("cell", "block", "part").alias("key"), "side", "id", "x")
    found = both.repartition(width, "key").sortWithinPartitions("key", "side", "id").mapInArrow(_pass_by(k), FOUND_DDL)
    return top_per_group(found, ["query"], [F.col("similarity").desc(), F.col("neighbour")], k)


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))


def nearest_neighbours(vectors: DataFrame, queries: Column, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbour, similarity): the k rows of highest cosine for each row that ``queries`` selects, itself left out.

    Queries fall in blocks of bounded size, and all rows pass by each block once.
    Ties go to the smaller key; similarities are rounded to 12 digits first. Vectors
    that are null, empty, zero or hold a null or non-finite component, and rows
    without a key, neither ask nor answer; vectors of other lengths don't compare.
    Rows that repeat a key aren't each other's neighbours. Fewer rows than k are all
    returned.
    """
    cell = F.size("x").alias("cell")
    return _best(_rows(vectors.where(queries), key, vector).select(cell, "id", "x"), _rows(vectors, key, vector).select(cell, "id", "x"), k)


def fit_centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample of unit vectors: k-means by cosine, seeded with rows far from each other."""
    centroids = x[:1]
    nearest = x @ x[0]
    for _ in range(min(cells, len(x)) - 1):
        far = int(nearest.argmin())
        centroids = np.concatenate([centroids, x[far : far + 1]])
        nearest = np.maximum(nearest, x @ x[far])
    for _ in range(ROUNDS):
        cell = (x @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, x)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        centroids = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centroids)
    return centroids


def fit_probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells that hold the share ``recall`` of the k nearest of the sample's first rows, on average."""
    trials = x[:TRIALS]
    score = trials @ x.T
    score[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    near = np.argsort(-score, 1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(trials @ centroids.T), 1)
    place = np.argsort(order, 1)  # of each cell in a trial's order
    home = (x @ centroids.T).argmax(1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(centroids)


def _assign(centroids: np.ndarray, probes: int):
    """Each row once for each of the ``probes`` cells whose centroids are nearest."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                some = batch.slice(at, TILE)
                score = unit(some.column("x")) @ centroids.T
                cell = np.argsort(-score, 1, kind="stable")[:, :probes] if probes > 1 else score.argmax(1)[:, None]
                row = pa.array(np.repeat(np.arange(some.num_rows), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column("id").take(row), some.column("x").take(row), pa.array(cell.ravel().astype(np.int32))], ["id", "x", "cell"])

    return assign


@dataclass
class VectorIndex:
    """An inverted file: a table of all rows, a folder a cell, and the centroids that tell which cells a query asks."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int

    def rows(self) -> DataFrame:
        """(id, x, cell); a filter on cell reads the folders of these cells alone."""
        return self.spark.read.schema("id long, x array<double>, cell int").parquet(f"{self.path}/cells")

    def add(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Put more rows into their cells; centroids and probes stay as they are."""
        rows = _rows(vectors, key, vector).where(F.size("x") == self.centroids.shape[1])
        placed = rows.mapInArrow(_assign(self.centroids, 1), "id long, x array<double>, cell int")
        # A frequent cell is written by several tasks.
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query, neighbour, similarity): up to k rows of the nearest cells of each query, the row of its own key left out."""
        asked = _rows(queries, key, vector).where(F.size("x") == self.centroids.shape[1])
        asked = asked.mapInArrow(_assign(self.centroids, probes or self.probes), "id long, x array<double>, cell int")
        wanted = sorted(r.cell for r in asked.select("cell").distinct().collect())  # CELLS numbers at most
        return _best(asked.select("cell", "id", "x"), self.rows().where(F.col("cell").isin(wanted)).select("cell", "id", "x"), k)


def build_index(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10, sample: int = SAMPLE) -> VectorIndex:
    """An index of all usable rows of ``vectors``, stored under ``path``.

    Centroids are fitted on the first ``sample`` rows in hash order, and so is the
    number of cells that a query asks: the least that holds the share ``recall`` of
    the ``k`` nearest there. All rows are then dealt to the cell of their nearest
    centroid. Vectors that can't be compared, as in ``nearest_neighbours``, and those
    of another length than most of the sample aren't held. The number of cells is
    the root of the number of rows, CELLS at most.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, key, vector)
    # At most ``sample`` vectors on the driver.
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    lengths = np.array([len(v) for v in some.column("x")], np.int64)
    width = int(np.bincount(lengths).argmax()) if len(lengths) else 1
    x = unit(some.column("x").combine_chunks().filter(pa.array(lengths == width))) if len(lengths) else np.ones((1, 1))
    cells = cells or int(np.clip(np.ceil(np.sqrt(rows.count())), 1, CELLS))
    centroids = fit_centroids(x, cells)
    index = VectorIndex(spark, path, centroids, fit_probes(x, centroids, k, recall))
    meta = spark.createDataFrame([(json.dumps({"probes": index.probes, "centroids": centroids.tolist()}),)], "value string")
    meta.write.text(f"{path}/meta")
    spark.createDataFrame([], "id long, x array<double>, cell int").write.mode("append").parquet(f"{path}/cells")
    index.add(vectors, key, vector)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was stored before."""
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)
    return VectorIndex(spark, path, np.array(meta["centroids"]), meta["probes"])
