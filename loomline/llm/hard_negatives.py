"""Hard-negative mining: threshold joins that index leading dimensions, prune by remaining norms and lower their thresholds until windows fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_width

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
#: Anchors of a block: so many bytes of doubles. Rows that a task reads past a block, at least.
BLOCK_BYTES = 32_000_000
PAST = 4_096
#: Rows that are multiplied at once, and anchors.
TILE, STRIP = 4_096, 64
#: Parts of the dimensions after which candidates are pruned.
SEGMENTS = 8
#: A score that none reaches.
NEVER = 1 << 62
#: Inner products stay below this, so that sums of doubles are exact in any order.
LARGEST = float(1 << 52)


def whole(vector: Column) -> Column:
    """Components as the largest whole numbers not above SCALE times them; null for a vector that takes no part."""
    one = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < F.lit(LARGEST)))
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")) * SCALE + 1))
    return F.when(fine & (F.size(vector) > 0) & (F.size(vector) * most * most < LARGEST), one.cast("array<int>"))


class Index:
    """Rows by posting lists of segments of dimensions, the strongest dimensions first.

    ``lists[s]`` holds the rows that need segment s: those whose norm from s on could
    lift a score to the least threshold by itself. What lies behind a row's last
    needed segment isn't indexed; it counts by its norm until a candidate has
    survived, and is read from the rows then. Rows stand in order of their depth, so
    a list is a prefix of the rows.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, cuts: np.ndarray, most: np.ndarray, least: float) -> None:
        norms = rest_norms(x[:, order], cuts)
        need = (norms * most >= least).sum(1) if least > 0 else np.full(len(x), len(cuts))
        self.row = np.argsort(-need, kind="stable")
        self.depth = need[self.row]
        self.x, self.norms = x[self.row][:, order], norms[self.row]
        self.lists = [int((self.depth > s).sum()) for s in range(len(cuts))]


def rest_norms(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norms of what follows each cut; they fall from segment to segment."""
    squares = np.add.reduceat(x * x, cuts, axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


def threshold_join(a: np.ndarray, norms: np.ndarray, index: Index, cuts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is ``least`` of the anchor or more.

    Partial scores are added up segment by segment. After each, a row goes on only if
    with some anchor its partial score and the product of the remaining norms reach
    the threshold. The rest of a row behind its indexed segments is then added for
    the survivors. Sums are of whole numbers below 2**53, so they are exact in any order.
    """
    ends = [*cuts[1:].tolist(), a.shape[1]]
    rows = np.arange(index.lists[0])
    score = np.zeros((len(a), len(rows)))
    slack = 0.5  # far above what rounding of norms can take from a bound, far below a step of scores
    for s, (start, end) in enumerate(zip(cuts.tolist(), ends, strict=True)):
        if not len(rows):
            break
        score += a[:, start:end] @ index.x[rows, start:end].T
        if s + 1 < len(cuts):
            left = norms[:, s + 1, None] * index.norms[rows, s + 1] * (1 + 1e-9)
            alive = (score + left + slack >= least[:, None]).any(0)
            if not alive.all():
                rows, score = rows[alive], score[:, alive]
    i, j = np.nonzero(score >= least[:, None])
    return i, index.row[rows[j]], score[i, j].astype(np.int64)


class Best:
    """The first rows of each slot by score, ties by smaller id: running lists over all rows that pass."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.slots = k, slots
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(self.slots, bool)
        touched[slot] = True
        old = touched[self.slot]
        slot, score, id_ = (np.concatenate([held[old], new]) for held, new in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort([id_, -score, slot])
        slot, score, id_ = slot[order], score[order], id_[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.score, self.id = (np.concatenate([held[~old], new[keep]]) for held, new in ((self.slot, slot), (self.score, score), (self.id, id_)))

    def last(self) -> np.ndarray:
        """The k-th score of each slot; the least number where it has fewer."""
        count = np.bincount(self.slot, minlength=self.slots)
        lowest = np.full(self.slots, np.iinfo(np.int64).max)
        np.minimum.at(lowest, self.slot, self.score)
        return np.where(count >= self.k, lowest, np.iinfo(np.int64).min)


class Block:
    """Anchors of one block, and the windows of scores in which each looks for rows."""

    def __init__(self, x: np.ndarray, row: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.x, self.row, self.label, self.high, self.same = x, row, label, high, same
        self.low = np.where(low > high, NEVER, low)  # nothing is looked for in an empty window
        self.best = Best(low.size, k)
        self.size = np.sqrt((x * x).sum(1))

    def meet(self, x: np.ndarray, row: np.ndarray, label: np.ndarray, id_: np.ndarray) -> None:
        """A tile of rows passes: what belongs in the windows is kept.

        Each anchor starts at a high threshold, that of its windows that are full or a
        guess, and lowers it until the windows are full or it is at their lower end.
        """
        width = x.shape[1]
        order = np.argsort(-(x * x).sum(0), kind="stable")
        cuts = np.unique(np.linspace(0, width, min(SEGMENTS, width), endpoint=False).astype(int))
        norms = rest_norms(self.x[:, order], cuts)
        size = np.sqrt((x * x).sum(1)).max()
        windows = self.low.shape[1]
        slots = np.arange(self.low.size).reshape(self.low.shape)
        floor = self.floor()
        # No row of the tile lies above or below these; scores are whole numbers.
        most = np.minimum(np.ceil(self.size * size * (1 + 1e-9)), self.high.max(1, initial=0) if windows else 0)
        todo = np.flatnonzero(most >= floor)
        for at in range(0, len(todo), STRIP):
            some = todo[at : at + STRIP]
            base = np.maximum(floor[some], -np.ceil(self.size[some] * size * (1 + 1e-9)))
            top = most[some] + 1
            full = self.filled()[some]
            step = np.where(full, 0, np.maximum(1, np.ceil((top - base) / 4)))
            least = np.where(full, base, np.maximum(base, np.ceil(top - step)))
            while len(some):
                index = Index(x, order, cuts, norms[some].max(0), float(least.min()))
                i, j, score = threshold_join(self.x[some][:, order], norms[some], index, cuts, least)
                fits = (score < top[i]) & (row[j] != self.row[some[i]]) & ((label[j] == self.label[some[i]]) == self.same)
                i, j, score = i[fits], j[fits], score[fits]
                for w in range(windows):
                    inside = (score >= self.low[some[i], w]) & (score <= self.high[some[i], w])
                    self.best.add(slots[some[i[inside]], w], score[inside], id_[j[inside]])
                floor_now = np.maximum(self.floor()[some], base)
                again = (least > base) & (floor_now < least)
                some, base, step, top = some[again], floor_now[again], 2 * step[again], least[again]
                least = np.maximum(base, np.ceil(top - step))

    def filled(self) -> np.ndarray:
        return ((self.best.last() > np.iinfo(np.int64).min).reshape(self.low.shape) | (self.low == NEVER)).all(1)

    def floor(self) -> np.ndarray:
        """By anchor: the least score that can still enter one of its windows."""
        return np.maximum(self.best.last().reshape(self.low.shape), self.low).min(1, initial=NEVER).astype(np.float64)


FOUND_DDL = "anchor long, slot int, id long, score long"
FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _mine(same: bool, k: int):
    """Anchors of a block come first, then rows pass by; a task holds one block and one batch of rows."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def told() -> pa.RecordBatch:
            slot = block.best.slot
            windows = block.low.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(block.row[slot // windows]), pa.array((slot % windows).astype(np.int32)), pa.array(block.best.id), pa.array(block.best.score)], schema=FOUND)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            sides = batch.column("side").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])])) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != key:
                    if block is not None:
                        yield told()
                    key, held, block = keys[s], [], None
                part = batch.slice(s, e - s)
                if sides[s] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    both = [np.concatenate([f(p) for p in held]) for f in (lambda p: matrix(p.column("q")), *(lambda p, c=c: p.column(c).to_numpy() for c in ("row", "label")), *(lambda p, c=c: matrix(p.column(c)).astype(np.int64) for c in ("low", "high")))]
                    block, held = Block(*both, same, k), []
                for at in range(0, part.num_rows if block is not None else 0, TILE):
                    some = part.slice(at, TILE)
                    block.meet(matrix(some.column("q")), *(some.column(c).to_numpy() for c in ("row", "label", "vec_id")))
        if block is not None:
            yield told()

    return mine


def _join(rows: DataFrame, anchors: DataFrame, group: list[str], sizes: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, slot, id, score): the first ``k`` rows of each window, by anchor's row number and window's number.

    ``sizes`` has for each group the numbers of its rows and of its anchors' blocks:
    a block of anchors is dealt to ``splits`` tasks, and the group's rows, in as many
    parts, to all blocks. So a row is sent once for each block of anchors.
    """
    cast = lambda c: F.col(c).cast("int")
    splits = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / PAST), F.ceil(F.lit(4 * shuffle_width(rows.sparkSession)) / F.col("blocks")))).cast("int")
    sizes = sizes.withColumn("splits", splits)
    number = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    place = lambda to: F.pmod(F.xxhash64("row"), F.col(to)).cast("int")
    # A row for each vector length, or each length and label: Spark sends it to all tasks where it is below its broadcast limit.
    left = anchors.join(sizes, group).withColumns({"block": place("blocks"), "split": number("splits"), "side": F.lit(0)})
    right = rows.join(sizes, group).withColumns({"split": F.pmod(F.xxhash64("row", F.lit(1)), F.col("splits")).cast("int"), "block": number("blocks"), "side": F.lit(1)})
    columns = [*dict.fromkeys([*group, "label"]), "block", "split", "side", "row", "vec_id", "q", "low", "high"]
    none = F.lit(None).cast("array<bigint>")
    both = left.select(*columns).unionByName(right.withColumns({"low": none, "high": none}).select(*columns))
    both = both.withColumns({"key": F.xxhash64(*group, "block", "split"), "side": cast("side")})
    dealt = both.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "side", "row")
    found = dealt.select("key", "side", "row", "vec_id", "label", "q", "low", "high").mapInArrow(_mine(same, k), FOUND_DDL)
    first = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, work: Workspace, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    A row that ``anchors`` selects is an anchor. Its positives are the first rows of
    its own label by inner product of SCALE-fold components, rounded down; each
    positive gets the first rows of other labels whose score is between ``low`` and
    ``high`` per cent of its own. Ties go to the smaller vec_id.

    Anchors are dealt into blocks of bounded size; rows pass by each block, those of
    its label to find positives, then all. A block's thresholds start high and are
    lowered until its windows are full; from then on they rise with what is found,
    so that most rows are pruned after few dimensions. Work and traffic are those of
    the anchors against all rows, less what is pruned: a row is sent once for each
    block of anchors, and a task holds one block and one batch of rows.

    Rows whose label, vec_id or vector is null or empty, or has a null or
    non-finite component, take no part; nor do those whose scores could pass LARGEST
    (in 64 dimensions, components of 32,767 or more). Vectors of other lengths don't
    compare. Rows that repeat a vec_id are rows of their own. An anchor without rows
    of its label, or a positive without rows in its window, gives none. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("q"), anchors.alias("asks"))
    rows = rows.where("vec_id is not null and label is not null and q is not null").withColumns({"width": F.size("q"), "row": F.monotonically_increasing_id()})
    rows = work.write(rows, "rows")
    asked = rows.where("asks")
    # Bytes of an anchor as doubles.
    blocks = lambda n: F.ceil(n * F.col("width") * 8 / BLOCK_BYTES).cast("int")
    sizes = rows.groupBy("width", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).where("m > 0")
    sizes = work.write(sizes.withColumn("blocks", blocks(F.col("m"))), "label-sizes")
    whole_range = asked.withColumns({"low": F.array(F.lit(1 - NEVER).cast("long")), "high": F.array(F.lit(NEVER - 1).cast("long"))})
    found = _join(rows, whole_range, ["width", "label"], sizes.select("width", "label", "n", "blocks"), True, positives)
    found = work.write(found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    score = lambda p: p["positive_score"]
    # The least and the greatest whole number within the window of each positive.
    windows = windows.select("anchor", F.transform("p", lambda p: F.ceil(score(p) * low / F.lit(100).cast("decimal(3,0)")).cast("long")).alias("low"), F.transform("p", lambda p: F.floor(score(p) * high / F.lit(100).cast("decimal(3,0)")).cast("long")).alias("high"))
    empty = F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("low"))
    windows = windows.withColumns({"low": F.concat("low", F.transform(empty, lambda x: x + 1)), "high": F.concat("high", empty)})  # windows from 1 to 0
    all_sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).where("m > 0")
    all_sizes = work.write(all_sizes.withColumn("blocks", blocks(F.col("m"))), "sizes")
    mined = _join(rows, asked.join(windows, asked["row"] == windows["anchor"]).drop("anchor"), ["width"], all_sizes.select("width", "n", "blocks"), False, negatives)
    mined = mined.select("anchor", "slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    named = found.join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(mined, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
