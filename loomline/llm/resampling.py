"""Target-distribution importance resampling: hashed n-gram gains, by a head of frequent words and a tail hashed directly."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textual import slices
from .workspace import Workspace, shuffle_width

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
SHARE = 10
LEAST = 20
BLOCK = 8_000_000
STRETCH = 1_000_000
#: Frequent words, and frequent pairs of words, that are sent to all tasks; longer ones than LETTERS bytes stay in the tail.
HEAD = 20_000
LETTERS = 64

# A word is what stands between ASCII characters that are neither letters nor digits.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def words(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, in lists of STRETCH bytes about."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(data) - at > STRETCH and (gap := GAP.search(data, at + STRETCH)):
        yield WORD.findall(data, at, gap.start())
        at = gap.start()
    yield WORD.findall(data, at)


class States(dict):
    """CRC states of words: those of the head are known, others are worked out."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Features:
    """Buckets of all runs of 1 to ``longest`` words, joined by one space.

    A run's CRC goes on from the state of its words but the last. The head gives the
    states of frequent words and the buckets of frequent pairs; what isn't in it, and
    longer runs, are hashed directly. Both give the same bucket.
    """

    def __init__(self, states: dict[bytes, int], pairs: dict[bytes, int], longest: int, buckets: int) -> None:
        self.states, self.pairs, self.longest, self.buckets = States(states), pairs, longest, buckets

    def of(self, stretches: Iterator[list[bytes]]) -> Iterator[list[int]]:
        """Buckets of a text's features, some stretches at a time; the last words of a stretch are carried to the next."""
        buckets, carried = self.buckets, []
        for fresh in stretches:
            run = carried + fresh
            states = list(map(self.states.__getitem__, run))
            yield [s % buckets for s in states[len(carried) :]]
            for n in range(2, self.longest + 1):
                if len(run) < n:
                    break
                known = self.pairs if n == 2 else {}
                # Runs that end in a fresh word; those before were told with the stretch that they end in.
                first = max(0, len(carried) - n + 1)
                out = []
                for k in range(len(run) - n + 1):
                    bucket = known.get(run[k] + b" " + run[k + 1]) if known else None
                    states[k] = crc32(b" " + run[k + n - 1], states[k]) if bucket is None or n < self.longest else 0
                    if k >= first:
                        out.append(states[k] % buckets if bucket is None else bucket)
                yield out
            carried = run[max(0, len(run) - self.longest + 1) :] if self.longest > 1 else []


def _frequent(pairs: bool, head: int):
    """Words, or pairs of words, that are frequent in a block, with their numbers there.

    What makes up a share of 1 in 4 * ``head`` of all texts does so in one block at
    least, so a word with fewer in a block is left out of that block's list. It is a
    matter of speed: a word that the head misses is hashed directly.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0

        def told() -> pa.RecordBatch:
            least = max(2, counts.total() // (4 * head))
            some = [(w, n) for w, n in counts.items() if n >= least and len(w) <= LETTERS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, BLOCK):
                for text in part.column("text").to_pylist():
                    last: list[bytes] = []
                    for some in words(text):
                        run = last + some
                        counts.update(map(b" ".join, zip(run, run[1:], strict=False)) if pairs else some)
                        last = run[-1:] if pairs else []
                        if len(counts) > 500_000:
                            yield told()
                            counts.clear()
                size += part.column("text").nbytes
                if size > BLOCK:
                    yield told()
                    counts.clear()
                    size = 0
        if counts:
            yield told()

    return frequent


def frequent(texts: DataFrame, work: Workspace, pairs: bool, head: int = HEAD) -> list[bytes]:
    """The ``head`` words, or pairs, of most occurrences, at most; HEAD strings of LETTERS bytes on the driver."""
    found = texts.select("text").mapInArrow(_frequent(pairs, head), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = work.write(found, "pairs" if pairs else "words")
    # No more than 4 * head of them can have such a share of what all of them have, so no more are sorted or sent.
    least = (found.agg(F.sum("n")).first()[0] or 0) // (4 * head)
    found = found.where(F.col("n") >= least)
    return [bytes(r.word) for r in found.orderBy(F.col("n").desc(), "word").limit(head).collect()]


def _totals(features, buckets: int):
    """A task's number of features in each bucket that it has met."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, BLOCK):
                for text in part.column("text").to_pylist():
                    for some in features.value.of(words(text)):
                        counts.update(some)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return totals


def totals(texts: DataFrame, features, buckets: int) -> list[int]:
    """Features of all texts by bucket: a number for each of ``buckets`` on the driver."""
    out = [0] * buckets
    for r in texts.select("text").mapInArrow(_totals(features, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """By bucket: how much likelier its features are in the target than in the source, in thousandths of a nat, rounded down."""
    s_all, t_all = sum(source) + len(source), sum(target) + len(target)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)]


WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weights(features, gain):
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = gain.value.__getitem__
        for batch in batches:
            for part in slices(batch, BLOCK):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n_words = n = total = 0

                    def counted(stretches: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
                        nonlocal n_words
                        for some in stretches:
                            n_words += len(some)
                            yield some

                    for some in features.value.of(counted(words(text))):
                        n += len(some)
                        total += sum(map(gain_of, some))
                    out.append((doc_id, n_words, n, total // n if n else 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=WEIGHTS)

    return weights


def placed(rows: DataFrame, order: list, work: Workspace) -> DataFrame:
    """``rows`` with ``place``, 1, 2, 3 ... in the given order: ranges of it, the rows of the ranges before, and the place within one."""
    width = shuffle_width(rows.sparkSession)
    numbered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = work.write(numbered, "in-order").withColumn("_range", F.shiftright("_at", 33))
    # A row a range, of which there are as many as shuffle partitions.
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = work.write(numbered.groupBy("_range").agg(F.count("*").alias("n")).withColumn("before", before), "ranges")
    out = numbered.join(F.broadcast(ranges.select("_range", "before")), "_range")
    return out.withColumn("place", F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_range", "before")


def resampled(docs: DataFrame, target: DataFrame, work: Workspace, longest: int = LONGEST, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST, seed: int = SEED, head: int = HEAD) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs`` (doc_id, text).

    A document's weight is the mean gain of its features, by their buckets' totals
    in all ``docs`` and all of ``target`` (text). Its score adds Gumbel noise drawn
    from its doc_id, so that the highest ``share`` per cent of the scores of the
    documents with ``least`` words at least are a sample without replacement by
    weight; these get their rank. Both tables are counted whole, in two readings of
    the texts (three with pairs); only numbers are shuffled, and the rows are ranked
    in ranges of their order.

    Null text has no words; without features the weight is 0. Ties go to the smaller
    doc_id, null ids last: those draw the noise of an empty id. Rows that repeat a
    doc_id are scored and ranked one by one. Empty tables give an empty result, or
    totals of zero; other columns are ignored.
    """
    spark = docs.sparkSession
    docs, target = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), target.select("text")
    states = {w: crc32(w) for w in frequent(docs, work, False, head)}
    pairs = {w: crc32(w) % buckets for w in frequent(docs, work, True, head)} if longest > 1 else {}
    features = spark.sparkContext.broadcast(Features(states, pairs, longest, buckets))  # HEAD words and pairs, at most
    gain = spark.sparkContext.broadcast(gains(totals(docs, features, buckets), totals(target, features, buckets)))  # a number a bucket
    weighed = docs.mapInArrow(_weights(features, gain), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = work.write(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(drawn)))), "scored")
    fit = F.col("n_words") >= least
    taken = share * scored.where(fit).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    # Scores are whole thousandths of bounded logarithms: their number doesn't grow with the documents.
    scores = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.col("score").desc()))
    last = scores.withColumn("above", above).where(F.col("above") >= taken).agg(F.max("score")).first()[0] if taken else None
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("spread")]
    # Rows that are equal in all but their noise may be many: a number of the row's own spreads them over ranges.
    ranked = placed(scored.where(high).withColumn("spread", F.monotonically_increasing_id()), order, work)
    ranked = ranked.select(*out, F.when(F.col("place") <= taken, F.col("place")).alias("rank"))
    return scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
