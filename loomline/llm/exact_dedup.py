"""Exact dedup: binary-fuse filters over snapshots screen incoming digests, exact buckets confirm them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_width

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text whose equality counts: each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; other seeds give independent hashes."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BinaryFuse:
    """A static three-wise binary-fuse filter of 8-bit fingerprints over distinct 64-bit keys (Graf and Lemire, 2022).

    Never misses a key; passes others with probability near 1/256.
    """

    def __init__(self, seed: int, segment: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.table = seed, segment, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in three successive segments, and its fingerprint."""
        h = mix(keys, seed)
        start = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
        low = np.uint64(segment - 1)
        base = start * np.uint64(segment)
        g = mix(h, 77)
        slots = np.stack([base + (g & low), base + np.uint64(segment) + ((g >> np.uint64(20)) & low), base + np.uint64(2 * segment) + ((g >> np.uint64(40)) & low)])
        return slots.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 18))
        size = int(max(n, 2) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) + 3 * segment
        starts = max(1, -(-size // segment) - 2)
        for seed in range(1, 100):
            slots, prints = cls._slots(keys, seed, segment, starts)
            order = cls._peel(slots, (starts + 2) * segment)
            if order is not None:
                return cls(seed, segment, cls._assign(order, slots, prints, (starts + 2) * segment))
            if seed % 8 == 0:
                starts += starts // 8 + 1
        raise RuntimeError("no seed gives a peelable filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that each has for itself), all of a round at once; None where keys remain."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        ids = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(ids, row, np.arange(n))
        rounds, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                return None
            keys, first = np.unique(ids[alone], return_index=True)
            rounds.append((keys, alone[first]))
            for row in slots[:, keys]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(ids, row, keys)
            left -= len(keys)
        return rounds

    @staticmethod
    def _assign(rounds: list[tuple[np.ndarray, np.ndarray]], slots: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
        """Last peeled first: a key's own slot is free when its round comes, so that round is set at once."""
        table = np.zeros(size, np.uint8)
        for keys, own in reversed(rounds):
            table[own] = 0
            a, b, c = table[slots[:, keys]]
            table[own] = prints[keys] ^ a ^ b ^ c
        return table

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, len(self.table) // self.segment - 2)
        a, b, c = self.table[slots]
        return (a ^ b ^ c) == prints

    def dump(self) -> tuple[int, int, bytes]:
        return self.seed, self.segment, self.table.tobytes()

    @classmethod
    def load(cls, seed: int, segment: int, table: bytes) -> BinaryFuse:
        return cls(int(seed), int(segment), np.frombuffer(table, np.uint8))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, table = BinaryFuse.build(pdf["word"].to_numpy().view(np.uint64)).dump()
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "table": [table]})


def build_filters(digests: DataFrame) -> DataFrame:
    """One filter for each bucket of a snapshot's distinct digests (columns bucket, word): (bucket, seed, segment, table)."""
    return digests.select("bucket", "word").groupBy("bucket").applyInPandas(_build, "bucket int, seed long, segment long, table binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``incoming`` (bucket, word, ...) that the filter of their bucket passes; buckets without filter pass none."""

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0]
        f = right.iloc[0]
        return left[BinaryFuse.load(f["seed"], f["segment"], f["table"]).holds(left["word"].to_numpy().view(np.uint64))]

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(pick, incoming.schema)


def exact_groups(docs: DataFrame, batch: Column, work: Workspace) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    ``docs`` has doc_id and text; ``batch`` is 0 for rows of the immutable
    snapshot and 1 for incoming ones. Texts are equal when their normalised bytes
    are. The snapshot's distinct digests fill one binary-fuse filter per digest
    bucket. Incoming digests are grouped among themselves and screened by the
    filters; what passes joins the exact digests of its bucket. The texts of every
    group of two or more are then compared byte by byte, and texts that only share
    a digest are parted.

    Null text counts as empty, and empty texts are equal. Of a group the smallest
    doc_id stays, a null one only where the group has no other; rows that repeat
    both its doc_id and its text are marked kept with it. An empty table gives an
    empty result; other columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long"), batch.alias("batch"), normalised(F.col("text")).alias("norm")).withColumn("sha", F.sha2("norm", 256))
    rows = work.write(text.select("doc_id", "batch", "sha"), "digests")
    word = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    # A bucket holds at most some 100,000 digests, so a filter is built in one task's memory at any size.
    buckets = max(shuffle_width(docs.sparkSession), -(-rows.count() // 100_000))
    hashed = rows.groupBy("sha", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    hashed = work.write(hashed.withColumns({"word": word, "bucket": F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int")}), "grouped")
    snapshot, incoming = hashed.where("batch = 0"), hashed.where("batch = 1")
    passed = work.write(screen(incoming, build_filters(snapshot)), "passed")
    met = passed.join(snapshot.select("sha", F.col("n").alias("n0"), F.col("low").alias("low0")), "sha")
    met = work.write(met.select("sha", (F.col("n") + F.col("n0")).alias("group_size"), F.least("low", "low0").alias("keep_id")), "met")
    alone = hashed.join(met.select("sha"), "sha", "left_anti").select("sha", F.col("n").alias("group_size"), F.col("low").alias("keep_id"))
    groups = work.write(met.unionByName(alone), "groups")
    # Only these texts move; Spark sends the list of words to all tasks where it is below its broadcast limit, and joins by shuffle else.
    shared = work.write(groups.where("group_size > 1").select(word.alias("word")), "shared")
    again = text.withColumn("word", word).join(shared, "word", "left_semi")
    parted = again.groupBy("sha").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("sha")
    parted = work.write(parted, "parted")
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")]
    if not parted.head(1):
        return rows.join(groups, "sha").select(*out)
    exact = again.join(parted, "sha", "left_semi")
    sizes = exact.groupBy("sha", "norm").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
    rest = rows.join(parted, "sha", "left_anti").join(groups, "sha")
    return rest.select(*out).unionByName(exact.join(sizes, ["sha", "norm"]).select(*out))


def exact_unique(docs: DataFrame, batch: Column, work: Workspace) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    kept = work.write(exact_groups(docs, batch, work).where("kept").select(F.struct("doc_id", "text_sha256").alias("kept")), "kept")
    once = kept.distinct()
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    # The row as one value: no column of its own can clash with the key's.
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    left = rows.join(once, F.col("key").eqNullSafe(F.col("kept")), "left_semi")
    left = left if kept.count() == once.count() else left.dropDuplicates(["key"])
    return left.select("row.*")


def arrivals() -> Column:
    """The batch of a row in a table without one: half of the ids are the snapshot, the others arrive."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)).cast("int")
