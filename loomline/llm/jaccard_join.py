"""N-gram Jaccard join: parity sketches, a pigeonhole join of their segments per size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hot import join_hot
from .textual import Packs, batch_of, first_id, mix, runs, slices, span_hashes, unpacked
from .workspace import Workspace, shuffle_width

SHINGLE = 5
COUNTERS = 1 << 20
PARTS = 16
BLOCK = 1_000_000
CLUSTER = 8_192
#: At least so many buckets of keys: a bucket tells of a pair once, and with few buckets the pairs told grew with their number.
BUCKETS = 128
#: Keys that a bucket holds, and members of clusters that a group of comparisons holds, about.
KEYS = 4_000_000
MEMBERS = 20_000
#: Bits of the filter of wanted documents: eight a document, within these bounds.
FILTER = (1 << 20, 1 << 27)

#: By byte: white space that parts words.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each, and bounds by text.

    Words are what stands between ASCII white space, A-Z lower-cased. A text of
    fewer than five words is one shingle; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    starts, stops = runs(~WHITE[data])
    word = span_hashes(data, starts, stops)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    size = np.diff(bounds)
    out = [np.zeros(0, np.uint64)] * len(texts)
    base = np.uint64(0xD6E8FEB86659FD93)
    for d in range(len(texts)):
        n = size[d]
        if not n:
            continue
        w = word[bounds[d] : bounds[d + 1]]
        wide = min(int(n), SHINGLE)
        h = np.full(n - wide + 1, wide, np.uint64)
        for k in range(wide):
            h = h * base + w[k : n - wide + 1 + k]
        out[d] = np.unique(mix(h))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(h) for h in out], dtype=np.int64)])


def prints(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set, the same for equal sets."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    both = np.stack([total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]], 1)
    return [row.tobytes() for row in both]


def band(n: np.ndarray) -> np.ndarray:
    """Sizes [2**j, 2**(j+1)) make up band j."""
    return np.log2(np.maximum(n, 1) + 0.5).astype(np.int64)


def folded(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's parity sketch: a bit per hash value modulo its length, flipped by every shingle that falls on it."""
    n = np.diff(bounds)
    bits = np.maximum(64, 4 << band(n))
    at = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(n)), n)
    flips = np.bincount(at[doc] + (h & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=at[-1]) & 1
    packed = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [packed[at[d] // 8 : at[d + 1] // 8] for d in range(len(n))]


def fold(sketch: bytes, length: int) -> np.ndarray:
    """A sketch of a smaller power of two bits, as the larger one's parts flipped onto each other."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, length // 8), axis=0)


def fold_all(sketches: list[bytes], length: int) -> np.ndarray:
    """``fold`` of sketches of one length, a row each. The Hamming distance of two sketches of a length is at most the size of the sets' symmetric difference."""
    words = np.frombuffer(b"".join(sketches), np.uint64)
    return np.bitwise_xor.reduce(words.reshape(len(sketches), -1, length // 8), axis=1)


def segment_keys(h: np.ndarray, bounds: np.ndarray, heavy: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch segments that each set is found by, in its own band (up=0) or the next (up=1), and bounds.

    Here a sketch has a bit for every hash value, in k segments by the value's high
    bits. Sets A and B with J >= 0.75 differ in at most (|A|+|B|)/7 <= |A|/3 shingles,
    so at most r = |A|/3 segments differ. Ordered by one rule for all sets, the
    first r+1 segments of A and of B then have one in common (the pigeonhole).
    The rule depends on a segment's bits alone: those with most shingles that
    aren't frequent come first, so that passages which many documents share, and
    empty segments, are hardly ever needed.
    """
    n = np.diff(bounds)
    j = band(n) + up
    active = n > 0
    if up:  # a larger partner lies in the next band only if it is within 4/3 of this size
        active &= 4 * n >= 3 * (1 << j)
    k = np.where(active, 3 * (1 << j) // 2 + 1, 0)
    prefix = np.where(active, n // 3 + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    use = active[doc]
    doc, h = doc[use], h[use]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    at = np.concatenate([[0], np.cumsum(k)])
    slot = at[doc] + (((h >> np.uint64(32)) * k[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, h, doc = slot[order], h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    light = np.add.reduceat((~heavy[(h >> np.uint64(44)).astype(np.int64)]).astype(np.int64), first)
    bits = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), first)
    slot, doc = slot[first], doc[first]
    spare = np.flatnonzero(np.bincount(doc, minlength=len(n)) < prefix)
    if len(spare):  # too few segments with bits: empty ones are in the first r+1 as well
        empty = np.concatenate([np.setdiff1d(np.arange(at[d], at[d + 1]), slot[doc == d])[: prefix[d]] for d in spare])
        slot, light, bits = np.concatenate([slot, empty]), np.concatenate([light, np.full(len(empty), -1)]), np.concatenate([bits, np.zeros(len(empty), np.uint64)])
        doc = np.searchsorted(at, slot, "right") - 1
    key = mix(bits ^ mix((j[doc].astype(np.uint64) << np.uint64(48)) + (slot - at[doc]).astype(np.uint64)))
    rank = np.where(light < 0, 63, 62 - np.minimum(light, 62)).astype(np.uint64)
    tie = np.where(light < 0, (slot - at[doc]).astype(np.uint64), key >> np.uint64(26))
    order = np.lexsort([(rank << np.uint64(38)) | tie, doc])
    doc, key = doc[order], key[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    keep = place < prefix[doc]
    return key[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


COUNTED = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for some in slices(batch, BLOCK):
            h, _ = shingles(some.column("text").to_pylist())
            counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
    if counts.any():
        yield pa.RecordBatch.from_pylist([{"part": k, "counts": c.astype(np.uint32).tobytes()} for k, c in enumerate(np.split(counts, PARTS))], COUNTED)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})


def frequent(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Bits by the top 20 bits of a shingle's hash: whether far more documents than usual hold one of these; and the number of shingles.

    Counted over all documents into a fixed number of counters. It only orders
    segments: a wrong bit costs candidates, never a link.
    """
    found = docs.select("text").mapInArrow(_frequencies, "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary")
    counts = np.zeros(COUNTERS)
    for r in found.collect():  # COUNTERS numbers in all
        counts[r.part * (COUNTERS // PARTS) : (r.part + 1) * (COUNTERS // PARTS)] = np.frombuffer(r.counts, np.uint32)
    usual = counts.mean()
    return counts > usual + 8 * np.sqrt(usual) + 32, int(counts.sum())


SKETCHES = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("sketch", pa.binary()), ("key", pa.int64()), ("members", pa.list_(pa.int64())), *Packs.FIELDS, ("keys", pa.binary()), ("whole", pa.binary())])
SKETCHES_DDL = "id long, doc_id long, n long, print binary, sketch binary, key long, members array<long>, bucket int, base long, kinds string, gaps binary, counts binary, keys binary, whole binary"

#: A key of more documents in one pack of a task: its first one goes to the key's bucket for all, so that no key of very many documents gathers there.
HOT_HERE = 64


def _sketch(held, buckets: int, most: int = 2_000_000, hot_here: int = HOT_HERE):
    """A row per document with its sketch, a row per key that many documents of a pack hold, and a row per bucket and pack with segment keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(held.value).astype(bool)
        base = first_id(TaskContext.get().partitionId())
        packs, number = Packs(buckets, base, most), 0
        entries: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not entries:
                return
            key, doc = (np.concatenate(c) for c in zip(*entries, strict=True))
            entries.clear()
            if not len(key):  # no document of the pack has words and an id
                return
            order = np.lexsort([doc, key])
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[new], doc[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(first, append=len(key))
            many = np.repeat(count > hot_here, count)
            stands = np.zeros(len(key), np.uint8)
            stands[first[count > hot_here]] = 1
            if many.any():
                sizes = count[count > hot_here]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(base + doc[many]))
                yield batch_of(SKETCHES, {"key": pa.array(key[stands > 0].view(np.int64)), "base": pa.array(base + doc[stands > 0]), "members": lists})
            keep = ~many | (stands > 0)
            key, doc, stands = key[keep], doc[keep], stands[keep]
            packs.add(((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), doc, keys=key, whole=stands)
            yield batch_of(SKETCHES, packs.flush())

        for batch in batches:
            for some in slices(batch, BLOCK):
                ids = some.column("doc_id").to_pylist()
                h, bounds = shingles(some.column("text").to_pylist())
                n = np.diff(bounds)
                print_of = prints(h, bounds)
                seen, fresh = {}, np.zeros(len(n), bool)
                sketches = folded(h, bounds)
                for d, doc_id in enumerate(ids):
                    fresh[d] = bool(n[d]) and doc_id is not None and seen.setdefault(print_of[d], d) == d
                columns = {"id": pa.array(base + number + np.arange(len(n))), "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n.astype(np.int64))}
                columns |= {"print": pa.array([p if m else None for p, m in zip(print_of, n, strict=True)], pa.binary()), "sketch": pa.array([x if f else None for x, f in zip(sketches, fresh, strict=True)], pa.binary())}
                yield batch_of(SKETCHES, columns)
                # Of equal sets in a block, one is looked for, that of a row with an id.
                keep = fresh[np.repeat(np.arange(len(n)), n)]
                kept = np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))])
                for up in (0, 1):
                    key, at = segment_keys(h[keep], kept, heavy, up)
                    entries.append((key, number + np.repeat(np.arange(len(n)), np.diff(at))))
                number += len(n)
                if sum(len(k) for k, _ in entries) >= most:
                    yield from flush()
        yield from flush()

    return sketch


def _meet(table: pa.Table) -> pa.Table:
    """Links of all sets that share a key to the first of them, each once; with the key, where the set stands for others of its pack."""
    keys, ids, whole = [], [], []
    for row in table.select(["base", "kinds", "gaps", "counts", "keys", "whole"]).to_pylist():
        keys.append(np.frombuffer(row["keys"], np.uint64))
        whole.append(np.frombuffer(row["whole"], np.uint8))
        ids.append(unpacked(row))
    key, id_, stands = np.concatenate(keys), np.concatenate(ids), np.concatenate(whole) > 0
    order = np.lexsort([id_, key])
    key, id_, stands = key[order], id_[order], stands[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    star = np.repeat(id_[first], np.diff(first, append=len(key)))
    pairs = np.unique(np.stack([star, id_], 1)[(star != id_) & ~stands], axis=0)
    a, b = np.concatenate([pairs[:, 0], star[stands]]), np.concatenate([pairs[:, 1], id_[stands]])
    of = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), key[stands].view(np.int64)]), mask=np.arange(len(a)) < len(pairs))
    return pa.table({"a": a, "b": b, "key": of})


def stars_of(made: DataFrame, work: Workspace) -> DataFrame:
    """(a, b): all sets that share a key with the first of them, each pair once."""
    packed = made.where("bucket is not null").select("bucket", "base", "kinds", "gaps", "counts", "keys", "whole")
    met = work.write(packed.groupBy("bucket").applyInArrow(_meet, "a long, b long, key long"), "met-keys")
    pairs = met.where("key is null").select("a", "b")
    if met.where("key is not null").head(1):
        hubs = met.where("key is not null").select("key", F.col("b").alias("base"), "a")
        pairs = pairs.union(made.where("members is not null").select("key", "base", "members").join(hubs, ["key", "base"]).select("a", F.explode("members").alias("b")).where("a <> b"))
    return pairs.distinct()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow a link, all of a batch whose sketches have the same lengths at once."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        batch = batch.filter(pa.array(4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)))
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        far = np.zeros(len(na), np.int64)
        wide = np.stack([pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("sa", "sb")], 1)
        for x, y in np.unique(wide, axis=0).tolist():
            some = np.flatnonzero((wide[:, 0] == x) & (wide[:, 1] == y))
            for at in np.array_split(some, -(-len(some) * (x + y) // BLOCK)):
                a, b = (fold_all(batch.column(c).take(pa.array(at)).to_pylist(), min(x, y)) for c in ("sa", "sb"))
                far[at] = np.bitwise_count(a ^ b).sum(1)
        near_ = pa.array(7 * far <= na + nb)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near_), batch.column("b").filter(near_), pa.array(far).filter(near_)], ["a", "b", "d"])


def near(a: DataFrame, infos: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sets whose sizes and sketches allow a link, with their Hamming distance."""
    left = infos.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("print").alias("pa"))
    right = infos.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("print").alias("pb"))
    joined = a.join(left, "a").join(right, "b").where("pa <> pb").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(_judge, "a long, b long, d long")


def _sets(held):
    """Shingle sets of the documents whose bit is set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for some in slices(batch, BLOCK):
                h, bounds = shingles(some.column("text").to_pylist())
                found = [h[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(prints(h, bounds), pa.binary()), pa.array(found, pa.binary())], ["doc_id", "print", "set"])

    return sets


def _bits(size: int):
    """The bits of a part of the filter that are set."""

    def bits(table: pa.Table) -> pa.Table:
        held = np.zeros(size // PARTS, np.uint8)
        held[table.column("place").to_numpy() % (size // PARTS)] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    return bits


def sets_of(ids: DataFrame, docs: DataFrame, infos: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, set) for the given ids, from the texts again.

    A filter keeps the texts from being shuffled: tasks make sets of documents
    whose bit is set, and the exact join is of sets alone. Its size follows from
    the number of ids up to a bound of 16 MB; a fuller filter would only make more
    sets than needed, those of all documents at worst.
    """
    needed = work.write(ids.distinct().join(infos.select("id", "doc_id", "print"), "id"), f"{name}-needed")
    size = int(np.clip(1 << (8 * needed.count()).bit_length(), *FILTER))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    places = needed.select(place("doc_id").alias("place")).distinct().withColumn("part", F.floor(F.col("place") / (size // PARTS)).cast("int"))
    parts = {r.part: r.bits for r in places.groupBy("part").applyInArrow(_bits(size), "part int, bits binary").collect()}
    held = docs.sparkSession.sparkContext.broadcast(b"".join(parts.get(k, bytes(size // PARTS // 8)) for k in range(PARTS)))
    made = docs.where("doc_id is not null").withColumn("place", place("doc_id")).mapInArrow(_sets(held), "doc_id long, print binary, set binary")
    return work.write(needed.join(made, ["doc_id", "print"]).select("id", "set"), f"{name}-sets")


def shared(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of each pair, and of what both hold."""
    n = len(x)
    size = np.fromiter((len(s) // 8 for s in [*x, *y]), np.int64, 2 * n)
    pair = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), size)
    h = np.frombuffer(b"".join([*x, *y]), np.uint64)
    order = np.lexsort([h, pair])
    pair, h = pair[order], h[order]
    return size[:n], size[n:], np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=n)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        long_ = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y")))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(long_, (long_[at - 1] if at else 0) + 2 * BLOCK, "right")))
            some = batch.slice(at, stop - at)
            a, b, both = shared(some.column("x").to_pylist(), some.column("y").to_pylist())
            yield some.select(["a", "b"]).filter(pa.array((both > 0) & (100 * both >= 75 * (a + b - both))))
            at = stop


def verified(pairs: DataFrame, sets: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs whose shingle sets meet the threshold exactly."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return work.write(both.mapInArrow(_verify, "a long, b long"), f"{name}-links")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, d) of each set one of the least distance."""
    both = pairs.select("a", "b", "d").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    return both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def _across(best: bool):
    """Pairs of a cluster in different components whose sketches allow a link, for all clusters of a bucket, each once.

    With ``best``, of each member outside its cluster's largest component only the nearest.
    """

    def across(table: pa.Table) -> pa.Table:
        low, p, q, part, comp, n, id_ = (table.column(c).to_numpy() for c in ("low", "p", "q", "part", "comp", "n", "id"))
        order = np.lexsort([id_, n, q, p, low])
        low, p, q, part, comp, n, id_ = (x[order] for x in (low, p, q, part, comp, n, id_))
        sketches = table.column("sketch").to_pylist()
        sketches = [sketches[k] for k in order.tolist()]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        pairs: set[tuple[int, int]] = set()
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(low)], strict=True):
            pairs.update(_cluster(n[s:e], comp[s:e], part[s:e] if p[s] != q[s] else np.arange(e - s), id_[s:e], sketches[s:e], best))
        flat = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return pa.table({"a": flat[:, 0], "b": flat[:, 1]})

    return across


def _cluster(n: np.ndarray, comp: np.ndarray, part: np.ndarray, id_: np.ndarray, sketches: list[bytes], best: bool) -> Iterator[tuple[int, int]]:
    """Allowed pairs of ids; members of the largest component only meet the others. ``n`` ascends."""
    _, index, count = np.unique(comp, return_inverse=True, return_counts=True)
    minor = index != count.argmax()
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    folds: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(minor).tolist():
        start, stop = int(np.searchsorted(4 * n, 3 * n[i], "left")), int(np.searchsorted(3 * n, 4 * n[i], "right"))
        at = np.arange(start, stop)
        at = at[(comp[start:stop] != comp[i]) & (part[start:stop] != part[i]) & (best | ~minor[start:stop] | (at > i))]
        found, far_ = [], []
        for length in np.unique(np.minimum(size[at], size[i])).tolist():
            if length not in folds:
                folds[length] = np.stack([fold(x, length) if len(x) >= length else np.zeros(length // 8, np.uint64) for x in sketches])
            some = at[np.minimum(size[at], size[i]) == length]
            far = np.bitwise_count(folds[length][some] ^ folds[length][i]).sum(1).astype(np.int64)
            hit = 7 * far <= n[i] + n[some]
            found.append(some[hit])
            far_.append(far[hit])
        hits = np.concatenate([*found, at[:0]])
        if best and len(hits):
            hits = hits[[np.concatenate(far_).argmin()]]
        for k in id_[hits].tolist():
            yield min(int(id_[i]), k), max(int(id_[i]), k)


def across(stars: DataFrame, label: DataFrame, infos: DataFrame, work: Workspace, name: str, best: bool) -> DataFrame | None:
    """Pairs (a, b) of the clusters that hold more than one component (label: id, comp), each pair once; None where there is no such cluster."""
    members = stars.select(F.col("a").alias("low"), F.col("b").alias("id")).union(stars.select(F.col("a").alias("low"), F.col("a")).distinct())
    members = members.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = members.groupBy("low").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size")).where("least <> most")
    mixed = work.write(mixed.select("low", "size", F.ceil(F.col("size") / CLUSTER).cast("int").alias("parts")), f"{name}-mixed")
    copies = mixed.agg(F.sum(F.col("size") * F.col("parts"))).first()[0]
    if copies is None:
        return None
    groups = max(shuffle_width(stars.sparkSession), -(-copies // MEMBERS))
    dealt = members.join(mixed.select("low", "parts"), "low").join(infos.select("id", "n", "sketch"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("low", "p", "q"), F.lit(groups)).cast("int")).select("bucket", "low", "p", "q", "part", "comp", "n", "id", "sketch")
    return dealt.groupBy("bucket").applyInArrow(_across(best), "a long, b long").distinct()


def _of_classes(stars: DataFrame, infos: DataFrame, work: Workspace) -> DataFrame:
    """``stars`` between the first ids of each print, so that a set which stands in many blocks is compared once."""
    first = infos.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    other = work.write(join_hot(infos.select("id", "print"), first, "print", "size", work, "classes").where("id <> first").select("id", "first"), "others")
    for end in ("a", "b"):
        stars = stars.join(other.select(F.col("id").alias(end), "first"), end, "left").withColumn(end, F.coalesce("first", end)).select("a", "b")
    return stars.where("a <> b").distinct()


def labelled(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, comp) of all that ``links`` join, each component's smallest included."""
    found = components(links, work, f"{name}-cc")
    return work.write(found.select("id", F.col("component_id").alias("comp")).union(found.select("component_id", "component_id").distinct()), f"{name}-labels")


def similar_components(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Documents with equal shingle sets form a class by a 128-bit print, and the first
    of each stands for it. Sets that share a segment's key make up a cluster around
    the first of them. Each set's nearest link to such a first one is checked
    exactly. What is then joined needs no further check; in clusters that still
    hold several components, pairs across these are compared by sketch, and those
    within the bound are checked: each set's nearest first, then all that are still
    apart. So many near copies of one text cost about their number, and no link
    between components is lost. Clusters of more than CLUSTER members are compared
    in parts, two at a time. The buckets of keys and the groups of clusters number
    as many as the rows ask for.

    Null text and text without words have no shingles and link with nothing. Rows
    with a null doc_id have a null component. Repeated doc_ids share a component
    when any of their rows link; each row keeps its own count. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy, total = frequent(docs)
    # A set has at most two keys, one in its own band and one in the next, for every third shingle.
    width = max(BUCKETS, shuffle_width(spark), total * 2 // 3 // KEYS)
    held = spark.sparkContext.broadcast(np.packbits(heavy))  # COUNTERS bits
    made = work.write(docs.mapInArrow(_sketch(held, width), SKETCHES_DDL), "sketches")
    rows = made.where("id is not null").select("id", "doc_id", "n", "print", "sketch")
    infos = rows.where("sketch is not null and doc_id is not null")
    stars = work.write(stars_of(made, work), "met")
    stars = work.write(_of_classes(stars, infos, work), "stars")
    tested = work.write(nearest(near(stars, infos)), "first-pairs")
    sets = sets_of(tested.select(F.col("a").alias("id")).union(tested.select("b")), docs, infos, work, "first")
    links = verified(tested, sets, work, "first")
    label = labelled(links, work, "first")
    for name, best in (("second", True), ("third", False)):
        pairs = across(stars, label, infos, work, name, best)
        if pairs is None:
            break
        pairs = work.write(pairs.join(tested, ["a", "b"], "left_anti"), f"{name}-pairs")
        if pairs.head(1):
            sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, infos, work, name)
            links = work.write(links.union(verified(pairs, sets, work, name)), f"{name}-all-links")
            tested = tested.union(pairs)
            label = labelled(links, work, name)
    known = rows.where("doc_id is not null and n > 0").select("id", "doc_id", "print")
    # Each row meets the least doc_id of its component, and of its print: stars, whose hubs may hold very many rows.
    ends = []
    for name, group in (("by-link", known.join(label, "id").select("doc_id", F.col("comp").alias("of"))), ("by-print", known.select("doc_id", F.col("print").alias("of")))):
        least = group.groupBy("of").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
        ends.append(join_hot(group, least, "of", "size", work, name).select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    roots = components(ends[0].union(ends[1]), work, "all-cc")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` with the smallest doc_id of each component, all columns kept; rows with a null doc_id stay."""
    gone = similar_components(docs, work).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(work.write(gone, "gone"), F.col("id") == F.col("gone"), "left_anti").select("row.*")
