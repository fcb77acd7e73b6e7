"""Suffix-array dedup: bytes of long repeated strings, by deep-shallow sorting of sampled suffixes and prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_hot
from .textual import BASE, Packs, batch_of, first_id, mix, powers, slices, unpacked
from .workspace import Workspace, shuffle_width

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
#: A gram of more occurrences is split by its windows.
HOT = 2_000
#: Anchors of a group, and strings of a bucket, about.
ANCHORS = 2_000_000
STRINGS = 20_000
BLOCK = 3_000_000
#: Bytes hashed at once, windows of hot grams of a block told apart at once, and pairs of windows compared at once: what a task holds doesn't grow with the repeats of a block.
STRETCH = 1_000_000
WARM = 500_000
PAIRS = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_sums(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sums of each byte's random number times a power of the base: differences of two give hashes of spans."""
    numbers = mix(np.arange(256, dtype=np.uint64) + np.uint64(BASE + salt))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def hashes_at(total: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return mix((total[at + width] - total[at]) * powers(len(total))[1][at])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, anchor, and the hash of the anchor's gram.

    A window is LENGTH bytes of one text. Its anchor is the first of its grams of
    GRAM bytes with the least hash, so equal windows have equal anchors at equal
    places (winnowing), and windows that follow each other mostly share theirs.
    """
    out, start = [], 0
    while start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + STRETCH, "right")) - 1)
        found = _anchors(data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
        out.append((*(x + bounds[start] for x in found[:3]), found[3]))
        start = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)
    none = np.zeros(0, np.int64)
    if not (sizes >= LENGTH).any():
        return none, none, none, none.astype(np.uint64)
    total = prefix_sums(data)
    grams = np.arange(len(data) - GRAM + 1)
    key = (hashes_at(total, grams, GRAM) >> np.uint64(32) << np.uint64(32)) | grams.astype(np.uint64)
    # Minima over REACH + 1 grams: of the rest of a stretch, and of the start of the next.
    wide = REACH + 1
    stretches = -(-len(key) // wide) + 1
    padded = np.full(stretches * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(stretches, wide)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = np.maximum(sizes - LENGTH + 1, 0)
    window = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    anchor = (np.minimum(behind[window], ahead[window + REACH]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(window)]]) - 1
    return window[new], window[last], anchor[new], hashes_at(total, anchor[new], GRAM)


def prints(data: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window; ``window`` ascends."""
    low, high = np.zeros(len(window), np.uint64), np.zeros(len(window), np.uint64)
    edges = np.searchsorted(window, np.arange(0, len(data) + STRETCH, STRETCH)).tolist()
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = data[window[a] : window[b - 1] + LENGTH]
            for out, salt in ((low, 1), (high, 2)):
                out[a:b] = hashes_at(prefix_sums(part, salt), window[a:b] - window[a], LENGTH)
    return low, high


def alike(data: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window the number of the first one with its bytes. Those of one print are compared with its first; where a print has different ones, by all their bytes."""
    order = np.lexsort([high, low])
    new = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
    first = np.empty_like(order)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    others = np.flatnonzero(first != np.arange(len(first)))
    differ = [some[(views[window[some]] != views[window[first[some]]]).any(1)] for some in np.split(others, range(PAIRS, len(others), PAIRS))]
    parted = np.flatnonzero(np.isin(first, first[np.concatenate(differ)]))
    seen: dict[tuple[int, bytes], int] = {}
    for w in parted.tolist():
        first[w] = seen.setdefault((int(first[w]), views[window[w]].tobytes()), w)
    return first


def block_bytes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer(b"".join(texts), np.uint8), bounds, texts


FOUND = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("n_bytes", pa.int64()), ("gram", pa.int64()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), *Packs.FIELDS, ("grams", pa.binary()), ("at", pa.binary())])
FOUND_DDL = "id long, doc_id long, sha string, n_bytes long, gram long, ids array<long>, places array<long>, bucket int, base long, kinds string, gaps binary, counts binary, grams binary, at binary"

#: Of a gram of more occurrences in one pack of a task, one goes to its bucket for all, so that no gram of very many occurrences gathers there.
HOT_HERE = 64
#: Added to a number in the place of an occurrence, which then stands for so many of its gram in a task's pack. Texts are shorter.
FOR_ALL = 1 << 31


def _find(buckets: int, most: int = 2_000_000, hot_here: int = HOT_HERE):
    """A row per document, a row per gram of many occurrences in a pack with all of them, and a row per bucket and pack with its anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = first_id(TaskContext.get().partitionId())
        packs, number = Packs(buckets, base, most), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram, at, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
            keep = count[inverse] <= hot_here
            if not keep.all():
                many = np.flatnonzero(~keep)
                many = many[np.argsort(inverse[many], kind="stable")]
                first = np.flatnonzero(np.diff(inverse[many], prepend=-1))
                ends = pa.array(np.append(first, len(many)).astype(np.int32))
                stands = many[first]
                yield batch_of(FOUND, {"base": pa.array(base + doc[stands]), "gram": pa.array(gram[stands].view(np.int64)), "ids": pa.ListArray.from_arrays(ends, pa.array(base + doc[many])), "places": pa.ListArray.from_arrays(ends, pa.array(at[many]))})
                keep[stands] = True
                at[stands] = FOR_ALL + count[inverse[stands]]
            gram, at, doc = gram[keep], at[keep].astype(np.uint32), doc[keep]
            packs.add(((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), doc, grams=gram, at=at)
            yield batch_of(FOUND, packs.flush())

        for batch in batches:
            for part in slices(batch, BLOCK):
                data, bounds, texts = block_bytes(part)
                shas = [hashlib.sha256(t).hexdigest() for t in texts]
                ids = part.column("doc_id").to_pylist()
                yield batch_of(FOUND, {"id": pa.array(base + number + np.arange(len(texts))), "doc_id": pa.array(ids, pa.int64()), "sha": pa.array(shas), "n_bytes": pa.array(np.diff(bounds))})
                fresh = np.zeros(len(texts), bool)
                fresh[list({s: d for d, s in reversed(list(enumerate(shas)))}.values())] = True
                _, _, anchor, gram = anchors(data, bounds)
                doc = np.searchsorted(bounds, anchor, "right") - 1
                keep = fresh[doc]  # of equal texts in a block, one is looked for
                anchor, gram, doc = anchor[keep], gram[keep], doc[keep]
                held.append((gram, anchor - bounds[doc], doc + number))
                number += len(texts)
                if sum(len(h[0]) for h in held) >= most:
                    yield from flush()
        yield from flush()

    return find


def _repeated(hot: int):
    """(id, at, hot) of the anchors whose gram occurs more than once; (id, gram, hot) of those that stand for all of their gram in a pack."""

    def repeated(table: pa.Table) -> pa.Table:
        grams, ids, at = [], [], []
        for row in table.select(["base", "kinds", "gaps", "counts", "grams", "at"]).to_pylist():
            grams.append(np.frombuffer(row["grams"], np.uint64))
            at.append(np.frombuffer(row["at"], np.uint32))
            ids.append(unpacked(row))
        gram, id_, place = np.concatenate(grams), np.concatenate(ids), np.concatenate(at).astype(np.int64)
        _, inverse = np.unique(gram, return_inverse=True)
        stands = place > FOR_ALL
        count = np.bincount(inverse, np.where(stands, place - FOR_ALL, 1))[inverse]
        keep = count > 1
        stands = stands[keep]
        return pa.table({"id": id_[keep], "at": pa.array(place[keep], mask=stands), "gram": pa.array(gram[keep].view(np.int64), mask=~stands), "hot": count[keep] > hot})

    return repeated


PARTS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("weight", pa.int32()), ("left", pa.int32()), ("bytes", pa.binary())])
PARTS_DDL = "id long, start long, end long, low long, high long, weight int, left int, bytes binary"


def _cut(strings: bool):
    """What the runs of windows of repeated anchors give.

    With ``strings``: the string that a run covers, to be sorted with others of its
    gram. Without: for hot grams, a 128-bit print of each window instead, so that
    they spread over many tasks; and the spans of what is known already, as equal
    strings, or windows of hot grams with equal bytes, stand in one block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK):
                data, bounds, _ = block_bytes(part)
                ids = part.column("id").to_numpy()
                first, last, anchor, gram = anchors(data, bounds)
                doc = np.searchsorted(bounds, anchor, "right") - 1
                lists = part.column("at")
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                wanted = bounds[owner] + lists.flatten().to_numpy()
                hot = np.zeros(len(data) + 1, np.int8)
                hot[wanted] = 1 + lists_flat(part.column("hot"))
                kind = hot[anchor]
                out = []
                seen: dict[tuple, list[int]] = {}
                whole = data.tobytes()
                for r in np.flatnonzero(kind == 1):
                    seen.setdefault((int(anchor[r] - first[r]), whole[first[r] : last[r] + LENGTH]), []).append(int(r))
                base = bounds[doc]
                for (left, string), rows in seen.items():
                    if strings:
                        r = rows[0]
                        out.append((ids[doc[r]], int(anchor[r] - base[r]), None, int(gram[r].astype(np.int64)), None, min(len(rows), 2), left, string))
                    elif len(rows) > 1:
                        out.extend((ids[doc[r]], int(first[r] - base[r]), int(last[r] + LENGTH - base[r]), None, None, None, None, None) for r in rows)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PARTS, strict=True)], schema=PARTS)
                if not strings:
                    warm = np.flatnonzero(kind == 2)
                    count = last[warm] - first[warm] + 1
                    begin = np.concatenate([[0], np.cumsum(count)])
                    for k in range(0, int(begin[-1]), WARM):
                        n = np.arange(k, min(k + WARM, int(begin[-1])))
                        run = np.searchsorted(begin, n, "right") - 1
                        yield from _warm(data, first[warm[run]] + n - begin[run], base[warm[run]], ids[doc[warm[run]]])

    return cut


def _warm(data: np.ndarray, window: np.ndarray, base: np.ndarray, id_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that have equals among the given ones, and of equal ones the first with its print."""
    low, high = prints(data, window)
    one = alike(data, window, low, high)
    times = np.bincount(one, minlength=len(one))
    start = window - base
    again = np.flatnonzero(times[one] > 1)
    if len(again):
        new = np.flatnonzero(np.concatenate([[True], (base[again[1:]] != base[again[:-1]]) | (window[again[1:]] != window[again[:-1]] + 1)]))
        stop = np.append(new[1:], len(again)) - 1
        yield batch_of(PARTS, {"id": pa.array(id_[again[new]]), "start": pa.array(start[again[new]]), "end": pa.array(start[again[stop]] + LENGTH)})
    own = np.flatnonzero(times)
    yield batch_of(PARTS, {"id": pa.array(id_[own]), "start": pa.array(start[own]), "low": pa.array(low[own].view(np.int64)), "high": pa.array(high[own].view(np.int64)), "weight": pa.array(np.minimum(times[own], 2).astype(np.int32))})


WINDOWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("window", pa.binary())])
WINDOWS_DDL = "id long, start long, low long, high long, window binary"


def _windows(every: bool):
    """The bytes of the given windows: each one with its place, or each print's different bytes once for some of a block."""

    def made(seen: dict[tuple, tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*seen.values(), strict=True), WINDOWS, strict=True)], schema=WINDOWS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK):
                seen: dict[tuple, tuple] = {}
                for id_, text, marks in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("marks"), strict=True):
                    start, low, high = (marks.values.field(c).to_pylist() for c in ("start", "low", "high"))
                    for s, a, b in zip(start, low, high, strict=True):
                        window = text[s : s + LENGTH]
                        seen[(id_, s) if every else (a, b, window)] = (id_, s, a, b, window)
                        if len(seen) >= PAIRS:
                            yield made(seen)
                            seen = {}
                if seen:
                    yield made(seen)

    return windows


def _checked(warm: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """(id, start) of the windows whose bytes, and not their print alone, stand elsewhere.

    ``warm`` has windows whose print does. The bytes of a print are compared after
    equal ones have been folded in each task; where two texts share a print, the
    windows of that print are grouped by their bytes.
    """
    marks = warm.groupBy("id").agg(F.collect_list(F.struct("start", "low", "high")).alias("marks"))
    held = texts.select("id", "text").join(marks, "id")
    parted = held.mapInArrow(_windows(False), WINDOWS_DDL).groupBy("low", "high").agg(F.min("window").alias("a"), F.max("window").alias("b")).where("a <> b")
    parted = work.write(parted.select("low", "high"), "parted")
    if not parted.head(1):
        return warm.select("id", "start")
    own = held.mapInArrow(_windows(True), WINDOWS_DDL).join(parted, ["low", "high"], "left_semi")
    again = own.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return warm.join(parted, ["low", "high"], "left_anti").select("id", "start").union(own.join(again, "window").select("id", "start"))


def lists_flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int8)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """A trie of strings that holds branch depths and branching bytes only; each string is compared once, with one leaf."""

    def __init__(self, first: bytes, number: int) -> None:
        self.root: list | tuple = (first, number)  # a leaf; an inner node is [depth, {byte or -1: node}]

    def add(self, string: bytes, number: int) -> None:
        node = self.root
        while isinstance(node, list):
            depth, below = node
            byte = string[depth] if depth < len(string) else -1
            node = below.get(byte) or next(iter(below.values()))
        lcp = common(node[0], string)
        old = node[0][lcp] if lcp < len(node[0]) else -1
        new = string[lcp] if lcp < len(string) else -1
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < lcp:
            parent, key = node, string[node[0]] if node[0] < len(string) else -1
            node = node[1][key]
        if isinstance(node, list) and node[0] == lcp:
            node[1][new] = (string, number)
            return
        branch = [lcp, {old: node, new: (string, number)}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def walk(self) -> Iterator[tuple[int, int]]:
        """(number, common prefix with the one before) in order; 0 for the first."""
        stack, depth = [(self.root, 0)], 0
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, tuple):
                yield node[1], lcp
            else:
                depth, below = node
                keys = sorted(below)
                stack.extend((below[k], depth if n else lcp) for n, k in reversed(list(enumerate(keys))))


def deep_shallow(strings: list[bytes], shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings in order, and each one's common prefix with the one before.

    Sorts by the first ``shallow`` bytes, eight at a time within what is still tied
    (a multikey quicksort on words); blind tries order the groups that share them.
    """
    n = len(strings)
    words = -(-shallow // 8)
    head = np.frombuffer(b"".join(s[:shallow].ljust(words * 8, b"\0") for s in strings), ">u8").reshape(n, words).astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for w in range(words):
        tied = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
        if not len(tied):
            break
        part = order[tied]
        by = np.lexsort([head[part, w], group[tied]])
        order[tied] = part[by]
        key = head[order, w]
        new = np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(new)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([first[1:], [n]])
    lcp = np.zeros(n, np.int64)
    for s, e in zip(first.tolist(), ends.tolist(), strict=True):
        if e - s > 1:
            trie = BlindTrie(strings[order[s]], int(order[s]))
            for k in order[s + 1 : e].tolist():
                trie.add(strings[k], k)
            found = list(trie.walk())
            order[s:e] = [k for k, _ in found]
            lcp[s:e] = [c for _, c in found]
        if s:
            lcp[s] = common(strings[order[s - 1]], strings[order[s]])
    return order, lcp


def ranked(strings: list[bytes], shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string's place among the distinct ones in order, and their common prefixes."""
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
    order, lcp = deep_shallow(list(known), shallow)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[number], lcp


def _match(table: pa.Table) -> pa.Table:
    """Spans of windows that occur more than once among the strings of a bucket's grams.

    Each string parts at its anchor. What stands before is sorted from the anchor
    backwards, what follows forwards. A window that starts o bytes before its anchor
    recurs where another string agrees in o bytes before and LENGTH - o from the
    anchor on: that is, has the same group at depth o of the one order and at depth
    LENGTH - o of the other.
    """
    left = table.column("left").to_numpy().astype(np.int64)
    strings = table.column("bytes").to_pylist()
    weight = table.column("weight").to_numpy().astype(np.int64)
    before, lcp_before = ranked([s[:a][::-1] for s, a in zip(strings, left.tolist(), strict=True)], 8)
    after, lcp_after = ranked([s[a:] for s, a in zip(strings, left.tolist(), strict=True)], GRAM)
    last = left - (np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH)  # the least o of a string; left is the largest
    id_, at = table.column("id").to_numpy(), table.column("start").to_numpy()
    rows, firsts, ends = [], [], []
    began = np.full(len(strings), -1)  # the least o of the run of hits that a string is in
    for o in range(REACH + 2):
        hit = np.zeros(len(strings), bool)
        some = np.flatnonzero((last <= o) & (o <= left))
        if len(some) and o <= REACH:
            a = np.cumsum(lcp_before < o)[before[some]] if o else np.zeros(len(some), np.int64)
            b = np.cumsum(lcp_after < LENGTH - o)[after[some]]
            _, inverse = np.unique(a * (len(lcp_after) + 1) + b, return_inverse=True)
            hit[some] = np.bincount(inverse, weight[some])[inverse] > 1
        done = np.flatnonzero(~hit & (began >= 0))
        rows.append(done)
        firsts.append(at[done] - (o - 1))
        ends.append(at[done] - began[done] + LENGTH)
        began[done] = -1
        began[hit & (began < 0)] = o
    return pa.table({"id": id_[np.concatenate(rows)], "start": np.concatenate(firsts), "end": np.concatenate(ends)})


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for sha, text, spans in zip(batch.column("sha").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            removed, places, kept, at = 0, 0, hashlib.sha256(), 0
            for s in sorted((x["start"], x["end"]) for x in spans):
                if s[0] > at or not places:
                    kept.update(text[at : s[0]])
                    removed, places, at = removed + s[1] - s[0], places + 1, s[1]
                elif s[1] > at:
                    removed, at = removed + s[1] - at, s[1]
            kept.update(text[at:])
            out.append((sha, removed, places, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["sha", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, work: Workspace, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs`` (doc_id, text).

    Removed is each byte that a string of LENGTH bytes covers which starts anywhere
    else too, in another text or the same. Texts are UTF-8, null counts as empty.

    Of equal texts of at least LENGTH bytes nothing stays, and one of them stands
    for all. Only anchors whose gram repeats go on, with the string around them, to
    the bucket of their gram; there the strings are sorted both ways from the
    anchor. Strings that repeat in a block travel once. A gram of more than ``hot``
    occurrences is split: each of its windows is a group of its own, found by a
    print, counted before and after the shuffle and compared byte by byte, so that
    no common passage gathers in one task. Occurrences are counted before they
    gather: of more than HOT_HERE in a pack of one task, one goes with their number
    and brings back whether the gram is hot. Groups and buckets number as many as
    the bytes and strings ask for.

    Short texts lose nothing. Rows that repeat a doc_id are texts of their own, and
    null doc_ids too. An empty table gives an empty result; other columns are ignored.
    """
    width = shuffle_width(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Two grams in REACH + 2 are anchors, on average.
    buckets = max(width, 2 * size // (REACH + 2) // ANCHORS)
    found = work.write(docs.mapInArrow(_find(buckets), FOUND_DDL), "anchors")
    info = found.where("id is not null").select("id", "doc_id", "sha", "n_bytes")
    packed = found.where("bucket is not null").select("bucket", "base", "kinds", "gaps", "counts", "grams", "at")
    again = work.write(packed.groupBy("bucket").applyInArrow(_repeated(hot), "id long, at long, gram long, hot boolean"), "repeated")
    many = found.where("ids is not null").select("base", "gram", F.arrays_zip("ids", "places").alias("all"))
    told = many.join(again.where("gram is not null").select(F.col("id").alias("base"), "gram", "hot"), ["base", "gram"])
    told = told.select("hot", F.explode("all").alias("one")).select(F.col("one.ids").alias("id"), F.col("one.places").alias("at"), "hot")
    again = again.where("gram is null").select("id", "at", "hot").union(told)
    again = again.groupBy("id").agg(F.collect_list("at").alias("at"), F.collect_list("hot").alias("hot"))
    copies = work.write(info.groupBy("sha").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("doc_id", "id").alias("doc_id")), "copies")
    needed = work.write(copies.join(again, "id").select("id", "sha", "doc_id", "at", "hot"), "needed")
    strings = needed.agg(F.sum(F.size("at"))).first()[0] or 0
    one = needed.select(F.struct("doc_id", "sha").alias("_key"), "id", "sha", "at", "hot")
    texts = docs.withColumn("_own", F.struct("doc_id", F.sha2("text", 256).alias("sha"))).join(one, F.col("_own").eqNullSafe(F.col("_key")))
    texts = work.write(texts.select("id", "sha", "text", "at", "hot"), "texts")
    inputs = texts.select("id", "text", "at", "hot")
    known = work.write(inputs.mapInArrow(_cut(False), PARTS_DDL), "known")
    runs = inputs.mapInArrow(_cut(True), PARTS_DDL).withColumn("bucket", F.pmod(F.xxhash64("low"), F.lit(max(4 * width, strings // STRINGS))).cast("int"))
    matched = runs.groupBy("bucket").applyInArrow(_match, "id long, start long, end long")
    windows = known.where("low is not null").select("id", "start", "low", "high", "weight")
    counted = windows.groupBy("low", "high").agg(F.sum("weight").alias("n")).where("n > 1").select("low", "high")
    warm = work.write(windows.join(counted, ["low", "high"]).select("id", "start", "low", "high"), "warm")
    spans = known.where("end is not null").select("id", "start", "end").union(matched)
    if warm.head(1):
        spans = spans.union(_checked(warm, texts, work).select("id", "start", (F.col("start") + LENGTH).alias("end")))
    spans = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cleaned = texts.select("id", "sha", "text").join(spans, "id").select("sha", "text", "spans").mapInArrow(_clean, "sha string, n_removed long, n_spans long, kept_sha256 string")
    cleaned = work.write(cleaned.dropDuplicates(["sha"]), "cleaned")
    out = join_hot(info, copies.select("sha", "copies").join(cleaned, "sha", "left"), "sha", "copies", work, "results")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
