"""Vectorised views of a block of texts: characters, words, hashes and sums by document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
WORD64 = 1 << 64


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of its column text, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, WORD64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``codes``, equal for equal spans wherever they stand."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(BASE)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


#: Bits of an id below the partition's number: documents of a task.
TASK_BITS = 38


def first_id(partition: int) -> int:
    """The id of a task's first document; those of 2**25 partitions are apart from each other."""
    return partition << TASK_BITS


class Packs:
    """Numbers that a task's documents have in buckets, packed into a row for each bucket.

    Entries of many blocks are gathered up to ``most``, so that a row holds many of
    them whatever the number of buckets. A row lists only the documents that have
    entries in its bucket, as gaps between their numbers and counts.
    """

    FIELDS = (("bucket", pa.int32()), ("base", pa.int64()), ("kinds", pa.string()), ("gaps", pa.binary()), ("counts", pa.binary()))

    def __init__(self, buckets: int, base: int, most: int = 2_000_000) -> None:
        self.buckets, self.base, self.most = buckets, base, most
        self.size, self.held = 0, []

    def add(self, home: np.ndarray, doc: np.ndarray, **numbers: np.ndarray) -> None:
        """Entries by bucket and document (its number in the task, ascending from one call to the next), with numbers of theirs."""
        if len(home):
            self.held.append((home, doc, numbers))
            self.size += len(home)

    def full(self) -> bool:
        return self.size >= self.most

    def flush(self) -> dict[str, pa.Array]:
        """The rows so far, as columns; no rows where there are no entries."""
        held, self.size, self.held = self.held, 0, []
        if not held:
            return {}
        home, doc = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        numbers = {c: np.concatenate([h[2][c] for h in held]) for c in held[0][2]}
        order = np.lexsort([doc, home])
        home, doc = home[order], doc[order]
        low = int(doc.min())
        doc = doc - low
        rows = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        some = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (doc[1:] != doc[:-1])]))
        gap = np.diff(doc[some], prepend=0)
        begins = np.isin(some, rows, assume_unique=True)
        gap[begins] = doc[some[begins]]
        gap, count = narrow(gap), narrow(np.diff(some, append=len(home)))
        ends, by_doc = np.append(rows, len(home)), np.append(np.flatnonzero(begins), len(some))
        packed = lambda x, at: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((at * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
        out = {"bucket": pa.array(home[rows].astype(np.int32)), "base": pa.array(np.full(len(rows), self.base + low)), "kinds": pa.array([f"{gap.dtype.str} {count.dtype.str}"] * len(rows)), "gaps": packed(gap, by_doc), "counts": packed(count, by_doc)}
        return out | {c: packed(x[order], ends) for c, x in numbers.items()}


def unpacked(row: dict) -> np.ndarray:
    """The ids of the documents of a row of ``Packs``, one for each entry."""
    gaps, counts = (np.frombuffer(row[c], kind).astype(np.int64) for c, kind in zip(("gaps", "counts"), row["kinds"].split(), strict=True))
    return row["base"] + np.repeat(np.cumsum(gaps), counts)


def batch_of(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the given columns, null in the others."""
    n = len(next(iter(columns.values()), ()))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over spans, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends] - total[starts]


#: Classes of characters: bits that one table lookup gives.
LETTER, UPPER, DIGIT, SPACE, NEWLINE = 1, 2, 4, 8, 16


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: class bits, and the lower-case code point where it is a single one."""
    classes, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x32400):  # no letters, digits or spaces are defined above, but for private use
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            classes[i] = LETTER | UPPER * (low != c)
            if len(low) == 1:
                lower[i] = ord(low)
        elif c.isdigit():
            classes[i] = DIGIT
        elif c.isspace():
            classes[i] = SPACE | NEWLINE * (c == "\n")
    return classes, lower


class Block:
    """Texts joined by line ends, as code points; documents, words and lines as spans of it."""

    def __init__(self, texts: list[str | None]) -> None:
        texts = [t or "" for t in texts]
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        classes, lower = tables()
        self.classes, self.lower = classes[self.codes], lower[self.codes]

    def document(self, at: np.ndarray) -> np.ndarray:
        """The document that each position stands in."""
        return np.searchsorted(self.ends, at, "left")
