"""Token counts without ids: pieces are counted once for each distinct pre-token and summed by frequency."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textual import batch_of, narrow, slices
from .workspace import Workspace, shuffle_width

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
BLOCK_BYTES = 16_000_000

#: Pre-tokens whose pieces a task remembers at most; beyond, it starts anew.
REMEMBERED = 2_000_000

# The white space of the vocabulary's splitting pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
AWKWARD = re.compile(f" (?:[{WHITE}]|\\Z)")
STARTS = re.compile(f" (?=[^{WHITE}])")

#: Buckets of pre-tokens, at most: a block sends a row to each, whose size would be its head alone with very many.
BUCKETS = 4_096

MADE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("kinds", pa.string()), ("per_doc", pa.binary()), ("word", pa.binary()), ("freq", pa.binary())])
MADE_DDL = "block long, bucket int, words array<string>, ids array<long>, n_bytes array<long>, kinds string, per_doc binary, word binary, freq binary"
PIECES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.string()), ("pieces", pa.binary())])


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of texts, as the vocabulary's own splitting gives them; a special token's string is one by itself."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer = load(path)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None

    def stretches(self, text: str) -> list[str]:
        """The text parted at the strings of special tokens, these included."""
        if self.between is None or not any(s in text for s in self.special):
            return [text]
        return self.between.split(text)

    def chunks(self, stretch: str) -> tuple[str, list[str]]:
        """What stands before the first inner word start, and the words after it, each without its leading space.

        The splitting pattern joins one space to a following word and otherwise never
        joins white space to anything, so a text may be parted before each space that
        a non-space follows, and the parts split alone as they do in the text.
        """
        if stretch in self.special:
            return stretch, []
        first, *rest = STARTS.split(stretch) if AWKWARD.search(stretch) else stretch.split(" ")
        return first, rest

    def pre_tokens(self, chunk: str) -> list[str]:
        plain = chunk[1:] if chunk[:1] == " " else chunk
        if chunk in self.special or (plain.isascii() and plain.isalpha()):
            return [chunk]
        return [chunk[a:b] for _, (a, b) in self.split(chunk)]


def _gather(path: str, buckets: int):
    """Per block of documents: a row with each document's frequencies, and its distinct pre-tokens in a row for each bucket."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES):
                yield from _pack(part, splitter, number, buckets)
                number += 1

    return gather


def frequencies(texts: list[str | None], splitter: Splitter) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of all texts; and document, pre-token and frequency of each that a document holds, by document.

    Chunks are counted first, and a chunk is split once for all texts.
    """
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    plain: dict[str, int] = {}
    chunks, freqs, sizes = [], [], []
    for text in texts:
        counts: Counter = Counter()
        firsts: Counter = Counter()
        for stretch in splitter.stretches(text or ""):
            first, rest = splitter.chunks(stretch)
            counts.update(rest)
            if first:
                firsts[first] += 1
        # Chunks without a leading space are numbered apart, negative for now.
        chunks.append(np.fromiter((*map(known.__getitem__, counts), *(~plain.setdefault(f, len(plain)) for f in firsts)), np.int64, len(counts) + len(firsts)))
        freqs.append(np.fromiter((*counts.values(), *firsts.values()), np.int64, len(counts) + len(firsts)))
        sizes.append(len(counts) + len(firsts))
    chunk, freq = np.concatenate([*chunks, np.zeros(0, np.int64)]), np.concatenate([*freqs, np.zeros(0, np.int64)])
    chunk = np.where(chunk < 0, len(known) + ~chunk, chunk)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    number: dict[str, int] = {}
    parts = [[number.setdefault(p, len(number)) for p in splitter.pre_tokens(c)] for c in (*(f" {w}" for w in known), *plain)]
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((p for part in parts for p in part), np.int64, int(many.sum()))
    del known, plain, parts, chunks, freqs
    begin = np.cumsum(many) - many
    each = many[chunk]
    at = np.repeat(begin[chunk] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    key = np.repeat(doc, each) * max(1, len(number)) + flat[at]
    order = np.argsort(key, kind="stable")
    key, freq = key[order], np.repeat(freq, each)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    freq = np.add.reduceat(freq, first) if len(key) else freq
    return list(number), key[first] // max(1, len(number)), key[first] % max(1, len(number)), freq


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on: mostly zeros in the later ones, which compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def joined(data: bytes, kind: str) -> np.ndarray:
    """The numbers that ``planes`` took apart."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _pack(part: pa.RecordBatch, splitter: Splitter, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
    texts = part.column("text")
    strings, doc, word, freq = frequencies(texts.to_pylist(), splitter)
    home = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in strings), np.int64, len(strings)) % buckets
    # Pre-tokens are numbered by bucket, so that what the buckets return stands in order one behind the other.
    own = np.argsort(home, kind="stable")
    place = np.empty(len(strings), np.int64)
    place[own] = np.arange(len(own))
    order = np.lexsort([place[word], doc])
    doc, word, freq = doc[order], place[word][order], freq[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    gap = np.where(first, word, np.diff(word, prepend=0))
    parts = [narrow(x) for x in (np.bincount(doc, minlength=part.num_rows), gap, freq)]
    lengths = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
    row = {"block": number, "ids": part.column("doc_id").to_pylist(), "n_bytes": lengths.to_pylist(), "kinds": " ".join(x.dtype.str for x in parts)}
    yield pa.RecordBatch.from_pylist([row | dict(zip(("per_doc", "word", "freq"), map(planes, parts), strict=True))], MADE)
    if len(strings):
        starts = np.flatnonzero(np.concatenate([[True], home[own][1:] != home[own][:-1]]))
        table = pa.array(strings, pa.string()).take(pa.array(own))
        words = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)).astype(np.int32)), table)
        yield batch_of(MADE, {"block": pa.array(np.full(len(starts), number)), "bucket": pa.array(home[own][starts].astype(np.int32)), "words": words})


def _count(path: str):
    """Pieces of each distinct pre-token of a bucket, counted when it is first met, in the order of the block that asks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        pieces: dict[str, int] = {}
        for batch in batches:
            blocks, buckets, lists = batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("words")
            out = []
            for k in range(batch.num_rows):
                words = lists[k].as_py()
                if len(pieces) > REMEMBERED:
                    pieces.clear()
                new = [w for w in words if w not in pieces]
                for at in range(0, len(new), 5000):
                    some = new[at : at + 5000]
                    pieces.update(zip(some, (len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                each = narrow(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words)))
                out.append((blocks[k], buckets[k], each.dtype.str, each.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return count


def _sum(made: pa.Table, counted: pa.Table) -> pa.Table:
    """Tokens of a block's documents: frequencies times pieces, added up by document."""
    out = []
    for row in made.to_pylist():
        rows = sorted(zip(*(counted.column(c).to_pylist() for c in ("bucket", "kind", "pieces")), strict=True))
        each = np.concatenate([*(np.frombuffer(p, kind).astype(np.int64) for _, kind, p in rows), np.zeros(0, np.int64)])
        per_doc, gap, freq = (joined(row[c], kind).astype(np.int64) for c, kind in zip(("per_doc", "word", "freq"), row["kinds"].split(), strict=True))
        ends = np.cumsum(per_doc)
        total = np.cumsum(gap)
        before = np.where(ends > per_doc, total[np.maximum(ends - per_doc - 1, 0)], 0) if len(gap) else np.zeros(len(per_doc), np.int64)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        tokens = np.concatenate([[0], np.cumsum(each[total - before[doc]] * freq)])
        out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(tokens[ends] - tokens[ends - per_doc])}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "n_bytes", "n_tokens")})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of ``docs`` (doc_id, text), as the library counts tokens.

    Documents are read in blocks of bounded size. A block's distinct pre-tokens go
    to the buckets of their hash, one for each shuffle partition and BUCKETS at
    most; a bucket counts the pieces of a pre-token once for all blocks and sends
    the numbers back, where the block's frequencies are added up with them. So a
    common word costs one entry per block, never a hot key, and what is sent doesn't
    grow with the number of buckets but for the heads of rows. A bucket remembers
    REMEMBERED pre-tokens at most, and counts anew what it meets after more.

    Null text counts as empty: no bytes, no tokens. Repeated and null doc_ids keep
    a row each. An empty table gives an empty result; other columns are ignored.
    """
    buckets = min(BUCKETS, shuffle_width(docs.sparkSession))
    work = work or Workspace(docs.sparkSession, "tokens")
    made = work.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_gather(vocabulary, buckets), MADE_DDL), "blocks")
    words = made.where("words is not null").select("block", "bucket", "words")
    counted = words.repartitionById(buckets, F.col("bucket")).mapInArrow(_count(vocabulary), "block long, bucket int, kind string, pieces binary")
    held = made.where("ids is not null").select("block", "ids", "n_bytes", "kinds", "per_doc", "word", "freq")
    return held.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def over_limit(docs: DataFrame, work: Workspace, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``token_counts`` with a flag for documents of more than ``limit`` tokens."""
    return token_counts(docs, vocabulary, work).withColumn("over_limit", F.col("n_tokens") > limit)
