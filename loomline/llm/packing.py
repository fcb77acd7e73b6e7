"""Best-fit packing of token sequences into fixed windows, with a bounded number of open bins."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textual import slices
from .token_counts import BLOCK_BYTES, load
from .workspace import Workspace, shuffle_width

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048
OPEN_BINS = 1024
END = 0
STREAM = 50_000
REMEMBERED = 250_000
REMEMBERED_PARTS = 500_000

# The vocabulary's splitting pattern, and characters that Python's split() takes for white space but the pattern doesn't.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
NOT_WHITE = re.compile("[\x1c-\x1f]")

# The vocabulary writes each byte as a character, visible ones of Latin-1 as themselves, the others as the characters from 256 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*VISIBLE}))}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Ids of white-space separated words, as little-endian bytes; what was seen is remembered up to a bound."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if latin(word):
            low = word.lower()
            if low.isalpha():
                parts = [low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                parts = [low[:-1], low[-1]]
            else:
                parts = PATTERN.findall(low)
            out = b"".join([self.part(p) for p in parts])
        else:
            out = self.encode(word)
        self[word] = out
        return out

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            # A part has no upper case and nothing to compose, so the merges alone give its ids.
            ids = self.parts[part] = array("I", [t.id for t in self.merge(part.encode().decode("latin-1").translate(SHOWN))]).tobytes()
        return ids

    def document(self, text: str) -> bytes:
        """Ids of a whole text. White space only parts words here and lower case is by character, so words encode alone."""
        if any(s in text for s in self.special) or NOT_WHITE.search(text):
            return self.encode(text)
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, (text.lower() if latin(text) else text).split()))


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1, where composing changes nothing and lower case is one to one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: By vocabulary; a worker process that runs several tasks goes on with what it knows.
_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def _cut(path: str, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = words.document(text or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * window)):
                        piece = ids[at : at + 4 * window]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each document and an end id, cut where longer than a window."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(vocabulary, window), PIECES)


class Packer:
    """Online best-fit with at most ``most`` open bins.

    ``free`` is a bitset: bit s is set when an open bin has s tokens of space. The
    tightest bin that takes a piece is the lowest set bit at or above its length.
    When a bin must open and ``most`` are open, the fullest closes.
    """

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most = window, most
        self.free, self.bins, self.opened, self.made = 0, [[] for _ in range(window + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` tokens."""
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.window, self.made
            self.made += 1
            if length < self.window:
                if self.opened == self.most:
                    self._take((self.free & -self.free).bit_length() - 1)
                    self.opened -= 1
                self.opened += 1
        if space > length:
            self.bins[space - length].append(bin_)
            self.free |= 1 << (space - length)
        elif fit:
            self.opened -= 1
        return bin_, self.window - space

    def _take(self, space: int) -> int:
        bin_ = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return bin_


def _place(window: int, most: int):
    """Packs stream after stream of a task; each has bins of its own."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, stream = Packer(window, most), None
        for pdf in batches:
            places = []
            for s, n in zip(pdf["_stream"].tolist(), pdf["length"].tolist(), strict=True):
                if s != stream:
                    packer, stream = Packer(window, most), s
                bin_, offset = packer.place(n)
                places.append(((s << 28) + bin_, offset))
            out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = pdf["doc_id"].astype("Int64")
            yield out.assign(sequence_id=[b for b, _ in places], offset=[o for _, o in places])

    return place


def pack(cut: DataFrame, window: int = WINDOW, most: int = OPEN_BINS) -> DataFrame:
    """Pieces with their sequence_id and offset.

    Pieces are dealt by hash into streams of some STREAM, which are packed in hash
    order, many streams to a task where there are more of them than shuffle
    partitions; each stream may leave its last open bins part empty, at most
    ``most`` of them.
    """
    streams = max(1, -(-cut.count() // STREAM))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "start")
    dealt = cut.withColumns({"_key": key, "_stream": F.pmod(F.xxhash64(key), F.lit(streams))})
    tasks = min(streams, shuffle_width(cut.sparkSession))
    dealt = dealt.repartitionById(tasks, (F.col("_stream") % tasks).cast("int")).sortWithinPartitions("_stream", "_key", "doc_id", "piece", "length")
    return dealt.mapInPandas(_place(window, most), PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, work: Workspace, vocabulary: str = VOCABULARY, window: int = WINDOW, most: int = OPEN_BINS) -> DataFrame:
    """One row per piece of the documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text has the end id alone and is packed too. Repeated doc_ids are
    packed once for each row. Very long texts give many full pieces. An empty table
    gives an empty result; other columns are ignored.
    """
    return pack(work.write(pieces(docs, vocabulary, window), "pieces"), window, most)
