"""Cost-balanced packing: documents in descending order go to the sequence of the least attention cost that has room."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textual import slices
from .token_counts import STARTS, Splitter
from .workspace import Workspace

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 1024
END = 0
#: The linear work of a token, counted in tokens attended to: six times a model's width.
LINEAR = 6 * 1024
#: Bytes of text that are packed together, and characters of a long text that are encoded at once.
BLOCK = 8_000_000
STRETCH = 1_000_000
#: Words that are left to the tokenizer, whose work on a word doesn't grow with its square.
LONG_WORD = re.compile(r"[^ ]{1000}")

PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECES_DDL = ", ".join(f"{f.name} long" for f in PIECES)


def cost(tokens: int, linear: int = LINEAR) -> int:
    """Work on a piece whose tokens attend to each other."""
    return tokens * (linear + tokens)


class Ids:
    """Token ids of whole texts, as little-endian bytes.

    The merges run over the vocabulary's rank file where it stands beside it (the
    same vocabulary, much faster on words that haven't been met; the tests hold both
    equal over all characters); strings of special tokens, very long words and
    vocabularies without a rank file go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.splitter = Splitter(path)
        ranks = Path(path).with_suffix(".tiktoken")
        self.merge = None
        if ranks.exists():
            pairs = (line.split() for line in ranks.read_bytes().splitlines())
            self.merge = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary

    def stretches(self, text: str) -> Iterator[str]:
        """A text in parts that encode alone: cut at strings of special tokens, and between words every STRETCH characters about."""
        for stretch in self.splitter.stretches(text):
            at = 0
            while len(stretch) - at > STRETCH and (cut := STARTS.search(stretch, at + STRETCH)):
                yield stretch[at : cut.start()]
                at = cut.start()
            yield stretch[at:]

    def document(self, text: str) -> bytes:
        out = []
        for stretch in self.stretches(text):
            if self.merge is None or stretch in self.splitter.special or LONG_WORD.search(stretch):
                ids = self.splitter.tokenizer.encode(stretch, add_special_tokens=False).ids
            else:
                ids = self.merge(stretch)
            out.append(array("I", ids).tobytes())
        return b"".join(out)


#: By vocabulary; a worker process that runs several tasks goes on with what it knows.
_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def balanced(lengths: list[int], window: int = WINDOW, linear: int = LINEAR) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill their sequences to the last token.

    Whole windows of a document are sequences of their own. The rest of each takes
    part in descending order: it goes to the sequence of the least cost so far that
    has room for all of it. Where none has, it is cut at the most room that there
    is, and what remains takes its turn by its own length. The sequences hold as
    many tokens as there are: full windows, and for what these leave over one
    sequence for each power of two in it, which needs no padding.
    """
    made = 0
    rest: list[list[tuple[int, int]]] = [[] for _ in range(window)]
    for d, n in enumerate(lengths):
        for at in range(0, n - n % window, window):
            yield d, at, window, made, 0
            made += 1
        if n % window:
            rest[n % window].append((d, n - n % window))
    total = sum(n * len(some) for n, some in enumerate(rest))
    room = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
    spent, filled = [0] * len(room), [0] * len(room)
    # Sequences by the room they have, where it is too little for the documents that are due; the others in ``open_``.
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    for s, r in enumerate(room):
        heappush(waiting[r], (0, s))
    open_: list[tuple[int, int]] = waiting[window]
    for n in range(window - 1, 0, -1):
        for x in waiting[n]:
            heappush(open_, x)
        waiting[n] = []
        due = rest[n]
        for d, at in due:
            length = n if open_ else next(r for r in range(n - 1, 0, -1) if waiting[r])
            _, s = heappop(open_ if open_ else waiting[length])
            yield d, at, length, made + s, filled[s]
            filled[s] += length
            spent[s] += cost(length, linear)
            left = room[s] - filled[s]
            if left:
                heappush(open_ if left >= n else waiting[left], (spent[s], s))
            if length < n:
                rest[n - length].append((d, at + length))


def _pack(path: str, window: int, linear: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end = array("I", [END]).tobytes()
        base = TaskContext.get().partitionId() << 38
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def emit() -> pa.RecordBatch:
            lengths = [len(h) // 4 for h in held]
            found = [(docs[d], at, n, zlib.crc32(memoryview(held[d])[4 * at : 4 * (at + n)]), lengths[d], base + s, o) for d, at, n, s, o in balanced(lengths, window, linear)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=PIECES)

        for batch in batches:
            for part in slices(batch, BLOCK):
                docs += part.column("doc_id").to_pylist()
                held += [ids.document(text or "") + end for text in part.column("text").to_pylist()]
                size += part.column("text").nbytes
                if size >= BLOCK:
                    out = emit()
                    yield out
                    base += sum(len(h) // 4 // window + 1 for h in held) + window
                    docs, held, size = [], [], 0
        if held:
            yield emit()

    return pack


def cost_packed(docs: DataFrame, work: Workspace, vocabulary: str = VOCABULARY, window: int = WINDOW, linear: int = LINEAR) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece of ``docs`` (doc_id, text).

    A document's ids and an end id are cut into pieces that lie one behind the other
    in sequences of ``window`` tokens. Documents are packed where they are read, in
    blocks of some BLOCK bytes of text: nothing is shuffled, a block's sequences are
    balanced by cost and full, and a lost task gives the same rows again. The end of
    a block, less than a window, makes up sequences of powers of two.

    Null or empty text has the end id alone and is packed too. Rows that repeat a
    doc_id are packed one by one. A long text is encoded in stretches cut between
    words; the ids of one document, four bytes each, are held at once, and a word
    without any white space in it too. An empty table gives an empty result; other
    columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(vocabulary, window, linear), PIECES_DDL)
