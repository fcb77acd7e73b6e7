"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .language_id import fold
from .textual import DIGIT, LETTER, NEWLINE, SPACE, UPPER, Block, runs, slices, span_hashes, sums
from .workspace import Workspace

WORDS = 1 << 15
FACTORS = 8
SAMPLE = 10_000
#: Texts of one id that are learnt from, at most.
COPIES = 10
BATCH = 64
STEPS = 1_800
BLOCK = 1_000_000

#: Structure and metadata features of a text, in the order of ``structure``.
STRUCTURE = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "spaces", "distinct_words", "top_word", "log_lines", "line_length",
    "distinct_lines", "capital_words", "symbol_ends", "long_words", "short_words", "log_bytes_per_char",
)


def structure(block: Block, words: tuple[np.ndarray, np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row per document of the features in STRUCTURE; an empty text has zeros."""
    starts, ends, doc = words
    owner, count = counts
    n = len(block.starts)
    chars = block.ends - block.starts
    one = np.maximum(chars, 1)
    by = lambda mask: sums(mask.astype(np.int64), block.starts, block.ends)
    letters = (block.classes & LETTER) > 0
    space = (block.classes & SPACE) > 0
    digits = (block.classes & DIGIT) > 0
    upper = by((block.classes & UPPER) > 0)
    n_words = np.bincount(doc, minlength=n)
    some = np.maximum(n_words, 1)
    length = ends - starts
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, count)
    line_starts, line_ends = runs((block.classes & NEWLINE) == 0)
    line_doc = block.document(line_starts)
    lines = np.bincount(line_doc, minlength=n)
    seen = np.unique(np.stack([line_doc.astype(np.uint64), span_hashes(block.lower, line_starts, line_ends)]), axis=1)[0].astype(np.int64) if len(line_doc) else line_doc
    last = ends - 1
    capital = ((block.classes[starts] & UPPER) > 0).astype(np.int64)
    symbol_end = ~letters[last] & ~digits[last]
    mean = lambda values: np.bincount(doc, values, n) / some
    width = 1 + (block.codes >= 0x80) + (block.codes >= 0x800) + (block.codes >= 0x10000)
    out = np.stack(
        [
            np.log1p(chars), np.log1p(n_words), mean(length), upper / np.maximum(by(letters), 1), by(digits) / one, by(~(letters | space | digits)) / one, by(space) / one,
            np.bincount(owner, minlength=n) / some, top / some, np.log1p(lines), np.log1p(chars / np.maximum(lines, 1)),
            np.bincount(seen, minlength=n) / np.maximum(lines, 1), mean(capital), mean(symbol_end), mean(length > 12), mean(length < 3), np.log1p(by(width) / one),
        ],
        axis=1,
    )
    out[chars == 0] = 0
    return out.astype(np.float32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure rows, and the hashed words of all documents: bounds by document, buckets and values of unit length."""
    block = Block(texts)
    starts, ends = runs((block.classes & SPACE) == 0)
    doc = block.document(starts)
    hashed = span_hashes(block.lower, starts, ends)
    order = np.lexsort([hashed, doc])
    doc_, hash_ = doc[order], hashed[order]
    first = np.flatnonzero(np.concatenate([[True], (doc_[1:] != doc_[:-1]) | (hash_[1:] != hash_[:-1])])) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(doc)]]))
    owner = doc_[first]
    # The plain word, without what leads and trails it, gives the bucket; its whole form has counted for the statistics.
    letters = (block.classes & LETTER) > 0
    a, b = runs(letters)
    word_doc = block.document(a)
    bucket = (span_hashes(block.lower, a, b) % np.uint64(WORDS)).astype(np.int64)
    keys, times = np.unique(word_doc * WORDS + bucket, return_counts=True)
    who = keys // WORDS
    value = np.sqrt(times.astype(np.float32))
    norm = np.sqrt(np.bincount(who, value**2, len(texts)))
    value = (value / np.maximum(norm, 1e-9)[who]).astype(np.float32)
    return structure(block, (starts, ends, doc), (owner, count)), np.searchsorted(who, np.arange(len(texts) + 1)), keys % WORDS, value


class Machine:
    """score = sigmoid(w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j), the pairs by the sum-of-squares identity in linear time."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        n = WORDS + len(STRUCTURE)
        self.w0 = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = draw.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
        self.mean = np.zeros(len(STRUCTURE), np.float32)
        self.scale = np.ones(len(STRUCTURE), np.float32)

    def rows(self, dense: np.ndarray, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) of all features: hashed words, then standardised statistics."""
        n, k = dense.shape
        flat = np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32)
        doc = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), k)])
        return doc, np.concatenate([bucket, np.tile(np.arange(WORDS, WORDS + k), n)]), np.concatenate([value, flat.ravel() * np.float32(0.5)])

    def raw(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = self.w0 + np.bincount(doc, self.w[feature] * x, n)
        total = np.empty((n, FACTORS), np.float32)
        for f in range(FACTORS):
            part = self.v[feature, f] * x
            total[:, f] = np.bincount(doc, part, n)
            out += 0.5 * (total[:, f].astype(np.float64) ** 2 - np.bincount(doc, part.astype(np.float64) ** 2, n))
        return out, total

    def score(self, *found: np.ndarray) -> np.ndarray:
        n = len(found[0])
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*found), n)[0], -30, 30)))

    def fit(self, dense: np.ndarray, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, seed: int = 7, rate: float = 0.08) -> Machine:
        """Adagrad on log loss for about STEPS batches, in an order that the seed fixes."""
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-3)
        rate_ = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.w0 = float(np.log(rate_ / (1 - rate_)))
        draw = np.random.default_rng(seed)
        g0, gw, gv = 1e-3, np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32)
        batches = max(1, len(y) // BATCH)
        for _ in range(-(-STEPS // batches)):
            for some in np.array_split(draw.permutation(len(y)), batches):
                if not len(some):
                    continue
                sizes = np.diff(bounds)[some]
                at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in some])
                doc, feature, x = self.rows(dense[some], np.concatenate([[0], np.cumsum(sizes)]), bucket[at], value[at])
                out, total = self.raw(doc, feature, x, len(some))
                slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[some]) / len(some)
                used, index = np.unique(feature, return_inverse=True)
                each = (slope[doc] * x).astype(np.float32)
                grad = np.bincount(index, each, len(used)).astype(np.float32) + 1e-6 * self.w[used]
                gw[used] += grad**2
                self.w[used] -= rate * grad / np.sqrt(gw[used])
                for f in range(FACTORS):
                    grad = np.bincount(index, each * (total[doc, f] - self.v[feature, f] * x), len(used)).astype(np.float32) + 1e-5 * self.v[used, f]
                    gv[used, f] += grad**2
                    self.v[used, f] -= rate * 0.3 * grad / np.sqrt(gv[used, f])
                g0 += slope.sum() ** 2
                self.w0 -= rate * slope.sum() / np.sqrt(g0)
        return self

    def dump(self) -> bytes:
        return b"".join([np.float64(self.w0).tobytes(), self.w.tobytes(), self.v.tobytes(), self.mean.astype(np.float32).tobytes(), self.scale.astype(np.float32).tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Machine:
        self, k, n = cls(), len(STRUCTURE), WORDS + len(STRUCTURE)
        self.w0 = float(np.frombuffer(data, np.float64, 1)[0])
        flat = np.frombuffer(data, np.float32, offset=8)
        self.w, self.v, self.mean, self.scale = flat[:n], flat[n : n * (1 + FACTORS)].reshape(n, FACTORS), flat[n * (1 + FACTORS) :][:k], flat[n * (1 + FACTORS) + k :]
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, BLOCK):
            dense, bounds, bucket, value = features(part.column("text").to_pylist())
            at = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1) * dense.shape[1], pa.int32()), pa.array(dense.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), rows, *lists], ["doc_id", "y", "dense", "bucket", "value"])


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    # Rows that repeat an id follow each other by their features, so the order never depends on the shuffle.
    pdf = pdf.assign(_by=[np.asarray(x, np.float32).tobytes() + np.asarray(b, np.int32).tobytes() + np.asarray(v, np.float32).tobytes() for x, b, v in zip(pdf["dense"], pdf["bucket"], pdf["value"], strict=True)])
    pdf = pdf.sort_values(["doc_id", "_by"], kind="stable")
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in pdf["bucket"]])])
    machine = Machine().fit(np.stack(pdf["dense"]), bounds, np.concatenate(list(pdf["bucket"])), np.concatenate(list(pdf["value"])), pdf["y"].to_numpy(float))
    return pd.DataFrame({"model": [machine.dump()]})


def train(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE, copies: int = COPIES) -> Machine:
    """A machine fit to at most ``sample`` labelled rows (doc_id, quality), the first in hash order of their ids.

    Without labels of both kinds the untrained machine scores by the share of ones
    (0.5 where there are none). Null labels and ids are left out; an id with several
    labels counts with their rounded mean. Of several texts of an id, ``copies`` at
    most take part, the first in hash order.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("y")).where("_id is not null and y is not null")
    rows = rows.groupBy("_id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.md5(F.col("_id").cast("string"))).limit(sample)
    chosen = work.write(rows, "sample")
    # At most ``sample`` rows of two numbers, whatever the corpus.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    found = found.withColumn("place", place).where(F.col("place") <= copies).drop("place")
    found = found.mapInArrow(_extract, "doc_id long, y double, dense array<float>, bucket array<int>, value array<float>")
    model = found.withColumn("one", F.col("y") * 0).groupBy("one").applyInPandas(_fit, "model binary").collect()
    return Machine.load(model[0].model) if model else Machine()


def _score(held):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(held.value)
        for batch in batches:
            for part in slices(batch, BLOCK):
                out = machine.score(*features(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], schema=schema)

    return score


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score), one row per row of ``docs`` (doc_id, text): how likely its label is 1.

    The score depends on the text alone. Null text counts as empty; empty texts,
    and texts without words, score by what structure they have.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine.dump())  # WORDS * (FACTORS + 1) floats
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(held), "doc_id long, score double")


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those whose fold of three isn't 1."""
    return labels.where(fold(3) != 1)


def held_out_quality(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    machine = train(docs, training_rows(labels), work)
    return score(docs, machine).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, work: Workspace, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns kept."""
    machine = train(docs, training_rows(labels), work)
    held = docs.sparkSession.sparkContext.broadcast(machine.dump())

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Machine.load(held.value)
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
            yield pd.Series(np.concatenate([known.score(*features(p.column("text").to_pylist())) for p in slices(batch, BLOCK)] or [np.zeros(0)]))

    return docs.where(judge(F.col("text")) >= least)
