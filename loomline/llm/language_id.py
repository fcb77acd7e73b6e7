"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .textual import LETTER, Block, mix, runs, slices
from .workspace import Workspace

GRAMS = 1 << 16
SLICES = 16
PENALTY = 12.0
RARE = 0.005
BLOCK = 3_000_000
#: Languages that are counted, or scored in blocks of full size, at once.
SOME = 16
UNKNOWN = "und"
#: Words of a long text that are labelled one after the other.
STRETCH = 1_000

# First and last code points of scripts, by Unicode block; what none holds counts as one more script.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF),
    ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF),
    ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF), ("Georgian", 0x10A0, 0x10FF), ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF), ("Hangul", 0x1100, 0x11FF), ("Han", 0x20000, 0x323AF),
)
NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))


@cache
def script_table() -> np.ndarray:
    table = np.full(0x110000, len(NAMES), np.int8)
    for name, first, last in SCRIPTS:
        table[first : last + 1] = NAMES.index(name)
    return table


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and scripts (of the first letter) of the runs of letters."""
    starts, ends = runs((block.classes & LETTER) > 0)
    return starts, ends, block.document(starts), script_table()[block.codes[starts]]


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters, and the hash of the lower-case trigram around each; other characters bound words alike."""
    letters = (block.classes & LETTER) > 0
    code = np.where(letters, block.lower, 0).astype(np.uint64)
    code = np.concatenate([[np.uint64(0)], code, [np.uint64(0)]])
    whole = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    at = np.flatnonzero(letters)
    return at, (mix(whole[at]) >> np.uint64(48)).astype(np.int64)


COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("scripts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        rows = [{"lang": lang, "part": k, "counts": part.tobytes(), "scripts": s.tobytes() if k == 0 else None} for lang, (c, s) in held.items() for k, part in enumerate(np.split(c, SLICES))]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, COUNTS)

    for batch in batches:
        for part in slices(batch, BLOCK):
            block = Block(part.column("text").to_pylist())
            names, code = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            at, gram = grams(block)
            own = code[block.document(at)]
            starts, ends, doc, script = words(block)
            letters = np.bincount(code[doc] * (len(NAMES) + 1) + script, ends - starts, len(names) * (len(NAMES) + 1)).astype(np.int64).reshape(-1, len(NAMES) + 1)
            for first in range(0, len(names), SOME):
                some = (own >= first) & (own < first + SOME)
                pairs = np.bincount((own[some] - first) * GRAMS + gram[some], minlength=SOME * GRAMS).reshape(SOME, GRAMS)
                for k, name in enumerate(names[first : first + SOME]):
                    c, s = held.setdefault(str(name), [np.zeros(GRAMS, np.int64), np.zeros(len(NAMES) + 1, np.int64)])
                    c += pairs[k]
                    s += letters[first + k]
                if len(held) > 50:
                    yield flush()
    if held:
        yield flush()


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    add = lambda column: sum(np.frombuffer(b, np.int64) for b in column if b is not None)
    first = pdf["part"].iloc[0] == 0
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [add(pdf["counts"]).tobytes()], "scripts": [add(pdf["scripts"]).tobytes() if first else None]})


class Model:
    """Log probabilities of trigrams by language, and the languages that each script admits."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * GRAMS)
        self.scores = np.ascontiguousarray(np.log(share).T.astype(np.float32))
        part = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.admits = (part >= RARE).T
        self.admits[~self.admits.any(1)] = True


def train(docs: DataFrame) -> Model:
    """Counts over all rows of ``docs`` (text, lang) whose lang isn't null. The model takes GRAMS numbers a language, whatever the corpus."""
    ship(docs.sparkSession)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    ddl = "lang string, part int, counts binary, scripts binary"
    found = rows.mapInArrow(_count, ddl).groupBy("lang", "part").applyInPandas(_add, ddl)
    parts = found.collect()
    langs = sorted({r.lang for r in parts})
    counts, scripts = np.zeros((len(langs), GRAMS)), np.zeros((len(langs), len(NAMES) + 1))
    for r in parts:
        k, step = langs.index(r.lang), GRAMS // SLICES
        counts[k, r.part * step : (r.part + 1) * step] = np.frombuffer(r.counts, np.int64)
        if r.scripts is not None:
            scripts[k] = np.frombuffer(r.scripts, np.int64)
    return Model(langs, counts, scripts)


def steady(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Per document its best single language, and whether no path with a switch can beat it.

    A word gains at most what its best other language scores above the document's
    own. Where no stretch of words gains more than one penalty so, a path loses on
    each stretch that it spends in other languages, however it switches among them:
    the stretch takes a switch at one of its ends at least. A stretch of all words
    in one other language takes none, but that one isn't the best single language.
    """
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0, np.float64)])
    best = (total[ends] - total[starts]).argmax(1)
    firm = np.ones(len(starts), bool)
    if scores.shape[1] < 2 or not len(scores):
        return best, firm
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.arange(len(scores))
    others = scores.astype(np.float64)
    own = others[rows, best[doc]]
    others[rows, best[doc]] = -np.inf
    gain = np.concatenate([[0], np.cumsum(others.max(1) - own)])
    # Running minima begin anew at each document, as each lies below all before it.
    step = 2 * (gain.max() - gain.min()) + 1
    low = np.minimum.accumulate(gain[:-1] - doc * step)
    firm[doc[gain[1:] - doc * step - low > penalty]] = False
    return best, firm


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """The best language of each word of the documents [start, end), all documents side by side, longest first.

    ``enter`` is the language before each document's first word, ``leave`` that of its last one, where they are known.
    """
    order, active, value, trace = _forward(scores, starts, ends, penalty, enter, True)
    stay, came = trace
    starts = starts[order]
    path = np.zeros(len(scores), np.int16)
    last = np.zeros(len(starts), np.int16)
    for t in range(len(active) - 1, -1, -1):
        live = active[t]
        fresh = slice(active[t + 1] if t + 1 < len(active) else 0, live)
        last[fresh] = value[fresh].argmax(1) if leave is None else leave[order[fresh]]
        at = starts[:live] + t
        path[at] = last[:live]
        if t:
            last[:live] = np.where(stay[at, last[:live]], last[:live], came[at])
    return path


def _forward(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float, enter: np.ndarray | None, traced: bool) -> tuple:
    """The order of the documents, how many are as long as each step, the best value by last language, and how it came about."""
    order = np.argsort(starts - ends, kind="stable")
    starts, size = starts[order], (ends - starts)[order]
    n = scores.shape[1]
    stay, came = (np.zeros((len(scores), n), bool), np.zeros(len(scores), np.int16)) if traced else (None, None)
    value = np.zeros((len(starts), n))
    if enter is not None:
        value[:] = -np.inf
        value[np.arange(len(starts)), enter[order]] = 0
    active = np.searchsorted(-size, -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    for t, live in enumerate(active):
        at = starts[:live] + t
        v = value[:live]
        if t or enter is not None:
            top = v.argmax(1)
            switch = v[np.arange(live), top] - penalty
            keep = v >= switch[:, None]
            if traced:
                stay[at], came[at] = keep, top
            v = np.where(keep, v, switch[:, None])
        value[:live] = v + scores[at]
    return order, active, value, (stay, came)


def long_path(scores: np.ndarray, penalty: float, stretch: int = STRETCH) -> np.ndarray:
    """``viterbi`` of one long document, by stretches side by side.

    What a stretch is worth is worked out for each pair of a language before it and
    a last one; these are put together from stretch to stretch, which fixes the
    language at each border, and then the words of all stretches are labelled.
    """
    n = scores.shape[1]
    starts = np.arange(0, len(scores), stretch)
    ends = np.minimum(starts + stretch, len(scores))
    order, _, value, _ = _forward(scores, np.repeat(starts, n), np.repeat(ends, n), penalty, np.tile(np.arange(n), len(starts)), False)
    worth = np.empty_like(value)
    worth[order] = value
    worth = worth.reshape(len(starts), n, n)  # by stretch, language before, last language
    total, before = np.zeros(n), np.zeros((len(starts), n), np.int64)
    for k in range(len(starts)):
        # The language before the first word is free: entering by the first word's own costs nothing.
        both = total[:, None] + worth[k]
        before[k] = both.argmax(0)
        total = both.max(0)
    leave = np.zeros(len(starts), np.int64)
    leave[-1] = total.argmax()
    for k in range(len(starts) - 1, 0, -1):
        leave[k - 1] = before[k, leave[k]]
    enter = np.concatenate([[before[0, leave[0]]], leave[:-1]])
    return viterbi(scores, starts, ends, penalty, enter, leave)


def paths(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """``viterbi``, long documents one by one in stretches, so that no text takes a step for each word by itself."""
    long_ = ends - starts > 2 * STRETCH
    path = np.zeros(len(scores), np.int16)
    if not long_.all():
        short = viterbi(scores, starts[~long_], ends[~long_], penalty)
        path[:] = short
    for s, e in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True):
        path[s:e] = long_path(scores[s:e], penalty)
    return path


def narrowed(model: Model, script: np.ndarray, number: np.ndarray, gram: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Scores of words in the languages ``langs``; a word is scored in those that its script admits, and the others lie far below."""
    scores = np.full((len(script), len(langs)), np.nan, np.float32)
    for s in np.unique(script):
        some = np.flatnonzero(script == s)
        at = np.full(len(script), -1)
        at[some] = np.arange(len(some))
        of = at[number]
        of, own = (of[of >= 0], gram[of >= 0]) if len(some) < len(script) else (of, gram)
        for k in np.flatnonzero(model.admits[s, langs]):
            scores[some, k] = np.bincount(of, model.scores[own, langs[k]], len(some))
    missing = np.isnan(scores)
    if missing.any():
        scores = np.where(missing, np.nanmin(scores, 1, keepdims=True) - 50, scores)
    return scores


def label(texts: list[str | None], model: Model, penalty: float) -> tuple[Block, tuple, np.ndarray]:
    """The words of the texts and the language of each.

    Texts with the same scripts are labelled together, among the languages that
    one of these scripts admits.
    """
    block = Block(texts)
    starts, ends, doc, script = words(block)
    _, gram = grams(block)
    number = np.repeat(np.arange(len(starts)), ends - starts)
    scripts = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(scripts, doc, 1 << script.astype(np.int64))
    path = np.zeros(len(starts), np.int16)
    for mask in np.unique(scripts[scripts > 0]).tolist():
        held = [s for s in range(len(NAMES) + 1) if mask >> s & 1]
        langs = np.flatnonzero(model.admits[held].any(0))
        mine = scripts[doc] == mask
        at = np.flatnonzero(mine)
        place = np.cumsum(mine) - 1
        some = mine[number]
        scores = narrowed(model, script[at], place[number[some]], gram[some], langs)
        members = np.flatnonzero(scripts == mask)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(texts))[members])])
        best, firm = steady(scores, bounds[:-1], bounds[1:], penalty)
        found = np.repeat(best, np.diff(bounds))
        loose = np.flatnonzero(~firm)
        if len(loose):
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in loose])
            to = np.cumsum(np.diff(bounds)[loose])
            found[rows] = paths(scores[rows], to - np.diff(bounds)[loose], to, penalty)
        path[at] = langs[found]
    return block, (starts, ends, doc), path


def bounded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Parts of batches for ``label``: the more languages, the fewer words at once."""
    most = BLOCK * SOME // max(SOME, len(model.langs))
    for batch in batches:
        yield from slices(batch, most)


def _predict(held, penalty: float):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in bounded(batches, model):
            n, langs = part.num_rows, len(model.langs)
            score, names = np.zeros(n), [UNKNOWN] * n
            if langs:
                _, (starts, ends, doc), path = label(part.column("text").to_pylist(), model, penalty)
                letters = np.bincount(doc * langs + path, ends - starts, n * langs).reshape(n, langs)
                whole = letters.sum(1)
                top = letters.argmax(1)
                score = letters[np.arange(n), top] / np.maximum(whole, 1)
                names = [model.langs[k] if w else UNKNOWN for k, w in zip(top, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], schema=schema)

    return predict


def _spans(held, penalty: float):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in bounded(batches, model):
            if not model.langs:
                continue
            block, (starts, ends, doc), path = label(part.column("text").to_pylist(), model, penalty)
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])])) if len(doc) else np.zeros(0, int)
            last = np.concatenate([first[1:] - 1, [len(doc) - 1]]) if len(first) else first
            base = block.starts[doc[first]]
            ids = part.column("doc_id").take(pa.array(doc[first]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts[first] - base), pa.array(ends[last] - base), pa.array([model.langs[k] for k in path[first]], pa.string())], schema=schema)

    return spans


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs`` (doc_id, text).

    The language with most letters in the labelled spans, and its share of all
    letters; ties go to the first name. ``und`` and 0 for null texts, texts without
    letters, and a model without languages. Other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS floats a language
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(held, penalty), "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, start, end, lang): the stretches of one language in each text, in characters; no rows for texts without letters."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_spans(held, penalty), "doc_id long, start long, end long, lang string")


def fold(k: int) -> Column:
    """crc32 of doc_id as text, modulo k; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(k))


def held_out_languages(docs: DataFrame, work: Workspace) -> DataFrame:
    """Predictions for every document by a model of those whose fold of five isn't 0: (doc_id, held_out, lang_pred, score)."""
    del work
    model = train(docs.where(fold(5) != 0))
    return predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")
