"""The ten operators against brute force, on texts with nulls, empties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import embedding_dedup, exact_dedup, jaccard_join, language_id, license_notices, license_scan, mixing, packing, quality, suffix_dedup, token_counts
from loomline.llm.components import components
from loomline.llm.textual import slices
from loomline.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key int, _id string, bucket string, sha string, norm string, n long, y string"
CLASH = (0, "s", 1, "i", "b", "h", "m", 5, "y")


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, strange white space, empties, a very long text, a null source and id."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh éß") for _ in range(draw.randint(2, 7))).replace(" ", "o") for _ in range(400)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base = [text(draw.randint(1, 150)) for _ in range(40)]
    passage = text(60)
    texts: list[str | None] = [*base, None, "", "   \n\t", "one", "One", "two words", "a b c d", "a  b\tc d", " lead", "trail ", "x   y", "<|endoftext|> z <|startoftext|>", "tab\x1csep \x85 \xa0nbsp　wide", "日本語 テスト Ελληνικά русский İstanbul ǅ ﬁ"]
    texts += [base[0], base[0], base[1].replace(" ", "\n", 3), base[2].upper()]
    for k in range(12):  # near copies of one text, in a chain
        words = texts[5].split()
        words[k % len(words)] = "changed"
        texts.append(" ".join(words + ["tail"] * (k % 3)))
    texts += [f"{text(10)} {passage} {text(12)}" for _ in range(6)]
    texts += ["ab" * 300, text(9000), " ".join([passage] * 3)]
    out = [(i, t, "en" if i % 7 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or ""), *CLASH) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components(spark, work):
    draw = random.Random(3)
    pairs = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(0, k) for k in range(400, 500)] + [(None, 1), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long"), work).collect()}
    want = roots([(a, b) for a, b in pairs if a is not None], range(501))
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_near_vectors(spark, work):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(120, 16)).astype(np.float32)
    x[40:60] = x[:20] + draw.normal(scale=0.08, size=(20, 16))
    x[60:70] = x[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [float("inf")] + [0.0] * 15), (204, [None] + [1.0] * 15), (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [1e-40] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, work, tile=30).collect()}
    links = set()
    fine = [(i, np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)]
    for i, a in fine:
        for j, b in fine:
            a_, b_ = a / np.abs(a).max(), b / np.abs(b).max()
            if i < j and len(a) == len(b) and a_ @ b_ / np.sqrt((a_ @ a_) * (b_ @ b_)) >= 0.95:
                links.add((i, j))
    count = Counter(i for pair in links for i in pair)
    want = roots(links, [i for i, _ in vectors])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (count[i], c, c == i) for i, c in want.items()}
    assert embedding_dedup.near_duplicates(df.limit(0), Workspace(spark, "test")).count() == 0


def test_vectors_that_repeat_an_id(spark, work):
    """Rows of one vec_id are vectors of their own; against brute force over rows."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(30, 8))
    rows_ = [(int(draw.integers(0, 20)), v.tolist()) for v in [*x, *(x[:12] + draw.normal(scale=0.02, size=(12, 8))), *x[:4], *x[:2]]]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    unit = np.array([v for _, v in rows_])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    root = roots([(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j], range(len(rows_)))
    least = {r: min(rows_[i][0] for i in range(len(rows_)) if root[i] == r) for r in set(root.values())}
    want = Counter((i, int(near[k].sum()) - 1, least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows_))
    for hot in (500, 1):
        embedding_dedup.join_hot.__defaults__, before = (hot,), embedding_dedup.join_hot.__defaults__
        try:
            got = embedding_dedup.near_duplicates(df, Workspace(spark, "test"), tile=10)
        finally:
            embedding_dedup.join_hot.__defaults__ = before
        assert Counter(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == want


def test_quantised_bounds_hold():
    draw = np.random.default_rng(2)
    x = embedding_dedup.unit(draw.normal(size=(300, 24)))
    y = embedding_dedup.unit(x + draw.normal(scale=0.07, size=x.shape))
    i, j, doubted = embedding_dedup.tile_links(embedding_dedup.Quantised(x), embedding_dedup.Quantised(y), 0.95, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.95)), strict=True))
    assert 0 < doubted < 300


@pytest.mark.parametrize("same", [False, True])
def test_dense_tiles_hold_one_strip(monkeypatch, same):
    """Two tiles all of near vectors: counts and one component as by brute force, without all pairs in memory."""
    monkeypatch.setattr(embedding_dedup, "STRIP", 64)
    draw = np.random.default_rng(6)
    n = 2000
    x = 1 + draw.normal(scale=0.02, size=(2 if not same else 1, n, 8))
    ids, copies = draw.permutation(len(x) * n).astype(np.int64).reshape(len(x), n), draw.integers(1, 4, (len(x), n))
    pdf = pd.DataFrame([{"tile": k, "ids": ids[k].tobytes(), "copies": copies[k].tobytes(), "x": x[k].tobytes(), "kind": x.dtype.str} for k in range(len(x))])
    tracemalloc.start()
    got = embedding_dedup._multiply(0.95)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    other = copies[0].sum() - copies[0] if same else np.concatenate([np.full(n, copies[1].sum()), np.full(n, copies[0].sum())])
    assert dict(zip(got["rep"], got["links"], strict=True)) == dict(zip(ids.ravel().tolist(), other.tolist(), strict=True))
    assert set(got["to"]) == {0}
    assert peak < 60e6


def test_language(spark, docs):
    draw = random.Random(4)
    words = {"aa": ["kala", "mati", "poru", "tesa"], "bb": ["schrift", "zwölf", "pfund", "knecht"], "ru": ["привет", "слово", "город", "весна"]}
    say = lambda lang, n: " ".join(draw.choice(words[lang]) for _ in range(n))
    table = [(k, say(lang, 12), lang) for k, lang in enumerate(list(words) * 20)]
    model = language_id.train(spark.createDataFrame([*table, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "ru"]
    mixed = f"{say('aa', 30)}. {say('bb', 40)} {say('ru', 10)}"
    asked = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !?"), (4, ""), (5, say("ru", 1)), (1, say("aa", 3))], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(asked, model).collect())
    assert [g[:2] for g in got] == [(1, "aa"), (1, "bb"), (2, "und"), (3, "und"), (4, "und"), (5, "ru")]
    assert all(0 <= g[2] <= 1 for g in got) and got[1][2] < 1
    spans = sorted((r.start, r.end, r.lang) for r in language_id.language_spans(asked.where(F.col("text") == mixed), model).collect())
    assert [s[2] for s in spans] == ["aa", "bb", "ru"]
    assert spans[0][:2] == (0, mixed.index(".")) and spans[-1][1] == len(mixed)
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def best_worth(scores, penalty):
    """The worth of the best path, by the recurrence over single words."""
    value = scores[0].copy()
    for row in scores[1:]:
        value = np.maximum(value, value.max() - penalty) + row
    return value.max()


def worth(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_labelled_paths_are_the_best_ones():
    """10,000 texts of 2 to 6 languages: Viterbi's path, and a single language wherever ``steady`` is sure, are worth as much as the best path."""
    draw = np.random.default_rng(1)
    firm_ones = 0
    for n in range(2, 7):
        sizes = draw.integers(1, 25, 2000)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        drift = np.repeat(draw.normal(scale=1.5, size=(2000, n)), sizes, axis=0)
        scores = draw.normal(scale=draw.choice([0.5, 2, 4]), size=(bounds[-1], n)) + drift
        path = language_id.viterbi(scores, bounds[:-1], bounds[1:], 6.0)
        best, firm = language_id.steady(scores, bounds[:-1], bounds[1:], 6.0)
        firm_ones += int(firm.sum())
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            most = best_worth(scores[a:b], 6.0)
            assert worth(scores[a:b], path[a:b], 6.0) == pytest.approx(most)
            if firm[d]:
                assert worth(scores[a:b], np.full(b - a, best[d]), 6.0) == pytest.approx(most)
    assert 1000 < firm_ones < 10_000


@pytest.mark.parametrize("stretch", [1, 2, 7, 50, 1000])
def test_long_texts_in_stretches_have_the_best_path(stretch):
    """Stretches of one word, of the whole text and between, with and without drift, one language too."""
    draw = np.random.default_rng(stretch)
    for n in (1, 2, 5):
        for size in (1, 2, 49, 50, 300):
            scores = draw.normal(scale=3, size=(size, n)) + np.repeat(draw.normal(scale=2, size=(-(-size // 20), n)), 20, 0)[:size]
            path = language_id.long_path(scores, 6.0, stretch)
            assert worth(scores, path, 6.0) == pytest.approx(best_worth(scores, 6.0))
            assert path.tolist() == language_id.viterbi(scores, np.array([0]), np.array([size]), 6.0).tolist()


def test_long_and_short_texts_together(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 30)
    draw = np.random.default_rng(3)
    sizes = np.array([5, 200, 1, 61, 60, 0, 90])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = draw.normal(scale=3, size=(bounds[-1], 3))
    assert language_id.paths(scores, bounds[:-1], bounds[1:], 5.0).tolist() == language_id.viterbi(scores, bounds[:-1], bounds[1:], 5.0).tolist()


def test_a_very_long_mixed_text_takes_seconds():
    draw = np.random.default_rng(5)
    scores = draw.normal(scale=3, size=(400_000, 4)).astype(np.float32)
    start = time.process_time()
    language_id.paths(scores, np.array([0]), np.array([400_000]), 12.0)
    assert time.process_time() - start < 5  # word by word: 15 s and more


def test_steady_heeds_switches_among_other_languages():
    """Language 0 scores nothing throughout, 1 gains and then loses, 2 the other way round: two stretches of others, one switch between them."""
    scores = np.zeros((20, 3))
    scores[:10, 1], scores[10:, 1] = 1.1, -1.2
    scores[:10, 2], scores[10:, 2] = -1.2, 1.1
    best, firm = language_id.steady(scores, np.array([0]), np.array([20]), 12.0)
    path = language_id.viterbi(scores, np.array([0]), np.array([20]), 12.0)
    assert best[0] == 0 and not firm[0] and path.tolist() == [1] * 10 + [2] * 10
    assert worth(scores, path, 12.0) == pytest.approx(10)


def test_languages_by_script_and_in_great_number(spark):
    """More languages than any list of names: those of one script never compete for words of another."""
    draw = random.Random(2)
    langs = {f"l{k:04d}": ["".join(chr((0x61 if k % 2 else 0x430) + draw.randint(0, 25)) for _ in range(6)) for _ in range(8)] for k in range(1010)}
    table = [(k, " ".join(words), lang) for k, (lang, words) in enumerate(langs.items())]
    model = language_id.train(spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1))
    assert len(model.langs) == 1010
    asked = [(k, " ".join(draw.choices(langs[f"l{k:04d}"], k=30))) for k in range(0, 1010, 101)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string").coalesce(1), model).collect()}
    assert got == {k: f"l{k:04d}" for k, _ in asked}


def test_languages_of_the_given_documents(spark, sf_dir):
    """Held-out documents of the tables: nearly all labels are found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.held_out_languages(docs, Workspace(spark, "test")).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = [(r.lang_pred, r.lang) for r in got.collect() if r.lang and re.search("[a-z]", r.text or "")]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.97


def test_token_counts(docs, rows, work):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.over_limit(docs, work).collect()}
    want = {}
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 512)
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_pre_tokens_encode_alone():
    """Texts of strange white space, special strings and scripts without spaces: units are what the vocabulary splits them into, and count as in the text."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    splitter = token_counts.Splitter(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(9)
    texts = ["".join(draw.choice(["a", "Bc", "é", " ", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", ".", "!?", "\u00a0", "\x85", "\x1d", "\u3000", "日本、", "ひらがな。", "<|endoftext|>"]) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    units, doc, unit, freq = token_counts.frequencies(texts, splitter)
    count = np.array([len(library.encode(u, add_special_tokens=False).ids) for u in units])
    assert np.bincount(doc, count[unit] * freq, len(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(u == "<|endoftext|>" or len(library.pre_tokenizer.pre_tokenize_str(u)) == 1 for u in units)
    want = {u for t in texts for s in t.split("<|endoftext|>") for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s) for u in [s[a:b]]} | {"<|endoftext|>"}
    assert set(units) == want


def test_token_counts_of_long_texts_in_small_blocks(spark, monkeypatch):
    """A text longer than a block, and a bucket that remembers few pre-tokens."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    splitter = token_counts.Splitter(token_counts.VOCABULARY)
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["alpha", "beta,", "gamma42", "δ"]) + str(draw.randint(0, 99)) for _ in range(n)) for n in (5000, 3, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["doc_id", "text"])
    sums = np.zeros(4, np.int64)
    for k, part in enumerate(slices(batch, 1000)):
        made = pa.Table.from_batches(list(token_counts._pack(part, splitter, k, 3)))
        words = made.filter(pc.is_valid(made.column("words"))).combine_chunks()
        counted = pa.Table.from_batches(list(token_counts._count(token_counts.VOCABULARY)(iter(words.to_batches()))), token_counts.PIECES)
        at = batch.column("doc_id").to_pylist().index(part.column("doc_id")[0].as_py())
        sums[at : at + part.num_rows] += token_counts._sum(made.filter(pc.is_valid(made.column("ids"))), counted).column("n_tokens").to_numpy()
    assert sums.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("buckets", [4, 400])
def test_what_a_block_sends_hardly_grows_with_the_buckets(sf_dir, buckets):
    """A block's bytes for very many buckets, with the heads of Spark's rows, are at most twice those for one."""
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = pa.Table.from_batches(list(token_counts._pack(batch, token_counts.Splitter(token_counts.VOCABULARY), 0, buckets)))
    few = pa.Table.from_batches(list(token_counts._pack(batch, token_counts.Splitter(token_counts.VOCABULARY), 0, 1)))
    assert made.nbytes + 48 * made.num_rows < 2 * few.nbytes


def test_words_encode_alone():
    library = Tokenizer.from_file(packing.VOCABULARY)
    words = packing.Words(packing.VOCABULARY)
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "BC", "É", " ", "  ", "\n", "'s", "'LL", "1", "23", ".", "!?", " ", "\x85", "\x1d", "日本", "Σ", "İ", "é", "<|endoftext|>", "µß"]) for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(words.document(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(docs, rows, work):
    library = Tokenizer.from_file(packing.VOCABULARY)
    got = packing.packed(docs, work).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            piece = np.array(ids[r.piece * 2048 : (r.piece + 1) * 2048], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (r.piece * 2048, len(piece), zlib.crc32(piece.tobytes()))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs.limit(0), work).count() == 0


def test_streams_of_one_task_have_bins_of_their_own(spark, monkeypatch):
    """Many more streams than tasks: each piece once, bins gapless, no bin in two streams."""
    monkeypatch.setattr(packing, "STREAM", 10)
    cut = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") * 37 % 60 + 1).alias("length"), F.col("id").alias("ids_crc32"))
    got = packing.pack(cut, 64, 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(500)) and len({r.sequence_id >> 28 for r in got}) > 40
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_needs_few_sequences(spark, monkeypatch):
    """Pieces of many lengths, in one stream and in several: few sequences above the lower bound, and none overfull."""
    draw = random.Random(3)
    lengths = [draw.randint(1, 400) if k % 4 else draw.randint(400, 2048) for k in range(6000)]
    cut = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECES)
    for stream, most in ((50_000, 1.02), (1500, 1.06)):
        monkeypatch.setattr(packing, "STREAM", stream)
        got = packing.pack(cut).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert max(r.n for r in got) <= 2048 and sum(r.n for r in got) == sum(lengths)
        assert len(got) <= most * -(-sum(lengths) // 2048)


def test_packer_is_best_fit_with_bounded_bins():
    draw = random.Random(6)
    packer, open_, made = packing.Packer(50, 4), {}, 0
    for _ in range(2000):
        n = draw.randint(1, 50)
        fits = [f for f in open_.values() if f >= n]
        bin_, offset = packer.place(n)
        if fits:
            assert 50 - offset == min(fits) == open_[bin_]
        else:
            assert (bin_, offset) == (made, 0)
            made += 1
            if n < 50 and len(open_) == 4:
                fullest = min(open_.values())
                gone = next(b for b, f in open_.items() if f == fullest and b not in sum(packer.bins, []))
                del open_[gone]
        open_[bin_] = 50 - offset - n
        if not open_[bin_]:
            del open_[bin_]
        assert packer.opened == len(open_) <= 4


def level(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Targets by refilling in a loop."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left, open_ = total - sum(most * sizes[s] for s in full), [s for s in order if s not in full]
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s]]
        if not over:
            break
        full |= set(over)
    return {s: most * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in order}


def test_mixing(docs, rows, work):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = level(sizes)
    got = mixing.mixture(docs, work).collect()
    assert {r.doc_id: r.size for r in got} == {i: count(t) for i, t, _ in rows}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert {s: int(want[s] + 1e-6) for s in want} == dict(taken)
    again = {(r.doc_id, r.taken) for r in mixing.mixture(docs.repartition(5), Workspace(work.spark, "test")).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    out = mixing.mixed(docs, work)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += count(r.text)
        assert r.n_chars == len(r.text or "")
    assert +words == +Counter({r.doc_id: r.taken for r in got})
    assert mixing.mixture(docs.limit(0), work).count() == 0 and mixing.mixed(docs.limit(0), work).count() == 0


def test_mixing_over_many_ranges_and_equal_rows(spark, monkeypatch):
    """Small key ranges, and a source of equal rows alone, so that its cut falls among them."""
    monkeypatch.setattr(mixing, "RANGE", 10)
    table = [(k, "w " * (k % 9), "a" if k % 3 else "b") for k in range(300)] + [(1000, "x y z", "c")] * 7 + [(None, "v " * 4, "d")] * 2
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3).withColumn("link", F.lit("clash")).withColumn("words", F.lit("clash"))
    sizes = Counter()
    for _, t, s in table:
        sizes[s] += len(t.split())
    want = {s: int(t + 1e-6) for s, t in level(sizes).items()}
    taken, words = Counter(), Counter()
    got = mixing.mixture(df, Workspace(spark, "test")).collect()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    out = mixing.mixed(df, Workspace(spark, "test"))
    for r in out.collect():
        words[r.source] += len(r.text.split())
    assert out.columns == df.columns and dict(taken) == dict(words) == want


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, "d": 5}, {"a": 0, "b": 7, None: 3}, {"a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in level(sizes).items()}


def repeated_by_brute_force(table):
    """What ``repeated_bytes`` gives for (doc_id, text), by counting all windows."""
    texts = [(t or "").encode() for _, t in table]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = {}
    for (i, _), t in zip(table, texts, strict=True):
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                covered[k : k + 200] = True
        want[i] = (len(t), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest())
    return want


def test_repeated_bytes(docs, rows, work, spark):
    want = repeated_by_brute_force([(i, t) for i, t, _ in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs, work).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.repeated_bytes(docs.limit(0), Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("colliding", [False, True])
def test_repeated_bytes_of_hot_grams(docs, spark, colliding):
    """Grams split by their windows give the same, also where different windows share a print."""
    plain = {r.doc_id: r for r in suffix_dedup.repeated_bytes(docs, Workspace(spark, "test")).collect()}
    hot = {r.doc_id: r for r in repeated_by_value(docs, Workspace(spark, "test"), colliding).collect()}
    assert hot == plain


def repeated_by_value(docs, work, colliding):
    """``repeated_bytes`` with every repeated gram split; where asked, tasks have prints of two bits for each half."""
    if not colliding:
        return suffix_dedup.repeated_bytes(docs, work, hot=1)
    cut = suffix_dedup._cut

    def weak_cut(strings):
        inner = cut(strings)

        def run(batches):
            hashes = suffix_dedup.hashes_at
            suffix_dedup.hashes_at = lambda total, at, width: hashes(total, at, width) & np.uint64(3 if width == suffix_dedup.LENGTH else (1 << 64) - 1)
            try:
                yield from inner(batches)
            finally:
                suffix_dedup.hashes_at = hashes

        return run

    suffix_dedup._cut = weak_cut
    try:
        return suffix_dedup.repeated_bytes(docs, work, hot=1)
    finally:
        suffix_dedup._cut = cut


def test_repeated_bytes_of_a_passage_in_very_many_texts(spark):
    """One passage in over HOT texts, between words of their own."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(45))
    texts = [f"{' '.join(word() for _ in range(draw.randint(5, 12)))} {passage} {' '.join(word() for _ in range(draw.randint(5, 12)))}" for _ in range(2100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(df, Workspace(spark, "test")).collect()}
    assert got == repeated_by_brute_force(list(enumerate(texts))) and all(n > len(passage) for _, n, _, _ in got.values())


def test_deep_shallow_sorts():
    draw = random.Random(2)
    strings = list({b"k" * 20 + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 40))) for _ in range(400)} | {b"", b"k", b"ab\0", b"ab"})
    order, lcp = suffix_dedup.deep_shallow(strings, 8)
    ordered = [strings[k] for k in order]
    assert ordered == sorted(strings)
    assert lcp.tolist()[1:] == [suffix_dedup.common(a, b) for a, b in zip(ordered, ordered[1:])]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_jaccard(docs, rows, work, spark):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(links, sets)
    found = jaccard_join.similar_components(docs, work)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(links) > 5
    kept = jaccard_join.one_of_each(docs, Workspace(spark, "test"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    assert jaccard_join.similar_components(docs.limit(0), Workspace(spark, "test")).count() == 0


def test_jaccard_with_null_ids_first(spark):
    """A row without doc_id that stands before equal sets in its block leaves their links alone; against brute force."""
    draw = random.Random(12)
    text = lambda n: " ".join(f"w{draw.randint(0, 9999)}" for _ in range(n))
    table: list[tuple] = []
    for k in range(8):
        t = text(60)
        table += [(None, t), (10 * k + 5, t), (10 * k + 9, f"{t} tail")] if k % 2 else [(None, t), (10 * k + 9, f"{t} tail"), (None, t), (10 * k + 5, t), (10 * k + 7, t)]
    df = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    sets = {i: shingle_set(t) for i, t in table if i is not None}
    want = roots([(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])], sets)
    got = jaccard_join.similar_components(df, Workspace(spark, "test")).collect()
    assert len(got) == len(table) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = Counter(r.doc_id for r in jaccard_join.one_of_each(df, Workspace(spark, "test")).collect())
    assert kept == Counter({None: 12, **{i: 1 for i, c in want.items() if i == c}})


def test_jaccard_of_very_long_texts(spark, monkeypatch):
    """A text with more keys in a bucket than 16 bits count, longer than a block, and a near copy of it."""
    monkeypatch.setattr(jaccard_join, "BUCKETS", 1)
    draw = random.Random(8)
    words = [f"{draw.getrandbits(40):x}" for _ in range(130_000)]
    texts = [" ".join(words), " ".join([*words, "tail"]), " ".join(words[:20_000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, Workspace(spark, "test")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {0: (129_996, 0), 1: (129_997, 0), 2: (19_996, 2)}


@pytest.mark.parametrize(("cluster", "members"), [(8192, 20_000), (3, 10)])
def test_clusters_in_parts_lose_no_link(spark, monkeypatch, cluster, members):
    """Random sets around the threshold that share most of a passage, compared whole and in small parts; against brute force."""
    monkeypatch.setattr(jaccard_join, "CLUSTER", cluster)
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    draw = random.Random(cluster)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        words = [*passage[draw.randint(0, 6) :], *(f"u{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 12)))]
        texts.append(" ".join(words))
    texts += draw.sample(texts, 20) * 2  # equal sets in many blocks
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(df, Workspace(spark, "test")).collect()}
    assert got == roots(links, sets) and len(links) > 50


def test_segments_never_miss_a_link():
    """Random pairs at the threshold always share a key, whatever counts as frequent."""
    draw = np.random.default_rng(3)
    heavy = draw.random(jaccard_join.COUNTERS) < 0.5
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 31, 40, 65, 127, 130, 300, 1100]:
        for _ in range(30):
            base = np.unique(draw.integers(0, 1 << 63, 2 * n + 2, np.uint64))
            a = base[:n]
            most = (2 * n) // 7
            gone = int(draw.integers(0, most + 1))
            added = int(draw.integers(0, n))
            b = np.sort(np.concatenate([a[gone:], base[n : n + added]]))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            keys = []
            for s in (a, b):
                bounds = np.array([0, len(s)])
                keys.append(set(np.concatenate([jaccard_join.segment_keys(s, bounds, heavy, up)[0] for up in (0, 1)]).tolist()))
            assert keys[0] & keys[1]
            left, right = (jaccard_join.folded(s, np.array([0, len(s)]))[0] for s in (a, b))
            least = min(len(left), len(right))
            far = np.bitwise_count(jaccard_join.fold(left, least) ^ jaccard_join.fold_all([right], least)[0]).sum()
            assert far <= len(np.setxor1d(a, b))


def test_quality(spark, docs, work):
    draw = random.Random(7)
    words = ["river", "stone", "light", "garden", "winter", "letter"]
    good = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(10, 60))).capitalize() + "."
    bad = lambda: " ".join(draw.choice(words).upper() + "!!" for _ in range(draw.randint(10, 60)))
    table = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(600)]
    texts = spark.createDataFrame([(k, t) for k, t, _ in table] + [(9001, None), (9002, ""), (9003, "x")], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in table] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.held_out_quality(texts, labels, work).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[k].predicted, q) for k, _, q in table if got[k].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.97
    kept = quality.accepted(texts, labels, Workspace(spark, "test"))
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.held_out_quality(docs.limit(0), labels, Workspace(spark, "test")).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.held_out_quality(docs, labels.limit(0), Workspace(spark, "test")).collect())


def test_quality_of_the_given_documents(spark, sf_dir):
    """Held-out labels of the tables: the area under the curve, and the same scores in a second run over rows in another order."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    first = {r.doc_id: r.score for r in quality.held_out_quality(docs, labels, Workspace(spark, "test")).collect()}
    held = [(first[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    ones, zeros = ([x for x, q in held if q == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.95
    again = {r.doc_id: r.score for r in quality.held_out_quality(docs.repartition(7), labels, Workspace(spark, "test")).collect()}
    assert again == first


def test_quality_of_repeated_ids_in_any_order(spark):
    """Rows of one doc_id are fitted in the order of their features, so a rerun gives the same scores."""
    table = [(k % 40, f"{'good river ' * (k % 7)}{'BAD!! ' * (k % 5)}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(table, "doc_id long, text string")
    runs_ = [Counter((r.doc_id, r.score) for r in quality.held_out_quality(d, labels, Workspace(spark, "test")).collect()) for d in (df.repartition(3), df.orderBy(F.col("text").desc()))]
    assert runs_[0] == runs_[1] and sum(runs_[0].values()) == 200


def test_pairs_by_the_sum_of_squares_identity():
    machine = quality.Machine()
    machine.v[:] = np.random.default_rng(1).normal(size=machine.v.shape)
    feature, x = np.array([3, 9, 70]), np.array([0.5, -1.0, 2.0], np.float32)
    out, _ = machine.raw(np.zeros(3, int), feature, x, 1)
    pairs = sum(machine.v[feature[i]] @ machine.v[feature[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert out[0] == pytest.approx(pairs, rel=1e-4)


def test_licenses(spark, docs):
    notice = license_scan.TEMPLATES["mit-text"]
    broken = notice.replace("publish,", "").replace("PERSONS", "x")
    table = [(1, f"code {notice} more"), (2, "x. ALL RIGHTS   reserved"), (3, "all rights are reserved"), (4, None), (5, ""), (6, f"{'pad ' * 3000} {broken}"), (7, "Released under the MIT License. z " * 2), (7, "licensed under cc by-nc 4.0")]
    got = {(r.doc_id, r.license): r for r in license_scan.license_scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit-text"), (2, "rights-reserved"), (6, "mit-text"), (7, "mit"), (7, "cc-by-nc-4.0")}
    assert got[1, "mit-text"].containment == 1 and got[1, "mit-text"].first_word == 1 and 0.75 <= got[6, "mit-text"].containment < 1
    assert got[7, "mit"].n_places == 2
    assert license_scan.license_scan(docs.limit(0)).count() == 0 and license_scan.license_scan(docs, {}).count() == 0


def test_licenses_of_whole_texts_headers_and_notices(spark):
    """Body, header, reworded notice and SPDX line of licenses that the ten notices leave out."""
    whole = {n: t[0] for n, t in license_notices.whole_texts().items() if n.endswith("-full")}
    lines = {
        "mit": "Licensed under the MIT License.",
        "mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
        "gpl-2.0": "It is licensed under the terms of the GNU General Public License version 2, I think",
        "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "lgpl-2.1-header": license_notices.HEADERS["lgpl-2.1-header"][1],
        "agpl-3-header": license_notices.HEADERS["agpl-3-header"][0],
        "unlicense": "released under The Unlicense",
        "cc0-1.0": "dedicated to the public domain under CC0",
    }
    texts = [*whole.values(), *lines.values()]
    table = [(k, f"prose {'pad ' * k} {t} and more") for k, t in enumerate(texts)]
    found = license_scan.license_scan(spark.createDataFrame(table, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.license) for r in found if r.containment == 1}
    assert {(k, n) for k, n in enumerate([*whole, *lines])} <= got
    assert (len(whole) + list(lines).index("gpl-2.0"), "gpl-3.0") not in {(r.doc_id, r.license) for r in found}


def test_licenses_retrieved_as_by_brute_force():
    """Windows left without minima hold no template: parts of long and short texts, by containment in all windows of a text."""
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefghijklmnop") + draw.choice("abcdefghijklmnop")
    templates = {f"t{n}": " ".join(word() for _ in range(n)) for n in (1, 3, 5, 6, 7, 12, 40, 130, 700)}
    texts = []
    for text in templates.values():
        for share in (0.5, 0.8, 0.9, 1):
            words = text.split()
            gone = max(0, round(len(words) * (1 - share)))
            texts.append(" ".join([word() + "x" for _ in range(draw.randint(0, 30))] + words[gone:] + [word() + "x" for _ in range(draw.randint(0, 30))]))
    index = license_scan.Index(templates, 0.75, 1e-4)
    got = set(zip(*license_scan.scan_texts(list(range(len(texts))), texts, index).select(["doc_id", "license"]).to_pydict().values(), strict=True))
    want = {(d, name) for d, t in enumerate(texts) for name, _, width, shingles, least in index.templates if license_scan.containment(shingles, license_scan.words_of(t), width) >= least}
    assert got == want


def test_licenses_of_the_given_documents(spark, sf_dir):
    """All documents against all templates of the query's list, by containment in windows of every place; all matches of the brute force are found."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    index = license_scan.Index(license_scan.TEMPLATES | license_notices.whole_texts(), 0.75, 1e-4, exact=license_notices.notices())
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        words = license_scan.words_of(text or "")
        held = {w: license_scan.grams(words, w) for w in {t[2] for t in index.templates}}
        for name, own, width, shingles, least in index.templates:
            if len(shingles & held[width]) < least * len(shingles):
                continue
            span = len(own) + max(1, len(own) // 2)
            if any(license_scan.containment(shingles, words[k : k + span], width) >= least for k in range(max(1, len(words) - span + 1))):
                want.add((d, name))
    assert want and want <= got


def test_exact(docs, rows, work, spark):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, exact_dedup.arrivals(), work).collect()}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    twice = docs.union(docs.limit(5)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = exact_dedup.exact_unique(twice, exact_dedup.arrivals(), Workspace(spark, "test"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.exact_groups(docs.limit(0), exact_dedup.arrivals(), Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse(n):
    draw = np.random.default_rng(n)
    keys = draw.integers(0, 1 << 63, n, np.uint64)
    built = exact_dedup.BinaryFuse.load(*exact_dedup.BinaryFuse.build(keys).dump())
    assert built.holds(keys).all()
    if n >= 1000:
        assert built.holds(draw.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.01
        assert len(built.table) < 2.2 * n + 3000


def test_repeated_and_null_ids(spark):
    """All operators keep a row for each row, with ids that repeat or are null."""
    text = "some words that are here to be read by all of us today"
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (1, text + " x", None), (None, text, "s"), (2, None, None)], "doc_id long, text string, source string")
    work = lambda: Workspace(spark, "test")
    assert token_counts.token_counts(df).count() == 5
    assert packing.packed(df, work()).count() == 5
    assert mixing.mixture(df, work()).count() == 5
    assert exact_dedup.exact_groups(df, exact_dedup.arrivals(), work()).count() == 5
    assert jaccard_join.similar_components(df, work()).count() == 5
    assert suffix_dedup.repeated_bytes(df, work()).count() == 5
    assert mixing.mixed(df, work()).count() >= 1
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert Counter(r.doc_id for r in quality.held_out_quality(df, labels, work()).collect()) == Counter({1: 3, None: 1, 2: 1})
    found = language_id.held_out_languages(df.withColumn("lang", F.lit("en")), work()).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in found) == Counter({(1, "en"): 3, (None, "en"): 1, (2, "und"): 1})
    notice = df.withColumn("text", F.concat("text", F.lit(" Released under the MIT License.")))
    assert Counter(r.doc_id for r in license_scan.license_scan(notice).where("license = 'mit'").collect()) == Counter({1: 3, None: 1})
