"""Hard negatives, importance resampling and cost-balanced packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import cost_packing, hard_negatives, resampling
from loomline.llm.workspace import Workspace

from test_llm_operators import CLASH, SCHEMA, corpus


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(), (None, "a null id", None, None, 9, *CLASH), (3, "an id again", None, None, 11, *CLASH), (3, "an id again", None, None, 11, *CLASH)], SCHEMA).repartition(3).cache()


# Cost-balanced packing


def held(pieces, window=cost_packing.WINDOW):
    """Checks that sequences are gapless and full or powers of two long; (piece rows by document)."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p[3]].append((p[4], p[2]))
        documents[p[0]].append((p[1], p[2]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    for parts in documents.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    return {d: sum(n for _, n in parts) for d, parts in documents.items()}, sequences


@pytest.mark.parametrize("seed", range(6))
def test_balanced_sequences_are_full(seed):
    draw = random.Random(seed)
    kinds = [lambda: draw.randint(1, 63), lambda: draw.randint(30, 200), lambda: 40, lambda: draw.choice([1, 64, 128, 65]), lambda: int(draw.expovariate(1 / 20)) + 1, lambda: 63]
    lengths = [kinds[seed]() for _ in range(draw.randint(0, 400))]
    totals, sequences = held(cost_packing.balanced(lengths, 64), 64)
    assert totals == dict(enumerate(lengths)) and sum(n for s in sequences.values() for _, n in s) == sum(lengths)
    assert sum(sum(n for _, n in s) < 64 for s in sequences.values()) <= 6


def test_descending_documents_go_to_the_least_cost():
    lengths = [7, 30, 12, 25, 3, 18, 1, 9, 21, 16, 5, 45]  # three sequences of 64
    spent, due = Counter(), sorted(lengths, reverse=True)
    room = {s: 64 for s in range(sum(lengths) // 64)}
    for d, at, n, s, _ in cost_packing.balanced(lengths, 64):
        if at == 0 and n == lengths[d] and s in room:
            assert lengths[d] == due.pop(0)
            assert spent[s] == min(spent[x] for x, r in room.items() if r >= n)
        else:
            break
        room[s] -= n
        spent[s] += cost_packing.cost(n)
    assert len(due) < 5  # those that had to be cut came last


def test_costs_are_close_to_each_other():
    draw = random.Random(4)
    lengths = [draw.randint(20, 500) for _ in range(4000)]
    spent, size = Counter(), Counter()
    for _, _, n, s, _ in cost_packing.balanced(lengths):
        spent[s] += cost_packing.cost(n)
        size[s] += n
    full = np.array([spent[s] for s in size if size[s] == cost_packing.WINDOW])
    fitted: list[list[int]] = []  # descending documents, each in the first sequence that has room
    for n in sorted(lengths, reverse=True):
        place = next((f for f in fitted if sum(f) + n <= cost_packing.WINDOW), None)
        fitted.append([n]) if place is None else place.append(n)
    plain = np.array([sum(map(cost_packing.cost, f)) for f in fitted if sum(f) > 1000])
    assert full.std() < plain.std() / 4


def test_cost_packed(docs, work):
    tokenizer = Tokenizer.from_file(cost_packing.VOCABULARY)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
    rows = cost_packing.cost_packed(docs, work).collect()
    held([((r.doc_id, r.doc_tokens) if r.doc_id not in (3,) else (r.doc_id, r.doc_tokens, r.sequence_id, r.offset), 0 if r.doc_id == 3 else r.start, r.length, r.sequence_id, r.offset) for r in rows])
    for r in rows:
        assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in want[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(w) for several in want.values() for w in several)
    assert cost_packing.cost_packed(docs.limit(0), work).count() == 0
    again = cost_packing.cost_packed(docs, work).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_ranks_and_tokenizer_agree_on_all_characters():
    ids, tokenizer = cost_packing.Ids(cost_packing.VOCABULARY), Tokenizer.from_file(cost_packing.VOCABULARY)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    for at in range(0, len(points), 4000):
        text = " ".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}  {chr(c)}{chr(c)}?" for c in points[at : at + 4000])
        assert ids.document(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("stretch", [1, 40, 1_000_000])
def test_stretches_encode_alone(monkeypatch, stretch):
    monkeypatch.setattr(cost_packing, "STRETCH", stretch)
    ids, tokenizer = cost_packing.Ids(cost_packing.VOCABULARY), Tokenizer.from_file(cost_packing.VOCABULARY)
    texts = ["", " ", "a", "it's  two\n\n spaces <|endoftext|> <|endoftext|>x  ", "don't " * 50, "x" * 3000 + " y", "  a  b 　c", *(r[1] or "" for r in corpus()[:70])]
    for text in texts:
        assert ids.document(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_blocks_of_a_task_have_sequences_of_their_own(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cost_packing, "BLOCK", 3_000)
    monkeypatch.setattr(cost_packing.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 5_000_000})()))
    texts = [r[1] for r in corpus()]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = list(cost_packing._pack(cost_packing.VOCABULARY, 64, cost_packing.LINEAR)([batch.slice(0, 30), batch.slice(30)]))
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    totals, _ = held([(r[0], r[1], r[2], r[5], r[6]) for r in rows], 64)
    assert len(out) > 3 and len(totals) == len(texts) and max(r[5] for r in rows) < 1 << 62


# Importance resampling


def resampled_by_hand(docs, target, longest, buckets, share, least):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda w: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(features(find(t)))
    for t in target:
        wanted.update(features(find(t)))
    total, wanted_total = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * total / ((source[b] + 1) * wanted_total))) for b in range(buckets)}
    out = []
    for i, t in docs:
        f = features(find(t))
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(find(t))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "buckets", "share", "least", "head"), [(1, 10_000, 10, 20, 20_000), (1, 50, 100, 1, 3), (2, 300, 40, 5, 10), (3, 300, 7, 0, 4)])
def test_resampled(spark, docs, longest, buckets, share, least, head):
    target = [corpus()[3][1], "Some other words, some OTHER words", None, ""]
    wanted = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resampled(docs, wanted, Workspace(spark, "test"), longest, buckets, share, least, head=head)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], target, longest, buckets, share, least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resampled_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), none, Workspace(spark, "test")).count() == 0
    got = resampling.resampled(docs, none, Workspace(spark, "test"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], [], 1, 10_000, 10, 20)


def test_ranks_of_very_many_equal_rows(spark):
    """One text and one id in all rows: each rank is given once, over several ranges."""
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word " * 25).alias("text"))
    ranks = [r.rank for r in resampling.resampled(rows, rows.limit(3), Workspace(spark, "test")).collect()]
    assert sorted(r for r in ranks if r is not None) == list(range(1, 501)) and len(ranks) == 5000


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_of_long_texts_in_stretches(monkeypatch, longest):
    text = " ".join(random.Random(9).choice(["a", "bb", "ccc", "É", "d1"]) for _ in range(300)) + " - end"
    whole = resampling.Features({}, {}, longest, 997)
    want = Counter(b for some in whole.of(resampling.words(text)) for b in some)
    monkeypatch.setattr(resampling, "STRETCH", 7)
    split = resampling.Features({b"a": zlib.crc32(b"a")}, {b"a bb": zlib.crc32(b"a bb") % 997}, longest, 997)
    assert Counter(b for some in split.of(resampling.words(text)) for b in some) == want
    assert sum(want.values()) == sum(len(text.split()) - 1 - n for n in range(longest))


# Hard negatives


def negatives_by_hand(rows, positives=5, negatives=3):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, lab, v) in enumerate(rows):
        if i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for m, (j, other, w) in enumerate(rows) if m != n and len(w) == len(v)]
        first = sorted((s for s in scored if s[2] == lab), key=lambda s: (-s[0], s[1]))[:positives]
        for p, j, _ in first:
            fit = sorted((s for s in scored if s[2] != lab and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, j, k, s[1], p, s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, width=6, labels=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [[10 * k, int(draw.integers(labels)), x[k].tolist()] for k in range(n)]
    for k in range(0, n, 4):  # a third of the rows, and more, are one vector
        rows[k][2] = rows[n // 2][2]
    return rows


SMALL = "vec_id long, label int, embedding array<float>, row int, q string, key int"


@pytest.mark.parametrize(("bytes_", "past"), [(32_000_000, 4096), (400, 30), (48, 7)])
def test_hard_negatives(spark, monkeypatch, bytes_, past):
    """With one block of anchors, some, and one for each anchor."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(hard_negatives, "PAST", past)
    rows = vectors(1, 150)
    odd = [(5000, None, [1.0] * 6), (5050, 1, None), (5100, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5150, 1, [math.nan] * 6), (5200, 1, [math.inf] + [0.0] * 5), (5250, 1, []), (None, 1, [1.0] * 6)]
    odd += [(5300, 8, [0.5] * 6), (5350, 9, [-0.5] * 6), (5351, 9, [0.5] * 6), (5400, 1, [0.3] * 4), (5401, 1, [0.3, 0.2, 0.1, 0.0]), (5402, 2, [0.2] * 4), (5450, 1, [0.0] * 6), (50, 1, [0.4] * 6), (100, 2, rows[10][2])]
    rows = [tuple(r) for r in [*rows, *odd]]
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], SMALL).repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, Workspace(spark, "test"))
    want = negatives_by_hand([(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows])
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_hard_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], SMALL)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("least", [-10_000, 0, 9_000, 30_000, 60_000, 70_000])
def test_threshold_join_loses_no_pair(least):
    draw = np.random.default_rng(2)
    x = np.floor(256 * draw.normal(size=(300, 40)) * np.linspace(1, 0.02, 40) / 3)
    x[:40] = 0
    a, cuts, order = x[100:120], np.array([0, 10, 20, 30]), np.argsort(-(x * x).sum(0))
    norms = hard_negatives.rest_norms(a[:, order], cuts)
    index = hard_negatives.Index(x, order, cuts, norms.max(0), least)
    i, j, score = hard_negatives.threshold_join(a[:, order], norms, index, cuts, np.full(20, float(least)))
    full = (a @ x.T).astype(np.int64)
    assert {(p, q, s) for p, q, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)} == {(p, q, int(full[p, q])) for p, q in zip(*np.nonzero(full >= least), strict=True)}
    if least > 0:  # weak last dimensions, and rows without strength, aren't indexed
        assert index.lists[0] <= 260 and index.lists[-1] < index.lists[0]
