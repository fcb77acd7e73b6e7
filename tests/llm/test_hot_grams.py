"""What a task holds of hot grams, and which grams are hot."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import suffix_dedup
from loomline.llm.workspace import Workspace
from test_llm_operators import repeated_by_brute_force
from test_packs import FAR, batches, far  # noqa: F401


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def all_hot(texts):
    """A batch in which every anchor is one of a hot gram."""
    places = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        places.append(np.unique(suffix_dedup.anchors(data, np.array([0, len(data)]))[2]))
    columns = {"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "at": pa.array(places, pa.list_(pa.int64())), "hot": pa.array([[True] * len(p) for p in places], pa.list_(pa.bool_()))}
    return pa.RecordBatch.from_pydict(columns)


def test_a_block_full_of_hot_windows_is_told_in_little_memory():
    """With a row of Python for each window, such a block of 1 MB took 478 MB and one of 3 MB 1,448 MB."""
    draw = np.random.default_rng(3)
    texts = [bytes(draw.integers(97, 123, 50_000, np.uint8)).decode() for _ in range(20)]
    batch = all_hot(texts)
    windows = sum(len(t) - 199 for t in texts)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in suffix_dedup._cut(False)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == windows > 900_000
    assert peak < 150_000_000


def test_equal_windows_in_a_block_are_spans_and_go_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    monkeypatch.setattr(suffix_dedup, "PAIRS", 7)
    draw = random.Random(4)
    passage = words(draw, 60)
    texts = [f"{words(draw, 40)} {passage} {words(draw, 40)}" for _ in range(9)]
    rows = [r for b in suffix_dedup._cut(False)([all_hot(texts)]) for r in b.to_pylist()]
    covered = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    spans = [r for r in rows if r["end"] is not None]
    for r in spans:
        covered[r["id"]][r["start"] : r["end"]] = True
    want = repeated_by_brute_force(list(enumerate(texts)))
    assert {i: int(c.sum()) for i, c in covered.items()} == {i: w[1] for i, w in want.items()}
    assert len(spans) < 3 * len(texts)
    sent = [(texts[r["id"]][r["start"] : r["start"] + 200], r["weight"]) for r in rows if r["low"] is not None]
    assert len(sent) == len(dict(sent)) == len({t[k : k + 200] for t in texts for k in range(len(t) - 199)})
    assert {w for s, w in sent if s in passage} == {2}


@pytest.mark.parametrize("hot", [199, 200])
def test_grams_are_hot_by_their_number_in_all_packs(far, hot):  # noqa: F811
    """Over HOT_HERE occurrences in a pack don't make a gram hot; their number goes with the one that stands for them."""
    draw = random.Random(5)
    passage = words(draw, 60)
    texts = [f"{words(draw, 1)} {passage} {words(draw, 1)}" for _ in range(200)]
    rows = [r for b in suffix_dedup._find(1, most=1_000)(batches(texts)) for r in b.to_pylist()]
    found = suffix_dedup._repeated(hot)(pa.Table.from_pylist([r for r in rows if r["bucket"] is not None])).to_pylist()
    told = {(r["id"], r["gram"]): r["hot"] for r in found if r["at"] is None}
    stood = {(r["base"], r["gram"]): r["ids"] for r in rows if r["ids"] is not None}
    assert told.keys() == stood.keys() and all(len(i) > suffix_dedup.HOT_HERE for i in stood.values())
    assert set(told.values()) == {hot < 200} and FAR << 38 in stood[min(stood)]


@pytest.mark.parametrize("hot", [10, suffix_dedup.HOT])
def test_passages_of_many_texts_whether_hot_or_not(spark, monkeypatch, hot):
    """Occurrences that stayed in their packs come back as hot or to be sorted, with the same result."""
    draw = random.Random(6)
    passage = words(draw, 50)
    texts = [f"{words(draw, draw.randint(3, 9))} {passage} {words(draw, 5)}" for _ in range(150)] + [passage, passage * 2, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(df, Workspace(spark, "test"), hot=hot).collect()}
    assert got == repeated_by_brute_force(list(enumerate(texts)))


def test_hits_of_a_bucket_are_held_as_spans():
    """Strings that repeat in all their windows: a hit for each, 137 a string at most, isn't held."""
    draw = np.random.default_rng(7)
    grams = [bytes(draw.integers(97, 123, 336, np.uint8)) for _ in range(600)]
    n = 5 * len(grams)
    table = pa.table({"id": pa.array(range(n), pa.int64()), "start": pa.array([500] * n, pa.int64()), "left": pa.array([136] * n, pa.int32()), "weight": pa.array([1] * n, pa.int32()), "bytes": pa.array(grams * 5, pa.binary())})
    table = pa.concat_tables([table, table.slice(0, 1).set_column(4, "bytes", pa.array([bytes(300)], pa.binary()))]).combine_chunks()
    tracemalloc.start()
    try:
        spans = suffix_dedup._match(table).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted((r["id"], r["start"], r["end"]) for r in spans) == [(i, 364, 700) for i in range(n)]
    assert peak < 8_000_000
