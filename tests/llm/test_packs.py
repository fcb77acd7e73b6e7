"""Ids and packed rows of very many partitions, buckets and equal keys."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import jaccard_join, suffix_dedup
from loomline.llm.textual import Packs, first_id, unpacked
from loomline.llm.workspace import Workspace
from test_llm_operators import corpus

FAR = 5_000_000


def entries(columns, name, kind):
    """(bucket, id, number) of all entries of packed columns."""
    rows = pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).to_pylist() if columns else []
    return [(r["bucket"], int(i), int(x)) for r in rows for i, x in zip(unpacked(r), np.frombuffer(r[name], kind), strict=True)]


@pytest.mark.parametrize("buckets", [1, 7, 5000])
def test_packs_hold_what_was_added(buckets):
    draw = np.random.default_rng(buckets)
    packs, want, at = Packs(buckets, first_id(FAR), 1000), [], 0
    for _ in range(4):
        doc = np.sort(draw.integers(0, 70_000, 300)) + at
        at += 70_000
        home, x = draw.integers(0, buckets, 300), draw.integers(0, 1 << 63, 300).astype(np.uint64)
        packs.add(home, doc, x=x)
        want += [(int(h), first_id(FAR) + int(d), int(v)) for h, d, v in zip(home, doc, x, strict=True)]
    assert packs.full() and sorted(entries(packs.flush(), "x", np.uint64)) == sorted(want)
    assert packs.flush() == {} and not packs.full()


def test_packed_bytes_hardly_grow_with_the_buckets():
    draw = np.random.default_rng(1)
    size = {}
    for buckets in (128, 200_000):
        packs = Packs(buckets, first_id(3))
        packs.add(draw.integers(0, buckets, 2_000_000), np.sort(draw.integers(0, 50_000, 2_000_000)), keys=draw.integers(0, 1 << 63, 2_000_000).astype(np.uint64))
        columns = packs.flush()
        size[buckets] = sum(c.nbytes for c in columns.values()) + 48 * len(columns["bucket"])  # what a row of Spark has besides
    assert size[200_000] < 2 * size[128]


def held_by(bits):
    return type("Held", (), {"value": bits})()


@pytest.fixture
def far(monkeypatch):
    for module in (jaccard_join, suffix_dedup):
        monkeypatch.setattr(module.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: FAR})()))


def batches(texts):
    return [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})]


def test_ids_of_a_far_partition(far):
    texts = [r[1] for r in corpus()]
    for made in (suffix_dedup._find(99)(batches(texts)), jaccard_join._sketch(held_by(np.zeros(1 << 17, np.uint8)), 99)(batches(texts))):
        rows = [r for b in made for r in b.to_pylist()]
        ids = [r["id"] for r in rows if r["id"] is not None]
        assert ids == list(range(FAR << 38, (FAR << 38) + len(texts)))
        assert {i for r in rows if r["bucket"] is not None for i in unpacked(r).tolist()} <= set(ids)
    assert first_id((1 << 25) - 1) + (1 << 38) - 1 == (1 << 63) - 1


def test_keys_of_very_many_sets_go_once_a_pack(far):
    """All texts share a passage: its grams and segment keys reach their buckets once for each pack."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [f"{word()} {passage} {word()}" for _ in range(900)]
    for made, name in ((suffix_dedup._find(4, most=20_000)(batches(texts)), "grams"), (jaccard_join._sketch(held_by(np.zeros(1 << 17, np.uint8)), 4, most=20_000)(batches(texts)), "keys")):
        rows = [r for b in made for r in b.to_pylist() if r["bucket"] is not None]
        packs = len({r["base"] for r in rows})
        numbers = np.concatenate([np.frombuffer(r[name], np.uint64) for r in rows])
        assert np.unique(numbers, return_counts=True)[1].max() <= packs * 64
        assert len(numbers) < 900 * 12


@pytest.mark.parametrize("hot_here", [1, 3, 10_000])
def test_stars_are_the_same_however_hot_keys_are(spark, monkeypatch, hot_here):
    """Whether a key's sets meet in its bucket or in the packs first, each is joined to the key's first one."""
    texts = [r[1] for r in corpus()]
    texts = texts + [t and f"{t} more" for t in texts] + texts
    task = jaccard_join._sketch(held_by(np.zeros(1 << 17, np.uint8)), 5, most=400, hot_here=hot_here)
    plain = jaccard_join._sketch(held_by(np.zeros(1 << 17, np.uint8)), 5, hot_here=10_000)
    found = []
    for f in (task, plain):
        monkeypatch.setattr(jaccard_join.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 2})()))
        made = pa.Table.from_batches(list(f(batches(texts))))
        stars = jaccard_join.stars_of(spark.createDataFrame(made), Workspace(spark, "test"))
        found.append(sorted(map(tuple, stars.collect())))
    assert found[0] == found[1] and found[0]
