"""Each stage of the pipeline against what brute force makes of its own input, on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_llm_operators import level, roots, shingle_set
from tokenizers import Tokenizer

from loomline.llm import quality
from loomline.llm.workspace import Workspace


def test_stages(spark, sf_dir):
    work = Workspace(spark, "test")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = work.write(stage(spark, docs, sf_dir), name)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        ids = [r.doc_id for r in rows]
        if name == "quality":
            scores = quality.held_out_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "test"))
            assert sorted(ids) == sorted(r.doc_id for r in scores.where("score >= 0.5").collect())
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert sum(labels.get(i) == 1 for i in ids) >= 0.98 * sum(q == 1 for q in labels.values())
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
            assert sorted(ids) == sorted(first.values())
        if name == "near_dedup":
            sets = {i: shingle_set(r.text) for i, r in before.items()}
            found = roots([(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])], sets)
            assert sorted(ids) == sorted(i for i, c in found.items() if i == c)
        if name == "mixing":
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken = Counter(), Counter()
            for r in before.values():
                sizes[r.source] += count(r.text)
            for r in rows:
                taken[r.source] += count(r.text)
                assert (before[r.doc_id].text or "").startswith((r.text or "").strip()) or before[r.doc_id].text.strip().startswith(r.text.strip())
            assert dict(taken) == {s: int(t + 1e-6) for s, t in level(sizes).items()}
            texts = rows
        if name == "packing":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(r.length for r in rows) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in texts)
            by = defaultdict(list)
            for r in rows:
                by[r.sequence_id].append((r.offset, r.length))
            for parts in by.values():
                assert sum(n for _, n in parts) <= 2048 and max(o + n for o, n in parts) == sum(n for _, n in parts)
        docs, before = out, {r.doc_id: r for r in rows}
