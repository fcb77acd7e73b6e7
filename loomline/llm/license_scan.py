"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .license_notices import notices, whole_texts
from .textual import mix, runs, slices, span_hashes

SHINGLE = 5
LEAST = 0.75
MISSED = 1e-4
BLOCK = 3_000_000

# Notices that licences ask for, or by which works are put under them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "rights-reserved": "All rights reserved.",
}

#: By byte: letters and digits of ASCII, and all bytes of other characters, make up words.
WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
WORDS = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return [w.lower() for w in WORDS.findall(text.encode("utf-8", "surrogatepass"))]


def grams(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def containment(template: set, words: list[bytes], width: int) -> float:
    """Share of the template's shingles that the words hold."""
    return len(template & grams(words, width)) / len(template)


def bands_for(least: float, missed: float) -> int:
    """Bands of one MinHash each, such that a window that holds ``least`` of a template is missed with probability ``missed`` at most.

    A class of templates has between half and all of L shingles; a window of at
    most 1.5 L shingles holds every run of L. So a match has a Jaccard similarity
    of at least s = (least * L/2) / (1.5 L + (1 - least) * L/2), and is missed with
    probability (1 - s) ** bands.
    """
    similar = least * 0.5 / (1.5 + (1 - least) * 0.5)
    return int(np.ceil(np.log(missed) / np.log(1 - similar)))


class Index:
    """Templates by class of length; the MinHash values of each, by permutation.

    A name has a text or several. Those in ``exact`` are held as a whole only.
    """

    def __init__(self, templates: dict[str, str | list[str]], least: float, missed: float, seed: int = 11, exact: dict[str, list[str]] | None = None) -> None:
        self.least, self.bands = least, bands_for(least, missed)
        draw = np.random.default_rng(seed)
        self.seeds = draw.integers(1, 1 << 63, self.bands, np.uint64) | np.uint64(1)
        self.templates = []  # (name, words, width, shingles, share that must be held)
        self.classes: dict[tuple[int, int], list[int]] = {}
        listed = {(name, text): least for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)}
        listed = {(name, text): 1.0 for name, texts in (exact or {}).items() for text in texts} | listed
        seen = set()
        for (name, text), share in sorted(listed.items(), key=lambda x: (x[1], x[0])):
            words = words_of(text)
            if not words or (name, *words) in seen:
                continue
            seen.add((name, *words))
            width = min(SHINGLE, len(words))
            shingles = grams(words, width)
            length = 1 << int(np.ceil(np.log2(len(words) - width + 1)))
            self.classes.setdefault((width, length), []).append(len(self.templates))
            self.templates.append((name, words, width, shingles, share))
        self.values, self.known, self.need = {}, {}, {}
        for (width, length), members in self.classes.items():
            made = [self.hashes(self.templates[t][1], width) for t in members]
            self.values[width, length] = np.stack([[self.permuted(h, s).min() for s in self.seeds] for h in made])
            self.known[width, length] = np.unique(np.concatenate(made))
            self.need[width, length] = min(max(1, int(np.ceil(share * len(shingles) - 1e-9))) for _, _, _, shingles, share in (self.templates[t] for t in members))
        #: By width: all templates' shingles, and by the top 20 bits of a hash whether there is one.
        self.all = {w: np.unique(np.concatenate([h for (v, _), h in self.known.items() if v == w])) for w, _ in self.classes}
        self.top = {}
        for w, h in self.all.items():
            self.top[w] = np.zeros(1 << 20, bool)
            self.top[w][(h >> np.uint64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray, width: int) -> np.ndarray:
        """Where a shingle of some template stands."""
        at = np.flatnonzero(self.top[width][(h >> np.uint64(44)).astype(np.int64)])
        return at[np.isin(h[at], self.all[width])]

    @staticmethod
    def hashes(words: list[bytes], width: int) -> np.ndarray:
        data = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return shingle_hashes(span_hashes(data, ends - [len(w) for w in words], ends), width)

    @staticmethod
    def permuted(h: np.ndarray, seed: np.uint64) -> np.ndarray:
        h = h * seed
        return h ^ (h >> np.uint64(32))


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(h)]
    return mix(h)


def retrieve(h: np.ndarray, places: np.ndarray, length: int, index: Index, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(template, first shingles of windows) where a band of the window's MinHash equals the template's.

    Windows of 1.5 L shingles overlap by L, so that each run of L lies in one; a
    window's minima come from those of its blocks of half an L. Windows with fewer
    of the class's shingles than any of its templates asks for can't hold one, and
    get no minima.
    """
    step, wide = (length // 2, 3) if length > 1 else (1, 1)
    blocks = -(-len(h) // step)
    members, values = index.classes[width, length], index.values[width, length]
    found, count = np.unique(places[np.isin(h[places], index.known[width, length])] // step, return_counts=True)
    some, at = np.unique(np.concatenate([found - k for k in range(wide)]), return_inverse=True)
    held = np.bincount(at, np.tile(count, wide), len(some))
    windows = some[(held >= index.need[width, length]) & (some >= 0)]
    if not len(windows):
        return
    used, back = np.unique(np.minimum(windows[:, None] + np.arange(wide), blocks - 1), return_inverse=True)
    padded = h[np.minimum(used[:, None] * step + np.arange(step), len(h) - 1)]
    back = back.reshape(len(windows), wide)
    hit = np.zeros((len(members), len(windows)), bool)
    for k, seed in enumerate(index.seeds):
        low = index.permuted(padded, seed).min(1)[back].min(1)
        hit |= low == values[:, k, None]
    for m, t in enumerate(members):
        yield t, windows[hit[m]] * step


SCAN = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_places", pa.int64())])


def scan_texts(ids: list[int | None], texts: list[str | None], index: Index) -> pa.RecordBatch:
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    starts, ends = runs(WORD[data])
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1), starts, "right")
    first = np.searchsorted(doc, np.arange(len(raw) + 1))
    word = span_hashes(data, starts, ends)
    whole = data.tobytes()
    found: dict[tuple[int, str], list] = {}  # share and first word of the best window, starts and ends of all places
    for width in {w for w, _ in index.classes}:
        h = shingle_hashes(word, width)
        places = index.places(h, width)
        for length in sorted(n for w, n in index.classes if w == width):
            for t, windows in retrieve(h, places, length, index, width) if len(h) else ():
                name, words, _, shingles, least = index.templates[t]
                span = length + max(1, length // 2) + width
                for place in windows.tolist():
                    for d in range(doc[place], doc[min(place + span, len(doc)) - 1] + 1):
                        a, b = max(place, first[d]), min(place + span, first[d + 1])
                        some = [whole[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                        share = containment(shingles, some, width) if b - a >= width else 0.0
                        if share >= least:
                            inner = next(k for k in range(len(some) - width + 1) if tuple(some[k : k + width]) in shingles)
                            best = found.setdefault((d, name), [share, int(a - first[d]) + inner, set()])
                            if share > best[0]:
                                best[:2] = share, int(a - first[d]) + inner
                            best[2].add((int(a) + inner, int(a) + inner + len(words)))
    rows = []
    for (d, name), (share, at, all_) in found.items():
        # Windows, and texts of a name, overlap: a place ends where the last of them does.
        n, done = 0, -1
        for start, end in sorted(all_):
            n, done = n + (start >= done), max(done, end)
        rows.append((ids[d], name, share, at, n))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SCAN)], schema=SCAN)


def license_scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, least: float = LEAST, missed: float = MISSED) -> DataFrame:
    """(doc_id, license, containment, first_word, n_places) for each document and template that it holds.

    A template is held where a window has at least ``least`` of its distinct
    shingles of five words (of all its words, if fewer), letters A-Z lower-cased and
    punctuation aside. Without ``templates`` these are TEMPLATES, the whole texts and
    headers of ``license_notices``, and its notices, which must be held as a whole.
    A license's notices make one row. ``containment`` and ``first_word`` tell of the best window,
    counted in words from 0; ``n_places`` of how many separate places. A match in a
    window is missed with probability ``missed`` at most, by ``bands_for``; exact
    copies are missed far less. What is returned is verified on the words.

    The list of templates is small, and each task has it. Null and empty texts,
    and documents without any template, give no rows; each row of a repeated doc_id
    gives its own. Other columns are ignored.
    """
    ship(docs.sparkSession)
    index = Index(TEMPLATES | whole_texts(), least, missed, exact=notices()) if templates is None else Index(templates, least, missed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK):
                yield scan_texts(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), index)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, license string, containment double, first_word long, n_places long")
