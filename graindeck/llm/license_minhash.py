"""License scans: MinHash bands over overlapping text windows retrieve templates; exact containment verifies.

Templates are whole license texts (the files beside this module, named by their SPDX ids) and short notices. A
template of w words is looked for in windows of about its length that start every quarter of it. Windows and
templates share a band of equal minimum hashes with a probability set by ``bands`` and ``rows``: a window of
Jaccard similarity j to a template is retrieved with probability 1 - (1 - j^rows)^bands (see ``recall``). What is
retrieved is verified by the exact share of the template's shingles that the window's surroundings contain. Shingles
are of five words, those of notices of fewer than LONG words of two.

Defined results: null and empty texts have no license; templates repeat freely; an empty template table finds
nothing; repeated documents are each scanned; a text of any length is scanned whole; columns other than doc_id and
text are ignored, whatever their names. Of templates found at one place all are listed, sorted by name; of equal
containments (ties) the first place and the smaller name count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from graindeck.llm.common import arrow_map
from graindeck.llm.wu_manber import words_of

# Opening sentences of well-known public licenses, and the short notices that stand for them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation"
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Words of a shingle of notices and of longer templates, words from which a template is long, and bands.
SHORT, SHINGLE, LONG, BANDS, ROWS, CONTAINMENT = 2, 5, 60, 16, 2, 0.8
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def templates() -> list[tuple[str, str]]:
    """Names and texts of all templates: a few hundred kilobytes."""
    texts = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(__file__).with_name("licenses").glob("*.txt"))]
    return [*NOTICES, *texts]


def recall(j: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a window of similarity j to a template is retrieved."""
    return 1 - (1 - j**rows) ** bands


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered; the memory is cleared when full."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; of fewer words, one of all."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        h = mixed(h * _MULT + words[i : len(words) - size + 1 + i])
    return h


class WindowScanner:
    """Templates whose shingles have one size."""

    def __init__(self, templates: list[tuple[str, str]], size: int, bands: int = BANDS, rows: int = ROWS, containment: float = CONTAINMENT):
        self.size, self.bands, self.rows, self.containment = size, bands, rows, containment
        self.hashes = WordHashes()
        rng = np.random.default_rng(20)
        self.seeds = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
        self.templates: list[tuple[str, frozenset[int], int]] = []
        self.lengths: dict[int, dict[int, list[int]]] = {}  # window length in shingles -> band key -> templates
        self.needed: dict[int, int] = {}  # window length -> shingles that the smallest template needs
        for name, text in sorted({(str(n), t) for n, t in templates if n is not None and t is not None}):
            s = shingles(self.hashes.of(words_of(text)), size)
            if not len(s):
                continue
            own = frozenset(s.tolist())
            self.templates.append((name, own, len(s)))
            length = 1 << max(1, math.ceil(math.log2(len(s))))
            # places of shingles, repeats included, so their number is not below that of distinct ones
            self.needed[length] = min(self.needed.get(length, len(s)), math.ceil(containment * len(own) - 1e-9))
            table = self.lengths.setdefault(length, {})
            for key in self.band_keys(self.minima(s)[None, :])[0]:
                table.setdefault(int(key), []).append(len(self.templates) - 1)
        self.vocabulary = np.unique(np.array([x for _, s, _ in self.templates for x in s], dtype=np.uint64))
        self.keys = {n: np.unique(np.array(list(t), dtype=np.uint64)) for n, t in self.lengths.items()}

    def minima(self, s: np.ndarray) -> np.ndarray:
        return mixed(s[None, :] ^ self.seeds[:, None]).min(axis=1)

    def band_keys(self, m: np.ndarray) -> np.ndarray:
        """Keys (n, bands) of minima (n, bands * rows)."""
        m = m.reshape(len(m), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), m.shape[:2])
        for r in range(self.rows):
            key = mixed(key * _MULT + m[:, :, r])
        return key

    def windows(self, s: np.ndarray, near: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the overlapping windows, and their minima. ``near``: which shingles any template has.

        A window whose surroundings hold fewer such shingles than the smallest template of this length needs for its
        containment cannot be verified, so its minima are not worked out.
        """
        stride, n = max(1, length // 4), len(s)
        starts = np.arange(0, max(0, -(-(n - length) // stride)) + 1) * stride
        upto = np.r_[0, np.cumsum(near)]
        held = upto[np.minimum(n, starts + 2 * length)] - upto[np.maximum(0, starts - length)]
        starts = starts[held >= self.needed[length]]
        out = np.empty((len(starts), len(self.seeds)), np.uint64)
        for a in range(0, len(starts), step := max(1, 2_000_000 // (length * len(self.seeds)))):
            index = starts[a : a + step, None] + np.arange(length)
            rows = mixed(s[np.minimum(index, n - 1)][:, :, None] ^ self.seeds)
            rows[index >= n] = _NONE
            out[a : a + step] = rows.min(axis=1)
        return starts, out

    def find(self, hashes: np.ndarray) -> list[tuple[str, int, float]]:
        """Name, first word and containment of the best place of each template name found, in the hashes of words."""
        s = shingles(hashes, self.size)
        best: dict[str, tuple[float, int]] = {}
        if not len(s) or not len(self.vocabulary):
            return []
        near = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, s), len(self.vocabulary) - 1)] == s
        if not near.any():
            return []
        for length, table in self.lengths.items():
            starts, m = self.windows(s, near, length)
            for a in range(0, len(starts), 4096):
                keys = self.band_keys(m[a : a + 4096])
                hit = np.isin(keys, self.keys[length])
                tried = {(int(starts[a + i]), t) for i, j in zip(*np.nonzero(hit), strict=True) for t in table[int(keys[i, j])]}
                for start, t in tried:
                    name = self.templates[t][0]
                    share = self.contained(s, start, length, t)
                    if share >= self.containment and (share, -start) > best.get(name, (0.0, -(10**12))):
                        best[name] = (share, -start)
        return sorted((name, -start, share) for name, (share, start) in best.items())

    def contained(self, s: np.ndarray, start: int, length: int, t: int) -> float:
        """The share of a template's shingles around a window; a template may begin between two windows."""
        want = self.templates[t][1]
        return len(want.intersection(s[max(0, start - length) : start + 2 * length].tolist())) / len(want)


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, str]], **settings):
        self.hashes = WordHashes()
        known = [(str(n), t, len(words_of(t))) for n, t in templates if n is not None and t is not None]
        by_size = ((SHORT, [(n, t) for n, t, k in known if k < LONG]), (SHINGLE, [(n, t) for n, t, k in known if k >= LONG]))
        self.parts = [WindowScanner(own, size, **settings) for size, own in by_size if own]

    def find(self, text: str | None) -> list[tuple[str, int, float]]:
        """Name, first word and containment of the best place of each license found."""
        hashes, best = self.hashes.of(words_of(text)), {}
        for part in self.parts:
            for name, start, share in part.find(hashes):
                best[name] = max(best.get(name, (0.0, 0)), (share, -start))
        return sorted((name, -start, share) for name, (share, start) in best.items())


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, **settings) -> DataFrame:
    """doc_id, the sorted licenses found, their number, the largest containment (0 if none) and its license, of every
    document. texts: names and texts of templates, a small table; by default ``templates()``."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(templates() if texts is None else list(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(held.value, **settings)
        for b in batches:
            found = [scanner.find(t.as_py()) for t in b.column(1)]
            top = [min(f, key=lambda x: (-x[2], x[0])) if f else (None, 0, 0.0) for f in found]
            columns = [
                pa.array([",".join(n for n, _, _ in f) for f in found], type=pa.string()), pa.array([len(f) for f in found], type=pa.int64()),
                pa.array([x[2] for x in top], type=pa.float64()), pa.array([x[0] for x in top], type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "licenses", "n_licenses", "containment", "best_license"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, licenses string, n_licenses bigint, containment double, best_license string")
