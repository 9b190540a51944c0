"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Every template of ``n`` shingles is sought in windows of ``n`` shingles of a document that start every ``n // 8``
shingles, and in its last one, so an occurrence lies at most ``n // 16`` shingles beside some window. With ``BANDS``
bands of ``ROWS`` minhashes a window of Jaccard similarity ``s`` collides with probability ``1 - (1 - s**ROWS)**BANDS``:
0.995 at 0.7, 0.97 at 0.6. An exact copy of a template of fewer than 16 shingles always does, one of a longer template,
whose nearest window has a similarity of 15/17 at least, with a probability above 0.99999.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, token_hashes

BANDS, ROWS, CONTAINMENT = 8, 2, 0.8

#: Production templates: name -> notice.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def word_hash(word: str) -> int:
    """As Spark's ``xxhash64(word, 42)`` of two columns, a string and an int."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return xxhash.xxh64_intdigest((42).to_bytes(4, "little"), h)


def shingles(tokens: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words of each text, of a lone word the word; and where each text's begin."""
    t = tokens.view(np.uint64)
    bounds = np.array([0, len(t)]) if bounds is None else bounds
    size = np.diff(bounds)
    keep = np.maximum(size - 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(keep)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], keep)
    alone = np.repeat(size == 1, keep)
    return np.where(alone, t[at], _spread(t[at] * np.uint64(3) + t[np.minimum(at + 1, max(0, len(t) - 1))])), out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scanner:
    """The templates' shingles and bands, and the scan of one text."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.containment, self.bands, self.rows = containment, bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
        self.names, self.sets = list(templates), []
        self.by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in enumerate(templates.values()):
            s, _ = shingles(np.array([word_hash(w) for w in words(text)], np.uint64))
            self.sets.append(np.unique(s))
            if len(s):
                mins = np.array([self._hash(s, k).min() for k in range(bands * rows)])
                self.by_length.setdefault(len(s), []).append((i, self._keys(mins[:, None])[:, 0]))
        self.keys = {n: [{} for _ in range(bands)] for n in self.by_length}
        for n, members in self.by_length.items():
            for i, keys in members:
                for b in range(bands):
                    self.keys[n][b].setdefault(int(keys[b]), []).append(i)
        self.least = {n: min(int(np.ceil(containment * len(self.sets[i]) - 1e-9)) for i, _ in members) for n, members in self.by_length.items()}
        self.length = {i: n for n, members in self.by_length.items() for i, _ in members}
        self.near = {n: [np.zeros(1 << 16, bool) for _ in range(bands)] for n in self.keys}
        for n, tables in self.keys.items():
            for b, known in enumerate(tables):
                self.near[n][b][[k >> 48 for k in known]] = True
        self._levels: dict = {}

    def _hash(self, s, k):
        return ((s * self.a[k]) >> np.uint64(32)).astype(np.uint32)

    def _keys(self, mins):
        out = np.zeros((self.bands, mins.shape[1]), np.uint64)
        mins = mins.astype(np.uint64)
        for r in range(self.rows):
            out = out * _MIX + mins[r :: self.rows]
        return out

    def candidates(self, s: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """``(text, template, window start)`` of windows that share a band; text ``i`` has ``s[bounds[i]:bounds[i + 1]]``."""
        found = set()
        size = np.diff(bounds)
        for n in self.by_length:
            long = np.flatnonzero(size >= n)
            if len(long):
                found |= self._windows(s, bounds, long, n, n)
            # A shorter text is one window, if it has enough shingles for a verified match.
            short = np.flatnonzero((size < n) & (size >= self.least[n]))
            for w in np.unique(size[short]):
                found |= self._windows(s, bounds, short[size[short] == w], n, int(w))
        self._levels = {}
        return sorted(found)

    def _windows(self, s, bounds, texts, n, w) -> set[tuple[int, int, int]]:
        """Candidates among the windows of ``w`` shingles of some texts that have as many."""
        step = max(1, n // 8)
        last = bounds[texts + 1] - w
        many = (last - bounds[texts]) // step + 1
        at = np.repeat(bounds[texts], many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        off = (last - bounds[texts]) % step > 0
        at, of = np.append(at, last[off]), np.append(np.repeat(texts, many), texts[off])
        wide = 1 << (w.bit_length() - 1)
        found = set()
        for b in range(self.bands):
            keys = np.zeros(len(at), np.uint64)
            for r in range(self.rows):
                level = self._level(s, b * self.rows + r, wide)
                keys = keys * _MIX + (np.minimum(level[at], level[at + w - wide]) if w > wide else level[at])
            for j in np.flatnonzero(self.near[n][b][keys >> np.uint64(48)]):
                found.update((int(of[j]), t, int(at[j] - bounds[of[j]])) for t in self.keys[n][b].get(int(keys[j]), ()))
        return found

    def _level(self, s, k, width):
        """Minima of hash ``k`` over every ``width`` neighbouring shingles, a power of two."""
        if (k, width) not in self._levels:
            if width == 1:
                self._levels[k, 1] = self._hash(s, k)
            else:
                half = self._level(s, k, width // 2)
                self._levels[k, width] = np.minimum(half[: len(half) - width // 2], half[width // 2 :])
        return self._levels[k, width]

    def contained(self, s: np.ndarray, template: int, start: int) -> float:
        """Share of the template's shingles in the window at ``start``, widened by an eighth on both sides."""
        want = self.sets[template]
        n = self.length[template]
        slack = max(1, n // 8)
        return float(np.isin(want, s[max(0, start - slack) : start + n + slack]).mean())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, license, containment, n_windows)``: each template found in each document, with its best containment.

    Null, empty and wordless texts give no rows, nor does an empty table; texts of any length are searched whole. A
    repeated row gives its rows again. Windows never cross documents, so rows don't depend on how ``docs`` is
    partitioned; ``n_windows`` counts the windows in which the template was verified, ties included. The templates are
    a parameter of fixed size; other columns are dropped.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, containment))
    bound_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        known = scanner.value
        for batch in slices(batches, 2 << 20):
            tokens = batch.column(1).fill_null([])
            flat = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            out: dict[tuple[int, int], list] = {}
            s, bounds = shingles(flat, tokens.offsets.to_numpy().astype(np.int64) - tokens.offsets[0].as_py())
            for row, t, start in known.candidates(s, bounds):
                share = known.contained(s[bounds[row] : bounds[row + 1]], t, start)
                if share >= known.containment:
                    best = out.setdefault((row, t), [0.0, 0])
                    best[:] = [max(best[0], share), best[1] + 1]
            keys = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([known.names[t] for _, t in keys], pa.string()), pa.array([out[k][0] for k in keys], pa.float64()), pa.array([out[k][1] for k in keys], pa.int32())],
                [id, "license", "containment", "n_windows"],
            )

    return docs.select(F.col(f"`{id}`").alias("id"), token_hashes(F.col(f"`{text}`")).alias("tokens")).mapInArrow(run, f"`{id}` {kind}, license string, containment double, n_windows int")
