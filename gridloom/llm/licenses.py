"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of ASCII letters and digits, or of other non-ASCII characters, in ASCII lower case. A template is retrieved by windows of
twice its stride, where a window holds every place of the template whole: windows overlap by half. Templates of similar length share windows. Each window has the
minima of its word shingles under a family of hash functions; a band is ``ROWS`` of them. The number of bands of a
length class follows from the least resemblance that a window around a match can have, so that a match meets in some band with probability
``CERTAINTY`` or more. Windows that meet a template are verified on their words: the share of the template's shingles that stand in the window
must be ``CONTAINMENT`` or more.

A template's hits that overlap are one match, from the first to the last shingle of its best window. Templates are few and given with the code or by the
caller; they go to the tasks with the closure, and documents are not shuffled.

Defined results: null and blank texts have no match; a text shorter than a template's words can still match by containment; every input row
gives one row; further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHINGLE = 5
CONTAINMENT = 0.8
CERTAINTY = 0.999
#: Minima in a band: one, since a short template is a small part of its window.
ROWS = 1
#: Bytes hashed at once, and characters of texts searched together.
BLOCK = 1 << 20
TOGETHER = 400_000

#: Short forms and notices of common licenses.
TEMPLATES = {
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IN_WORD[_a:_b] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of the SplitMix64 generator."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes and byte places of a text's words."""

    def __init__(self):
        inverse = pow(int(_BASE), -1, 1 << 64)
        self.up, self.down = _powers(int(_BASE), BLOCK + 1), _powers(inverse, BLOCK + 1)

    def block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], _IN_WORD[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        return mixed((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64)), start, stop

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, stop) of every word; long texts in blocks that end between words where they can."""
        a = np.frombuffer(data, dtype=np.uint8)
        if len(a) <= BLOCK:
            return self.block(a)
        parts, at = [], 0
        while at < len(a):
            end = min(len(a), at + BLOCK)
            if end < len(a):
                gaps = np.flatnonzero(~_IN_WORD[a[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
            h, s, e = self.block(a[at:end])
            parts.append((h, s + at, e + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words, if fewer."""
    n = max(1, len(words) - size + 1) if len(words) else 0
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n] * np.uint64(2 * k + 3)
    return mixed(out)


def bands_for(resemblance: float, rows: int, certainty: float = CERTAINTY) -> int:
    """The least number of bands in which a pair of that resemblance meets with the given probability."""
    return math.ceil(math.log(1 - certainty) / math.log(1 - resemblance**rows))


def classes(templates: dict[str, list[bytes]]) -> list[dict]:
    """Templates by stride (a power of two, no less than their shingles with a quarter to spare), with the bands of each class."""
    by_stride: dict[int, list[str]] = {}
    for name, words in templates.items():
        n = max(1, len(words) - SHINGLE + 1)
        by_stride.setdefault(1 << math.ceil(math.log2(max(2, 1.25 * n))), []).append(name)
    out = []
    for stride, names in sorted(by_stride.items()):
        least = min(max(1, len(templates[n]) - SHINGLE + 1) for n in names)
        shared = math.ceil(CONTAINMENT * least)
        out.append({"stride": stride, "names": sorted(names), "bands": bands_for(shared / (2 * stride + least - shared), ROWS)})
    return out


class Finder:
    """Finds templates in texts, many texts at a time."""

    def __init__(self, templates: dict[str, str]):
        self.words = Words()
        self.templates = {k: _WORD.findall(v.encode().lower()) for k, v in templates.items()}
        self.templates = {k: v for k, v in self.templates.items() if v}
        self.sets = {k: set(self.exact(v)) for k, v in self.templates.items()}
        self.classes = classes(self.templates)
        n = max((c["bands"] for c in self.classes), default=0)
        self.seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _BASE).reshape(-1, 2) | np.uint64(1)
        for c in self.classes:
            c["keys"] = [[] for _ in range(c["bands"])]
            for name in c["names"]:
                h = shingles(self.words.of(b" ".join(self.templates[name]))[0])
                for band in range(c["bands"]):
                    c["keys"][band].append((self.hashed(h, band).min(), name))

    def hashed(self, h: np.ndarray, k: int) -> np.ndarray:
        return (h ^ self.seeds[k, 0]) * self.seeds[k, 1]

    @staticmethod
    def exact(words: list[bytes]) -> list[tuple[bytes, ...]]:
        return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [tuple(words)]

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """(text, first shingle, last + 1, template) of the windows that meet a template in a band. h: the texts' shingles; first: each text's place in h, and the end."""
        found = set()
        layout = []
        for c in self.classes:
            size = np.diff(first)
            blocks = -(-size // c["stride"])
            text = np.repeat(np.arange(len(size)), blocks)
            at = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = first[text] + at * c["stride"]
            alone = np.flatnonzero(blocks[text] == 1)
            paired = np.flatnonzero(text[:-1] == text[1:]) if len(text) else alone
            layout.append((starts, text, at, alone, paired))
        for k in range(len(self.seeds)):
            values = self.hashed(h, k)
            for c, (starts, text, at, alone, paired) in zip(self.classes, layout, strict=True):
                if k >= c["bands"]:
                    continue
                low = np.minimum.reduceat(values, starts)
                two = np.minimum(low[:-1], low[1:])
                for value, name in c["keys"][k]:
                    if (low == value).any():
                        for w in [*paired[two[paired] == value], *alone[low[alone] == value]]:
                            t = int(text[w])
                            a = int(at[w]) * c["stride"]
                            found.add((t, a, min(int(first[t + 1] - first[t]), a + 2 * c["stride"]), name))
        return found

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """(template, start, end, containment) of each text's matches: code points, end exclusive; by start, then name."""
        data = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data])
        hashes, start, stop = self.words.of(b"\n".join(data))
        word = np.concatenate([[0], np.searchsorted(start, ends)])
        h, first = [], [0]
        for a, b in zip(word[:-1], word[1:], strict=True):
            h.append(shingles(hashes[a:b]))
            first.append(first[-1] + len(h[-1]))
        out: list[list] = [[] for _ in texts]
        if not first[-1]:
            return out
        best: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
        for t, a, z, name in sorted(self.candidates(np.concatenate(h), np.array(first))):
            base, shift = int(word[t]), int(ends[t]) - len(data[t]) - 1
            end = min(int(word[t + 1]) - base, z + SHINGLE - 1)
            there = self.exact([data[t][start[base + i] - shift : stop[base + i] - shift].lower() for i in range(a, end)])
            hits = [i for i, g in enumerate(there) if g in self.sets[name]]
            share = len({there[i] for i in hits}) / len(self.sets[name])
            if share >= CONTAINMENT:
                best.setdefault((t, name), []).append((share, a + hits[0], min(end, a + hits[-1] + SHINGLE)))
        for (t, name), hits in best.items():
            base, shift = int(word[t]), int(ends[t]) - len(data[t]) - 1
            taken: list[tuple[int, int]] = []
            for share, a, b in sorted(hits, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    out[t].append((name, len(data[t][: start[base + a] - shift].decode()), len(data[t][: stop[base + b - 1] - shift].decode()), share))
        return [sorted(x, key=lambda m: (m[1], m[0])) for x in out]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_matches, licenses array of (license, start, end, containment)) for every row of docs(doc_id, text)."""
    templates = dict(templates or TEMPLATES)
    names = ("license", "start", "end", "containment")
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        finder = Finder(templates)
        for b in batches:
            texts, found, at = b.column(1).to_pylist(), [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") < TOGETHER):
                    size += len(texts[stop] or "")
                    stop += 1
                found += finder.find(texts[at:stop])
                at = stop
            rows = [[dict(zip(names, m, strict=True)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(rows, kind)], ["doc_id", "n_matches", "licenses"])

    schema = "doc_id long, n_matches long, licenses array<struct<license: string, start: long, end: long, containment: double>>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
