"""Operator 4: license scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of letters and digits, lower-cased; shingles are five words. For each size class windows of `size`
shingles are laid at half-size steps over the whole text; a template belongs to the class whose windows hold it once or
up to eight times over, so a window that covers at least CONTAINMENT of a template has a Jaccard of at least 0.0975 with
it, and BANDS bands of one MinHash row each miss that with probability (1 - 0.0975)^BANDS < 0.002. Retrieved templates
are verified by exact shingle containment in the text around the window.

A window's MinHash can equal a template's only if its least shingle is a template's shingle. So only windows with such
shingles of its size class are hashed, which changes no result. Templates are a parameter of bounded size (they travel with the task).

One row for each document and template that reaches CONTAINMENT in some stretch of which no other template has more:
doc_id, license, containment, start_word, n_words (the span of its best such stretch), n_matches (such stretches). Null or short texts give no rows; null or repeated doc_ids are kept as they come;
of equal stretches the first is told; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from importlib import resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, texts
from .words import PUNCTUATION, Words, mixed, pieces

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
SIZE, GROWTH = 2, 4  # of the smallest class; each further one holds windows so many times as long, up to the longest template
#: Public licence notices in several wordings, headers of programs and files.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-distributed": "Distributed under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-terms": "under the terms of the MIT license",
    "Apache-2.0-released": "Released under the Apache License, Version 2.0.",
    "Apache-2.0-distributed": "Distributed under the Apache License, Version 2.0.",
    "Apache-2.0-short": "Licensed under the Apache License 2.0.",
    "BSD-licensed": "Licensed under the BSD License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-released": "Released under the GNU General Public License v3.0.",
    "GPL-3.0-licensed": "Licensed under the GNU GPL v3.",
    "GPL-2.0-released": "Released under the GNU General Public License v2.0.",
    "GPL-2.0-licensed": "Licensed under the GNU GPL v2.",
    "MPL-2.0-licensed": "Licensed under the Mozilla Public License 2.0.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
}
#: Whole licences and the BSD disclaimer; each file's name is the template's.
TEMPLATES = NOTICES | {f.name.removesuffix(".txt"): f.read_text() for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("n_matches", pa.int64())])
_SQL = "doc_id long, license string, containment double, start_word long, n_words long, n_matches long"
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mixed(h)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    return mixed(shingles[:, None] * _FACTORS).min(axis=0)


def best_stretch(hits: np.ndarray, codes: np.ndarray, n: int) -> tuple[float, int, int, np.ndarray]:
    """(containment, first word, words, hits) of the first stretch of 2n words with the most of n shingles; codes: which one a hit is."""
    best, at, code, count, distinct, j = (0, 0, 0), hits.tolist(), codes.tolist(), [0] * n, 0, 0
    for i, first in enumerate(at):
        while j < len(at) and at[j] < first + 2 * n:
            distinct += not count[code[j]]
            count[code[j]] += 1
            j += 1
        if distinct > best[0]:
            best = (distinct, i, j)
        count[code[i]] -= 1
        distinct -= not count[code[i]]
    share, i, j = best
    return (share / n, at[i], at[j - 1] + SHINGLE - at[i], hits[i:j]) if share else (0.0, 0, 0, hits)


class Stretch(NamedTuple):
    """A part of a text that holds a share of a template: its first word, words, and the places of the shared shingles."""

    name: str
    share: float
    first: int
    n: int
    hits: np.ndarray


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.sets: dict[str, np.ndarray] = {}
        self.bands: dict[int, dict[tuple[int, int], list[str]]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates.items():
            own = np.unique(shingle_hashes(Words([text.encode()], PUNCTUATION, fold=True).hashes))
            if not len(own):
                raise ValueError(f"{name}: a template needs {SHINGLE} words")
            self.sets[name] = own
            size = SIZE
            while len(own) > size // 2:
                size *= GROWTH
            for band, value in enumerate(minhashes(own).tolist()):
                self.bands[size][band, value].append(name)
        self.of = {s: np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.sets[k] for k in {k for names in b.values() for k in names})])) for s, b in self.bands.items()}
        self.all = np.unique(np.concatenate([*self.sets.values(), np.zeros(0, np.uint64)]))
        # a first look at 22 bits spares most shingles the search
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.all >> np.uint64(42)).astype(np.int64)] = True

    def marks(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some template has."""
        likely = np.flatnonzero(self.quick[(shingles >> np.uint64(42)).astype(np.int64)])
        return likely[np.isin(shingles[likely], self.all)]

    def stretches(self, shingles: np.ndarray, marks: np.ndarray) -> list[Stretch]:
        """Of each template the stretches of a text that hold enough of it; marks from marks()."""
        found: dict[tuple[str, int], Stretch] = {}
        for size, bands in self.bands.items():
            step = max(1, size // 2)
            seen: dict[str, set[int]] = defaultdict(set)
            own = marks[np.isin(shingles[marks], self.of[size])]  # other windows cannot equal a template of this class
            for at in sorted({max(0, w) * step for m in np.unique(own // step).tolist() for w in (m - 1, m)}):
                window = shingles[at : at + size]
                for band, value in enumerate(minhashes(window).tolist()):
                    for name in bands.get((band, value), ()):
                        seen[name].add(at)
            for name, windows in seen.items():
                own = self.sets[name]
                for at in sorted(windows):
                    # the stretch may go on in the next window
                    lo, hi = np.searchsorted(marks, (max(0, at - size), at + 2 * size))
                    hits = marks[lo:hi]
                    hits = hits[np.isin(shingles[hits], own)]
                    share, first, n, hits = best_stretch(hits, np.searchsorted(own, shingles[hits]), len(own))
                    if share >= CONTAINMENT:
                        found.setdefault((name, first), Stretch(name, share, first, n, hits))
        return sorted(found.values(), key=lambda s: (s.first, s.name))

    def scan(self, shingles: np.ndarray, marks: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """(template, containment, first word, words, stretches) for the shingles of one text, best stretch of each template.

        A stretch goes where another template has more of its own at the same place: then it is part of a body, or a like text.
        """
        found = self.stretches(shingles, marks)
        weight = [(round(s.share * len(self.sets[s.name])), s.share) for s in found]
        beaten, open_ = [False] * len(found), []
        for i, s in enumerate(found):
            open_ = [j for j in open_ if found[j].first + found[j].n > s.first]
            for j in open_:
                o = found[j]
                if o.name != s.name:
                    both = int(np.isin(s.hits, o.hits).sum())
                    beaten[i] |= weight[j] > weight[i] and 2 * both >= len(s.hits)
                    beaten[j] |= weight[i] > weight[j] and 2 * both >= len(o.hits)
            open_.append(i)
        rows: dict[str, list[Stretch]] = defaultdict(list)
        for s, worse in zip(found, beaten, strict=True):
            if not worse:
                rows[s.name].append(s)
        best = {name: min(own, key=lambda s: (-s.share, s.first)) for name, own in rows.items()}
        return sorted((name, s.share, s.first, s.n, len(rows[name])) for name, s in best.items())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            own = list(texts(b))
            # words of a text that comes in parts are joined again
            hashes: dict[int, list[np.ndarray]] = {}
            waiting = -1

            def close(i: int) -> None:
                h = shingle_hashes(np.concatenate(hashes.pop(i)))
                marks = known.marks(h)
                if len(marks):
                    rows.extend((ids[i], *r) for r in known.scan(h, marks))

            for owners, parts in pieces(own):
                w = Words(parts, PUNCTUATION, fold=True)
                ends = np.searchsorted(w.part, np.arange(len(parts) + 1))
                if waiting >= 0 and owners[0] != waiting:
                    close(waiting)
                # texts that lie whole in this piece are looked through at once
                joined = shingle_hashes(w.hashes)
                marks = known.marks(joined)
                touched = set(w.part[marks].tolist())
                for k, i in enumerate(owners):
                    whole = not (k == 0 and i == waiting) and not (k == len(owners) - 1)
                    if whole:
                        if k in touched and ends[k + 1] - ends[k] >= SHINGLE:
                            hashes[i] = [w.hashes[ends[k] : ends[k + 1]]]
                            close(i)
                    else:
                        hashes.setdefault(i, []).append(w.hashes[ends[k] : ends[k + 1]])
                        if i == waiting and len(owners) > 1 and k == 0:
                            close(i)
                waiting = owners[-1]
            for i in list(hashes):
                close(i)
            if rows:
                yield batch_of(_OUT, zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, _SQL)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
