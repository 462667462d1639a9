"""License scans: which license notices a document holds, how much of them, and where.

Templates and documents are words (letters, digits, dots within numbers apart; lower case). Each template's k-grams are winnowed: of
every WINDOW consecutive ones the least hash is a fingerprint, so that any run of GRAM + WINDOW - 1 words that a document shares with a
template has a fingerprint in common (of templates under SHORT words every k-gram is one). An inverted index of the fingerprints gives candidates
(template, diagonal); around a diagonal with as many hits as a notice must have (`least_hits`) a banded alignment counts the matched words, in
numpy rows of the whole band. Each diagonal is aligned by itself, however many there are, so that notices side by side are all found. A notice
is reported if the matched words are at least `coverage` of the template's. Of overlapping notices the one with the most matched words stays; ties go to the
larger share, then the earlier start, the later end, and the template that stands later in the list.

The templates are full texts of short licenses (`license_texts`) and usual notices of these and of longer ones, which are fragments; `read_templates` takes
more from a folder. They go to each worker. Null and empty documents and empty tables hold nothing; very long texts are scanned whole; repeated rows give
repeated rows. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_texts import FULL
from .tokens import blocks, mixed, odd_numbers, released

GRAM, WINDOW, SHORT = 3, 2, 8
_words = re.compile(r"\w+")
_K = odd_numbers(GRAM, 37)

#: Names and notices.
NOTICES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Proprietary": ["This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"],
    "BSD": ["SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "ISC": ["SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

#: Notices that grant nothing.
RESERVED = {"All-Rights-Reserved": ["All rights reserved"]}


def merged(*parts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Notices by license name, those of later parts last."""
    out: dict[str, list[str]] = {}
    for part in parts:
        for name, notices in part.items():
            out.setdefault(name, []).extend(notices)
    return out


TEMPLATES = merged(NOTICES, RESERVED, {name: [text] for name, text in FULL.items()})


def read_templates(folder: str) -> dict[str, list[str]]:
    """A template from each file of a folder that the driver sees, named like the file."""
    return {f.name.removesuffix(".txt"): [f.read_text(errors="replace")] for f in sorted(Path(folder).iterdir()) if f.is_file()}


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _words.findall(text)] if text else []


def grams(numbers: np.ndarray) -> np.ndarray:
    n = len(numbers) - GRAM + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        total = mixed(total + numbers[i : i + n] * _K[i])
    return total


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the last least hash of each WINDOW consecutive ones."""
    n = len(hashes)
    if n < WINDOW:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    last = WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    return np.unique(np.arange(len(windows)) + last)


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most words of the template that can be matched in order with place in words less place in the template from low to high; the first and last matched places.

    Of alignments with equally many matches the one that starts last counts, then the one that ends first. Words are numbers; 0 matches nothing.
    """
    m, width = len(template), high - low + 1
    # what the band can reach of the words; place j is j - low here
    own = np.zeros(m + width, np.int64)
    a, b = max(0, low), min(len(words), low + m + width - 1)
    if a >= b:
        return 0, 0, 0
    own[a - low : b - low] = words[a:b]
    bits = len(own).bit_length()
    if 3 * bits > 62:
        raise ValueError("template and band are too long")
    # best by diagonal in one number: matches, start, and how far the end lies before the last place
    last, one = len(own), 1 << 2 * bits
    places = np.arange(len(own))
    row, up = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i, w in enumerate(template.tolist()):
        # one template word on, the place in words stays: the diagonal above
        up[:-1] = row[1:]
        at = places[i : i + width]
        more = np.where(row == 0, one | (at << bits), (row + one) >> bits << bits) | (last - at)
        # then words of the document are passed over
        row = np.maximum.accumulate(np.where(own[i : i + width] == w, np.maximum(up, more), up)) if w else np.maximum.accumulate(up)
    best = int(row.max())
    n, start, end = best >> 2 * bits, best >> bits & (1 << bits) - 1, last - (best & (1 << bits) - 1)
    return (n, start + low, end + low + 1) if n else (0, 0, 0)


def least_hits(m: int, coverage: float) -> int:
    """Fingerprints that a notice of m words shares at least: unmatched words part it, and only runs of GRAM words may have none."""
    missing = m - int(np.ceil(coverage * m - 1e-9))
    return max(1, (m - missing - (GRAM + WINDOW - 2) * (missing + 1) + 1) // 2)


class Index:
    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words = [], []
        self.known: dict[str, int] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, notices in templates.items():
            for notice in notices:
                words = words_of(notice)
                for w in words:
                    self.known.setdefault(w, len(self.known) + 1)
                number = len(self.names)
                self.names.append(name)
                self.words.append(words)
                hashes = grams(np.array([self.known[w] for w in words], np.uint64))
                for p in winnowed(hashes).tolist() if len(words) >= SHORT else range(len(hashes)):
                    self.places[int(hashes[p])].append((number, p))
        self.keys = np.array(sorted(self.places), np.uint64)
        # a notice this short may stand where no window of the document chooses its fingerprint
        self.short = np.array([h for h, at in self.places.items() if any(len(self.words[t]) < SHORT for t, _ in at)], np.uint64)
        self.numbers = [np.array([self.known[w] for w in words], np.int64) for words in self.words]

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, template, place in the template) of each fingerprint that a document shares."""
        hashes = grams(numbers)
        if not len(hashes):
            return
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        if not (self.keys[i] == hashes).any():
            return
        chosen = np.union1d(winnowed(hashes), np.flatnonzero(np.isin(hashes, self.short)))
        for p in chosen[self.keys[i[chosen]] == hashes[chosen]].tolist():
            for template, place in self.places[int(hashes[p])]:
                yield p, template, place

    def scan(self, text: str | None, coverage: float) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, matched words, first character, end) of each notice."""
        words = words_of(text)
        get = self.known.get
        numbers = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, template, place in self.candidates(numbers):
            near[template].append((p - place, p))
        found = []
        for template, hits in near.items():
            own = self.numbers[template]
            band, least = max(2, len(own) // 5), least_hits(len(own), coverage)
            hits.sort()
            diagonals = np.array([d for d, _ in hits])
            for d in sorted(set(diagonals.tolist())):
                a, b = np.searchsorted(diagonals, [d - band, d + band + 1])
                if b - a >= least and len({p for _, p in hits[a:b]}) >= least:
                    n, start, end = align(own, numbers.astype(np.int64), d - band, d + band)
                    if n >= coverage * len(own):
                        found.append((n, n / len(own), -start, end, template))
        taken: list[tuple[int, int]] = []
        out = []
        spots = None
        for n, share, start, end, template in sorted(set(found), reverse=True):
            if all(end <= a or -start >= b for a, b in taken):
                taken.append((-start, end))
                spots = spots or [m.span() for m in _words.finditer(text)]
                out.append((self.names[template], share, n, spots[-start][0], spots[end - 1][1]))
        return sorted(out, key=lambda x: x[3])


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, matched, start, end) of each notice; start and end count characters of the text."""
    templates = templates or TEMPLATES
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in ("matched", "start", "end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in released(batches):
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                found = [(i, *x) for i in range(a, b) for x in index.scan(texts[i], coverage)]
                if found:
                    i, name, share, n, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(name, pa.string()), pa.array(share, pa.float64()), *[pa.array(x, pa.int64()) for x in (n, start, end)]], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
