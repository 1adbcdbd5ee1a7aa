"""License scan: MinHash bands over text windows retrieve templates, containment decides.

A template is a license notice; its shingles are runs of three words (lower case,
letters and digits only). A document holds a template where some window contains at
least ``CONTAINMENT`` of its shingles.

* Templates are grouped by length: those of up to L words use windows of 2 L words that
  start every L words, so any stretch of L words lies whole inside a window.
* Minima of the windows are built from the minima of blocks of L words, so every word is
  hashed once per length group and hash function, however the windows overlap.
* A window that holds the wanted share of a template has at least a known Jaccard
  similarity to it (``least_similarity``); the number of bands is chosen so that such a
  window shares a band with the template with probability ``RECALL``. Short notices are
  dissimilar to any window, so a band is a single minimum: with more rows the same
  probability would take several times the hash functions.
* A text with fewer shingles of a length group than any of its templates needs (counted by
  a table of hash prefixes, so never too few) is not looked at for that group.
* A shared band only retrieves: the window's shingles are then intersected with the
  template's, exactly, and the best window of each document and template is returned.

The templates are a parameter, at most ``MAX_TEMPLATE_WORDS`` words in all, and are sent
to every task; documents are scanned whole, in place, without a shuffle. Null and empty
texts, and texts shorter than a shingle, hold no license. A null ``doc_id`` stays null,
repeated rows are scanned each, and an empty table gives an empty result. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import shingles as S
from revlens.llm.common import map_slices, text_or_empty

WIDTH = 3
CONTAINMENT = 0.8
RECALL = 0.9999
ROWS = 1
MAX_TEMPLATE_WORDS = 200_000
#: Window blocks handled at once in a long text.
STEP = 512

#: Bits of a shingle's hash that the table of template shingles is addressed by.
TABLE_BITS = 18

#: Public license notices.
_NOTICES = {
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Whole license texts, one per file.
_TEXTS = [p for p in files("revlens.llm").joinpath("license_texts").iterdir() if p.name.endswith(".txt")]
TEMPLATES = _NOTICES | {p.name.removesuffix(".txt") + "-text": p.read_text(encoding="utf-8") for p in _TEXTS}

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> np.ndarray:
    """One hash per word."""
    return S.word_hashes(" ".join(_WORD.findall(text.lower())))


def least_similarity(shingles: int, words: int) -> float:
    """Jaccard similarity that a window of ``2 * words`` words with the wanted share has at least."""
    common = int(np.ceil(CONTAINMENT * shingles))
    return common / (shingles + 2 * words - WIDTH + 1 - common)


@dataclass
class Group:
    words: int  # longest template; block length
    names: list[str]
    sets: list[np.ndarray]
    bands: int
    buckets: dict[int, list[int]]  # band hash -> templates
    known: np.ndarray  # the band hashes, sorted


def prepare(templates: dict[str, str]) -> list[Group]:
    """Templates in groups whose lengths differ by less than a factor of two."""
    made: dict[int, list] = {}
    total = 0
    for name, text in sorted(templates.items()):
        words = tokens(text)
        total += len(words)
        if len(words) < WIDTH:
            raise ValueError(f"template {name} has fewer than {WIDTH} words")
        made.setdefault(int(np.ceil(np.log2(len(words)))), []).append((name, words))
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
    groups = []
    for members in made.values():
        longest = max(len(w) for _, w in members)
        sets = [np.unique(S.shingle_hashes(w, WIDTH)) for _, w in members]
        bands = max(S.bands_for(RECALL, least_similarity(len(s), longest), ROWS) for s in sets)
        buckets: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            for h in S.band_hashes(S.min_hashes(s, bands * ROWS), ROWS):
                buckets.setdefault(int(h), []).append(k)
        known = np.array(sorted(buckets), dtype=np.int64)
        groups.append(Group(longest, [n for n, _ in members], sets, bands, buckets, known))
    return groups


def shingle_table(groups: list[Group]) -> np.ndarray:
    """Per hash prefix, a bit for every group with such a shingle."""
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint32)
    for k, group in enumerate(groups):
        for own in group.sets:
            table[_prefix(own)] |= np.uint32(1 << k)
    return table


def _prefix(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def window_bands(shingles: np.ndarray, group: Group) -> tuple[np.ndarray, int]:
    """Band hashes per window (row k: shingles from ``k * words``), and the window's length."""
    step, span = group.words, 2 * group.words - WIDTH + 1
    n = max(1, -(-max(len(shingles) - span, 0) // step) + 1)
    a, b = S._multipliers(group.bands * ROWS, 7)
    out = np.empty((n, group.bands), dtype=np.int64)
    top = np.iinfo(np.uint64).max
    ends = span - step  # shingles of the second block that are still in the window
    number = np.arange(1, group.bands + 1, dtype=np.uint64) * S._ODD
    for at in range(0, n, STEP):
        rows = min(STEP, n - at)
        held = shingles[at * step : (at + rows) * step + ends]
        h = np.full((len(a), (rows + 1) * step), top, dtype=np.uint64)
        np.multiply(held, a[:, None], out=h[:, : len(held)])
        h[:, : len(held)] += b[:, None]
        blocks = h.reshape(len(a), rows + 1, step)
        minima = np.minimum(blocks[:, :-1].min(axis=2), blocks[:, 1:, :ends].min(axis=2))
        total = np.repeat(number[:, None], rows, axis=1)
        for k in range(ROWS):
            total = S.mix(total * S._ODD + minima[k::ROWS])
        out[at : at + rows] = total.view(np.int64).T
    return out, span


def scan_text(text: str, groups: list[Group], table: np.ndarray) -> list[tuple[str, int, int, int, float]]:
    """(template, first word of the window, words, shared shingles, containment), best window each."""
    words = tokens(text)
    if len(words) < WIDTH:
        return []
    shingles = S.shingle_hashes(words, WIDTH)
    found = []
    known = table[_prefix(shingles)]
    known = known[known != 0]
    for k, group in enumerate(groups):
        if np.count_nonzero(known & np.uint32(1 << k)) < CONTAINMENT * min(map(len, group.sets)):
            continue
        bands, span = window_bands(shingles, group)
        near = group.known[np.minimum(np.searchsorted(group.known, bands), len(group.known) - 1)]
        hits = near == bands
        if not hits.any():
            continue
        best: dict[int, tuple[int, int]] = {}
        for window in np.flatnonzero(hits.any(axis=1)):
            at = window * group.words
            own = np.unique(shingles[at : at + span])
            for k in {k for h in bands[window][hits[window]] for k in group.buckets[int(h)]}:
                shared = len(np.intersect1d(own, group.sets[k], assume_unique=True))
                best[k] = max(best.get(k, (0, 0)), (shared, -int(at)))
        for k, (shared, at) in best.items():
            containment = shared / len(group.sets[k])
            if containment >= CONTAINMENT:
                found.append((group.names[k], -at, min(2 * group.words, len(words) + at), shared, containment))
    return sorted(found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, words, shared, containment: one row per document and license it holds."""
    groups = prepare(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shingle_table(groups)
        for pdf in batches:
            rows = [
                (None if pd.isna(d) else int(d), *hit)
                for d, text in zip(pdf["doc_id"], pdf["text"], strict=True)
                for hit in scan_text(text, groups, table)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "first_word", "words", "shared", "containment"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_slices(texts, run, "doc_id long, license string, first_word long, words long, shared long, containment double")
