"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

A text is its words: runs of letters and digits in lower case. Hashes of runs of
words are winnowed: of every few neighbouring runs the smallest hash is kept, in
templates and documents alike, so that a shared passage of words + window - 1
words always shares a fingerprint. The templates' fingerprints form an inverted
index (hash, template, place); documents are joined with it. The shared
fingerprints of a document and a template are put into chains that rise in both,
by a dynamic program over all of them. A template of which a chain holds enough
is a candidate there, and is aligned with that stretch in a band that follows the
chain, over words put in or left out. The alignment's matched words give coverage
and span.

A bitmap of fixed size over the index decides which fingerprints of a document
are worth a row. Of overlapping finds in a document the one with more matched
words stays, then the one of more coverage, then the earlier name.

Null and empty texts hold no license. Rows are told apart by doc_id and text:
repeated rows are reported once, a null doc_id under null. Templates without
words match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, stage_table, table

#: Public license notices and texts, as their authors ask for them to be placed.
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        'and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters of a library, at most: every task holds the templates of its candidates' library. Larger ones are scanned in parts.
LIBRARY = 1 << 27
#: What a run of words put in or left out costs an alignment that gains 2 by a match.
GAP = 3
#: A random number for each byte at each of the first 64 places of a word.
PLACED = mix64(np.arange(64 * 256, dtype=np.uint64))


@dataclass(frozen=True)
class LicenseScan:
    words: int = 3
    window: int = 3
    #: Share of a template's fingerprints that a chain must hold to be aligned.
    candidate: float = 0.15
    #: Share of a template's words that an alignment must match to be reported.
    coverage: float = 0.75
    band: int = 8
    #: So many foreign words may stand between two parts of one find, or as many as the template has; None for any number.
    foreign: int | None = 64
    map_bits: int = 1 << 20
    #: An index of up to so many rows is broadcast; a larger one is joined by shuffling.
    small_index: int = 200_000


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], IS_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    at = np.flatnonzero(inside[1:-1])
    sizes = ends - starts
    offset = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    low = LOWER[raw[at]]
    values = PLACED[np.minimum(offset, 63) << 8 | low]
    if (late := np.flatnonzero(offset > 63)).size:
        values[late] = mix64((offset[late] << 8 | low[late]).astype(np.uint64))
    return mix64(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)), starts, ends


def winnowed(words: np.ndarray, settings: LicenseScan) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept runs; a text shorter than a run is one run."""
    size = min(settings.words, len(words))
    count = len(words) - size + 1
    if not size:
        return np.zeros(0, np.int64), words
    runs = np.full(count, size, np.uint64)
    for k in range(size):
        runs = mix64(runs ^ words[k : k + count])
    width = min(settings.window, count)
    views = np.lib.stride_tricks.sliding_window_view(runs, width)
    kept = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return kept, runs[kept]


def align(template: list[int], found: list[int], path: list[tuple[int, int]], band: int) -> tuple[int, int, int]:
    """Banded local alignment along a path of (template, found) places: matched words, first and end of the span in found.

    A match gives 2, another word in its place costs 1, a run of words put in or left out costs GAP, however long. The band
    follows the path: around each anchor it is as wide as band says, and between two anchors on different diagonals it
    holds both, so that a run of any length between them lies inside.
    """
    low, high = np.zeros(len(template), np.int64), np.zeros(len(template), np.int64)
    steps = [(-1, path[0][1] - path[0][0] - 1), *path, (len(template), path[-1][1] + len(template) - path[-1][0])]
    for (i, j), (k, m) in zip(steps[:-1], steps[1:], strict=True):
        rows = np.arange(max(i, 0), min(k + 1, len(template)))
        ends = rows + (j - i), rows + (m - k)
        low[rows], high[rows] = np.minimum(*ends), np.maximum(*ends)
    best = (0, 0, 0, 0)
    nothing = (0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    left_out: dict[int, tuple[int, int, int]] = {}  # best of each column with template words left out just before
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        skipped: dict[int, tuple[int, int, int]] = {}
        put_in = nothing  # best of this row with words put in just before
        for j in range(max(0, int(low[i]) - band), min(len(found), int(high[i]) + band + 1)):
            score, begin, hits = above.get(j - 1, nothing)
            if not score:
                begin, hits = j, 0
            cell = (score + 2, begin, hits + 1) if word == found[j] else (score - 1, begin, hits)
            up = above.get(j, nothing)
            gap = max(left_out.get(j, nothing), (up[0] - GAP, *up[1:]))
            if gap[0] > 0:
                skipped[j] = gap
            cell = max(cell, gap, put_in)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (*cell, j + 1)
            put_in = max(put_in, (cell[0] - GAP, *cell[1:]))
        above, left_out = row, skipped
    return best[2], best[1], best[3]


def fingerprints(docs: DataFrame, settings: LicenseScan, bitmap) -> DataFrame:
    """doc_id, mark, hash, place of the documents' fingerprints that the bitmap lets through."""

    def run(batches):
        mask = bitmap.value
        for batch in pieces(batches, 256):
            owner, places, hashes = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                at, named = winnowed(words_of(text.encode())[0], settings)
                hit = mask[(named % np.uint64(settings.map_bits)).astype(np.int64)]
                owner.append(np.full(int(hit.sum()), k))
                places.append(at[hit])
                hashes.append(named[hit])
            owner = pa.array(np.concatenate([np.zeros(0, np.int64), *owner]))
            columns = [batch.column("doc_id").take(owner), batch.column("mark").take(owner)]
            columns += [pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "hash", "place"])

    return docs.mapInArrow(run, "doc_id long, mark long, hash long, place int")


def chains(hits: list[dict], length: int, foreign: int | None = 64) -> list[list[tuple[int, int]]]:
    """The hits of one template as chains of (at, place), both rising, the heaviest first; each hit is in one chain.

    A chain weighs its hits, less for each change of diagonal something under one hit, more for larger changes. Between
    two hits of a chain stand at most as many foreign words as the template has, or foreign; any number where that is None.
    The dynamic program holds each hit against all earlier ones that near.
    """
    order = sorted({(h["place"], h["at"]) for h in hits})
    place, at = np.array(order, np.int64).T
    most = max(length, foreign) if foreign is not None else int(place[-1]) + length
    reach = length + most
    weight, before = np.ones(len(order)), np.full(len(order), -1)
    first = np.searchsorted(place, place - reach)
    for k in range(1, len(order)):
        a, b = first[k], np.searchsorted(place, place[k])
        if a == b:
            continue
        turn = np.abs((place[k] - place[a:b]) - (at[k] - at[a:b]))
        gain = np.where((at[a:b] < at[k]) & (turn <= most), weight[a:b] - turn / (turn + 32.0), 0)
        best = int(gain.argmax())
        if gain[best] > 0:
            weight[k], before[k] = 1 + gain[best], a + best
    out: list[list[tuple[int, int]]] = []
    used = np.zeros(len(order), bool)
    for k in np.argsort(-weight, kind="stable"):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append((int(at[k]), int(place[k])))
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def finds(text: str, hits: list[dict], templates: dict[str, tuple[list[int], int]], settings: LicenseScan) -> list[tuple]:
    """(template, coverage, start, end, matched words) in one text; start and end in code points."""
    data = text.encode()
    words, starts, ends = words_of(data)
    found = []
    by_name: dict[str, list[dict]] = {}
    for hit in hits:
        by_name.setdefault(hit["template"], []).append(hit)
    for name, own in by_name.items():
        template, prints = templates[name]
        for chain in chains(own, len(template), settings.foreign):
            if len(chain) < settings.candidate * prints:
                continue
            diagonal = chain[0][1] - chain[0][0]
            if diagonal >= 0 and words[diagonal : diagonal + len(template)].tolist() == template:  # the whole of it, word for word
                found.append((-len(template), -1.0, name, diagonal, diagonal + len(template)))
                continue
            low = max(0, diagonal - settings.band)
            part = words[low : max(0, chain[-1][1] - chain[-1][0] + len(template) + settings.band)].tolist()
            matched, begin, end = align(template, part, [(i, j - low) for i, j in chain], settings.band)
            if matched and matched >= settings.coverage * len(template):
                found.append((-matched, -matched / len(template), name, low + begin, low + end))
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for matched, coverage, name, begin, end in sorted(found):
        if all(end <= a or b <= begin for a, b in taken):
            taken.append((begin, end))
            first = len(data[: starts[begin]].decode())
            out.append((name, round(-coverage, 6), first, first + len(data[starts[begin] : ends[end - 1]].decode()), -matched))
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, library: dict[str, str] = NOTICES, settings: LicenseScan = LicenseScan()) -> DataFrame:
    """A row for each license found in docs (doc_id, text): doc_id, license, coverage, start, end, matched_words."""
    spark = docs.sparkSession
    if sum(map(len, library.values())) > LIBRARY:
        raise ValueError(f"a library has at most {LIBRARY} characters: scan with parts of it")
    templates, rows = {}, []
    for name, text in library.items():
        words = words_of(text.encode())[0]
        at, named = winnowed(words, settings)
        if len(at):
            templates[name] = (words.tolist(), len(at))
            rows += [(int(h), name, int(a)) for h, a in zip(named.view(np.int64), at, strict=True)]
    mask = np.zeros(settings.map_bits, bool)
    mask[[(h % (1 << 64)) % settings.map_bits for h, _, _ in rows]] = True
    index = spark.createDataFrame(rows, "hash long, template string, at int")
    if len(rows) <= settings.small_index:
        index = F.broadcast(index)
    keyed = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("mark"), "text")
    met = fingerprints(keyed, settings, spark.sparkContext.broadcast(mask)).join(index, "hash")
    # all hits of one document: bounded by its own length
    candidates = stage_table(met.groupBy("mark").agg(F.collect_set(F.struct("template", "at", "place")).alias("hits")), "candidates")
    shared = spark.sparkContext.broadcast(templates)

    def run(batches):
        for batch in pieces(batches, 128):
            owner, out = [], []
            for k, (text, hits) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                here = finds(text, hits, shared.value, settings)
                owner += [k] * len(here)
                out += here
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", "license", "coverage", "start", "end", "matched_words"]
    both = keyed.join(candidates, "mark").select("doc_id", "text", "hits")
    return both.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long, matched_words long").dropDuplicates(["doc_id", "license", "start", "end"])


def op5_winnowed_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
