"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

A template of a shingles belongs to the level of stride s, the greatest power of two up to a / 4. At each level
a text is cut into blocks of s shingles; windows of BLOCKS blocks begin at every block, so each copy of a template
of the level lies whole in some window. A band is one seeded minimum: that of a window is looked up in a table
of the templates' minima, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lexispark.llm._spark import exact, load, released, without
from lexispark.llm._text import ALNUM, U64, blocks, by_doc, folded, grams, table, utf8, words

WIDTH = 5
#: A template of a level of stride s has fewer than 8 s shingles, and a copy may begin anywhere in a block.
BLOCKS = 9
#: Templates of fewer words than this have to match in all shingles with a number: their versions differ in nothing else.
NOTICE = 40
_VALUES = folded(table(2))
_TOP = np.uint64(np.iinfo(np.uint64).max)

#: Public notices and short licenses by SPDX identifier; see also :func:`catalogue`.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def catalogue(folder: str | None = None) -> list[tuple[str, str]]:
    """NOTICES, and the whole texts in ``folder`` on the driver: ``NAME.txt`` files, by default those beside this module."""
    files = sorted(Path(folder or Path(__file__).with_name("license_texts")).glob("*.txt"))
    return [*NOTICES, *[(f.name.removesuffix(".txt"), f.read_text("utf-8", "replace")) for f in files]]


def seeds(n: int) -> np.ndarray:
    """Seeds of n bands; the first are the same for any n."""
    return np.random.default_rng(22).integers(0, 1 << 64, n, np.uint64)


def _least(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (hashes ^ seed) * U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    return x * U64(0xBF58476D1CE4E5B9)


@dataclass
class Template:
    name: str
    words: int
    shingles: np.ndarray
    required: np.ndarray  # shingles that have to be there
    stride: int
    window: int  # in blocks of the stride


@dataclass
class Level:
    """Templates of one stride and window: for each band a sorted table of their minima."""

    stride: int
    window: int
    members: list[int]
    bands: int
    value: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)
    mark: list[np.ndarray] = field(default_factory=list)


@dataclass
class Catalogue:
    templates: list[Template]
    levels: list[Level]
    seeds: np.ndarray


def bands_for(a: int, m: int, containment: float, certain: float) -> int:
    """Bands of one hash each so that a window of ``m`` shingles which contains the share ``containment`` of a template's ``a`` meets one of them with probability ``certain``.

    Of the shingles of such a window and the template the share c / (m + a - c) is common, c of a, or more.
    """
    c = max(1, math.ceil(containment * a - 1e-9))
    similarity = c / (m + a - c)
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(1 - certain) / math.log(1 - similarity)))


def prepare(templates: list[tuple[str, str]], containment: float, certain: float) -> Catalogue:
    out: list[Template] = []
    for name, text in templates:
        data, offs = utf8(pa.array([text]))
        found = words(data, offs, ALNUM, _VALUES)
        n = len(found.hash)
        if n < WIDTH:
            raise ValueError(f"the template of {name} has fewer than {WIDTH} words: {text!r}")
        at, hashes = grams(found, WIDTH)
        number = np.array([bytes(data[a:b]).isdigit() for a, b in zip(found.start, found.end, strict=True)])
        near = np.array([number[i : i + WIDTH].any() for i in at])
        required = np.unique(hashes[near]) if n < NOTICE else np.zeros(0, np.uint64)
        a = len(at)
        # short ones have windows of their own length at every word
        stride, window = (1, a) if a < 8 else (1 << int(math.log2(a / 4)), BLOCKS)
        out.append(Template(name, n, np.unique(hashes), required, stride, window))
    levels: dict[tuple[int, int], Level] = {}
    for k, t in enumerate(out):
        level = levels.setdefault((t.stride, t.window), Level(t.stride, t.window, [], 0))
        level.members.append(k)
        level.bands = max(level.bands, bands_for(len(t.shingles), t.stride * t.window, containment, certain))
    all_seeds = seeds(max((x.bands for x in levels.values()), default=0))
    for level in levels.values():
        for b in range(level.bands):
            low = np.array([_least(out[k].shingles, all_seeds[b]).min() for k in level.members], np.uint64)
            order = np.argsort(low)
            mark = np.zeros(1 << 16, np.bool_)
            mark[low >> U64(48)] = True
            level.value.append(low[order])
            level.owner.append(np.array(level.members)[order])
            level.mark.append(mark)
    return Catalogue(out, sorted(levels.values(), key=lambda x: (x.stride, x.window)), all_seeds)


def _starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of n things each: offsets, and the document of each thing."""
    return np.concatenate([[0], np.cumsum(n)]), np.repeat(np.arange(len(n)), n)


def candidates(hashes: np.ndarray, first: np.ndarray, ready: Catalogue, retrieve: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, begin, end): windows of shingles, by position, that share a band with a template; every window for every template without ``retrieve``."""
    found: list[np.ndarray] = []
    n = np.diff(first)
    strides = sorted({x.stride for x in ready.levels})
    shape, low = {}, {}  # by stride: blocks of each document, and their minima by band
    for s in strides:
        count = -(-n // s)
        offs, doc = _starts(count)
        shape[s] = offs, doc, first[doc] + (np.arange(len(doc)) - offs[doc]) * s
    for b in range(len(ready.seeds)):
        levels = [x for x in ready.levels if b < x.bands]
        mixed = _least(hashes, ready.seeds[b]) if retrieve else hashes
        low, done = mixed, 1
        for s in sorted({x.stride for x in levels}):
            offs, doc, begin = shape[s]
            if s > done:  # minima of longer blocks from those of shorter ones
                own = shape[done][0][doc] + (np.arange(len(doc)) - offs[doc]) * (s // done) if done > 1 else begin
                low, done = np.minimum.reduceat(low, own), s
            for level in (x for x in levels if x.stride == s):
                start, end = _windows(offs, level.window)
                if retrieve:
                    least = _slide(low, start, end, level.window)
                    near = np.flatnonzero(level.mark[b][least >> U64(48)])
                    value, owner = level.value[b], level.owner[b]
                    lo, hi = np.searchsorted(value, least[near]), np.searchsorted(value, least[near], side="right")
                    which = np.repeat(near, hi - lo)
                    at = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                    owner = owner[at]
                elif b == 0:
                    which, owner = np.repeat(np.arange(len(start)), len(level.members)), np.tile(level.members, len(start))
                else:
                    continue
                if len(which):
                    last = np.minimum(begin[end[which] - 1] + s, first[doc[start[which]] + 1])
                    found.append(np.stack([owner, begin[start[which]], last]))
        if not retrieve:
            break
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _windows(offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and the one after the last of each window: one for each block until the end of the document is inside."""
    count = np.diff(offs)
    many = np.where(count > 0, np.maximum(count - width, 0) + 1, 0)
    upto, doc = _starts(many)
    start = offs[doc] + np.arange(len(doc)) - upto[doc]
    return start, np.minimum(start + width, offs[doc + 1])


def _slide(low: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The least of ``low[start:end]`` for windows of ``width``, or of whole documents where these are shorter."""
    out = np.empty(len(start), np.uint64)
    full = end - start == width
    x, have = low, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    s = start[full]
    out[full] = np.minimum(x[s], x[s + width - have])
    short = np.flatnonzero(~full)
    if len(short):  # each is all of a document, so they don't overlap
        edges = np.stack([start[short], end[short]], axis=1).ravel()
        out[short] = np.minimum.reduceat(np.append(low, _TOP), edges)[::2]
    return out


def matches(data: np.ndarray, offs: np.ndarray, ready: Catalogue, containment: float, retrieve: bool = True) -> list[list[tuple]]:
    """(license, lo, hi, containment) by document: windows in which a template is contained, as byte offsets of its first and last shared word.

    ``retrieve``: whether bands choose the windows that are verified; else all are.
    """
    out: list[list[tuple]] = [[] for _ in range(len(offs) - 1)]
    for i, j in blocks(offs):
        part = offs[i : j + 1]
        found = words(data, part, ALNUM, _VALUES)
        at, hashes = grams(found, WIDTH)
        if not len(at):
            continue
        first = np.searchsorted(at, found.first)
        doc_of = found.docs()
        for k, begin, end in zip(*candidates(hashes, first, ready, retrieve), strict=True):
            t = ready.templates[k]
            a = len(t.shingles)
            if end - begin < (need := math.ceil(containment * a - 1e-9)):
                continue
            own = hashes[begin:end]
            here = t.shingles[np.minimum(np.searchsorted(t.shingles, own), a - 1)] == own
            if here.sum() < need:
                continue
            shared = np.unique(own[here])
            if len(shared) >= need and np.isin(t.required, shared).all():
                where = at[begin + np.flatnonzero(here)]
                doc = int(doc_of[where[0]])
                base = part[doc] - part[0]
                out[i + doc].append((t.name, int(found.start[where[0]] - base), int(found.end[where[-1] + WIDTH - 1] - base), len(shared) / a))
    return [_merged(x) for x in out]


def _merged(found: list[tuple]) -> list[tuple]:
    """Overlapping matches of one license as one, with the greater containment."""
    out: list[tuple] = []
    for m in sorted(found):
        if out and out[-1][0] == m[0] and m[1] < out[-1][2]:
            out[-1] = (m[0], out[-1][1], max(out[-1][2], m[2]), max(out[-1][3], m[3]))
        else:
            out.append(m)
    return out


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = 0.8, certain: float = 0.9999) -> DataFrame:
    """``docs`` with a column ``licenses``: array of (license, lo, hi, containment), by license and place.

    ``templates`` are (license, text), by default :func:`catalogue`. Words are lower-cased runs of ASCII
    letters, digits and non-ASCII characters. A template of a shingles of WIDTH words is looked for in windows of
    9 s shingles that begin every s, s being the greatest power of two up to a / 4 (below 8 shingles, in
    windows of a that begin at every word); it is there if ``containment`` of its different shingles are, and, for
    one of fewer than NOTICE words, all those with a number, so that versions aren't mixed up. ``lo`` and
    ``hi`` are UTF-8 offsets of the first and last word shared. Bands find a window that qualifies with
    probability ``certain`` or more, and verification is exact.

    Null and empty texts have no licenses; a column that clashes with ``licenses``, in any case, is replaced;
    repeated rows have each their own; an empty table stays empty. Rows stay in their partition. The templates
    go to every task (8 bytes for each of their words); the search for them is by lookup, so its cost
    hardly depends on their number.
    """
    ready = prepare(catalogue() if templates is None else templates, containment, certain)
    rest = without(docs, ["licenses"], keep=(text,))
    one = StructType([StructField("license", StringType()), StructField("lo", LongType()), StructField("hi", LongType()), StructField("containment", DoubleType())])
    schema = StructType([*rest.schema.fields, StructField("licenses", ArrayType(one))])
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matches(*utf8(batch.column(batch.schema.get_field_index(text))), sent.value, containment)
            lists = pa.array([[dict(zip(("license", "lo", "hi", "containment"), m, strict=True)) for m in f] for f in found], arrow.field("licenses").type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, lists], arrow, strict=True)], schema=arrow)

    return rest.mapInArrow(released(run), schema)


# ---------------------------------------------------------------------------------------------- query


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    done = scan(exact(load(spark, sf_dir, "documents"), "doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return done.select(
        "doc_id",
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["lo"].cast("string"), x["hi"].cast("string"))), ",").alias("spans"),
    )
