"""License scans: MinHash bands over overlapping text windows retrieve templates, and exact shingle
containment over the whole text verifies them.

Words are runs of letters and digits, lower-cased. Templates are dealt to size classes (powers of
two of their shingles). For each class every text has windows of twice the class's size, one
starting at every class size. A band is one minimum of a hash family over a window's shingles, and a
template is retrieved if any of BANDS minima agrees in any window: nothing else looks a text up.

A window has at most 4n shingles for a template of n, as n is more than half the class's size. A
contiguous copy that holds a share c lies within one window, so a band agrees with probability at
least c*n / (4n + (1 - c)n) >= 0.8/4.2 = 0.19. Windows only retrieve, so a copy need not lie in one:
however far words that were put in drive its parts, each shingle that is held is in a window and is
the least of it and the template with probability 1 / (window + n), so some band agrees with
probability at least 0.8/5 = 0.16. One of 96 bands then agrees with 1 - 6e-8.

The texts of a batch are read as one sequence of word hashes. Block minima of a size are those of
half the size taken in pairs, and a window is two neighbouring blocks. Windows over two texts only
make more candidates, and verification drops these.

A retrieved template's shingles in the text fall into runs that follow the template's order without
a gap longer than the template. Stretches of one or more runs, left to right, that hold 0.8 of its
shingles are its copies.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared, batch_of, map_batches

SHINGLE = 5
LEAST_CONTAINED = 0.8
BANDS = 96
#: Shingles that are hashed at once, at least; words whose hashes a worker remembers.
SLICE, MEMO = 1 << 12, 1 << 20
#: Characters of texts that are scanned as one sequence; a longer text is one by itself.
SEQUENCE_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")

#: Public licence texts and notices by their SPDX identifier (a number parts several of one).
TEMPLATES = {
    "MIT#1": "Released under the MIT License.",
    "MIT#2": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT#3": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0#1": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#2": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0#1": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0#3": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC#2": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

#: Whole texts of the long licences, one file each.
FOLDER = Path(__file__).resolve().parent / "licenses"


def read_templates(folder: str | Path = FOLDER) -> dict[str, str]:
    """Template id (a file's name, with #text): text, of the *.txt files of a folder on the driver."""
    return {f"{f.stem}#text": f.read_text(encoding="utf-8") for f in sorted(Path(folder).glob("*.txt"))}


def all_templates() -> dict[str, str]:
    """The notices above and the whole texts."""
    return TEMPLATES | read_templates()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


class Hashes(dict):
    """The 64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, words: list[str]) -> np.ndarray:
        """The 32-bit hash of the shingle at each word: its words' hashes by odd factors, mixed. Hashes only
        retrieve, so equal ones of different shingles do no harm."""
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = len(words) - SHINGLE + 1
        out = sum(h[k : k + n] * _FACTORS[k] for k in range(SHINGLE))
        out ^= out >> np.uint64(31)
        out *= _FACTORS[SHINGLE]
        return (out >> np.uint64(32)).astype(np.uint32)


@dataclass
class Index:
    """templates by id, each of SHINGLE words at least. A shingle of a template has a number, any other -1."""

    templates: dict[str, str]
    number: dict[str, int] = field(default_factory=dict)
    #: template id: {number of a shingle: its places in the template}
    places: dict[str, dict[int, list[int]]] = field(default_factory=dict)
    #: class size: its template ids and their minima
    classes: dict[int, list[tuple[str, np.ndarray]]] = field(default_factory=dict)
    hashes: Hashes = field(default_factory=Hashes)

    def __post_init__(self):
        for name, text in self.templates.items():
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            own = shingles_of(words)
            places = self.places[name] = {}
            for i, s in enumerate(own):
                places.setdefault(self.number.setdefault(s, len(self.number)), []).append(i)
            size = 1 << (len(own) - 1).bit_length()
            self.classes.setdefault(size, []).append((name, _banded(self.hashes.shingles(words)).min(axis=0)))
        self.first = frozenset(s.split(" ", 1)[0] for s in self.number)
        self.largest = max(self.classes, default=1)
        self.templates = {}

    def retrieved(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(template id, first shingle, shingle behind the last) of the windows that agree in a band."""
        out: list[tuple[str, int, int]] = []
        if len(words) < SHINGLE or not self.classes:
            return out
        h = self.hashes.shingles(words)
        step = max(SLICE, 2 * self.largest)
        for start in range(0, len(h), step):
            # blocks of this slice, and those behind it that its last windows need
            low, size = _banded(h[start : start + step + self.largest]), 1
            while True:
                if size in self.classes:
                    window = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    for name, own in self.classes[size]:
                        for k in np.flatnonzero((window == own).any(axis=1)):
                            out.append((name, start + int(k) * size, start + int(k + 2) * size))
                size *= 2
                if size > self.largest:
                    break
                low = np.minimum(low[::2], low[1::2]) if len(low) % 2 == 0 else np.concatenate([np.minimum(low[:-1:2], low[1::2]), low[-1:]])
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of the shingle at each word, -1 for those of no template."""
        out = np.full(len(words), -1, np.int64)
        for i, w in enumerate(words):
            if w in self.first and (k := self.number.get(" ".join(words[i : i + SHINGLE]))) is not None:
                out[i] = k
        return out

    def stretches(self, name: str, numbers: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(first shingle, last shingle, containment) of each copy of a template; copies don't overlap."""
        places = self.places[name]
        runs: list[tuple[int, int, set[int]]] = []
        last = place = -1
        for p in at:
            p, k = int(p), int(numbers[p])
            if (own := places.get(k)) is None:
                continue
            i = bisect_right(own, place)
            if runs and i < len(own) and p - last <= len(places) + SHINGLE:
                place = own[i]
                runs[-1][2].add(k)
                runs[-1] = (runs[-1][0], p, runs[-1][2])
            else:
                place = own[0]
                runs.append((p, p, {k}))
            last = p
        out, held = [], set()
        for r, run in enumerate(runs):
            held |= run[2]
            if len(held) / len(places) < LEAST_CONTAINED:
                continue
            # the latest run from which enough is held: what stands before belongs to no copy
            held, first = set(), r + 1
            while len(held) / len(places) < LEAST_CONTAINED:
                first -= 1
                held |= runs[first][2]
            out.append((runs[first][0], run[1], len(held) / len(places)))
            held = set()
        return out

    def scan_all(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (template id, first character, end, containment) of every copy, by template and place."""
        each = [words_of(t) for t in texts]
        ends = np.cumsum([*map(len, each)])
        found: dict[int, set[str]] = {}
        for name, first, last in self.retrieved([w for words in each for w in words]):
            # every text that has a word of the window's shingles
            for k in range(int(np.searchsorted(ends, first, "right")), min(len(texts) - 1, int(np.searchsorted(ends, last + SHINGLE - 2, "right"))) + 1):
                found.setdefault(k, set()).add(name)
        return [self.verified(t, words, found[k]) if k in found else [] for k, (t, words) in enumerate(zip(texts, each))]

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        return self.scan_all([text])[0]

    def verified(self, text: str, words: list[str], names: set[str]) -> list[tuple[str, int, int, float]]:
        """The copies of retrieved templates by exact containment over the whole text."""
        numbers = self.numbers(words)
        at = np.flatnonzero(numbers >= 0)
        found = [(n, *x) for n in sorted(names) for x in self.stretches(n, numbers, at)]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        end = lambda p: spans[min(p + SHINGLE, len(words)) - 1][1]
        return [(n, spans[a][0], end(b), share) for n, a, b, share in found]


_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = _RNG.integers(0, 1 << 31, BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, BANDS, dtype=np.uint32)


def _banded(h: np.ndarray) -> np.ndarray:
    """shingles x BANDS: multiply-add hashes of the shingle hashes, on 32 bits, whose products are vectorised."""
    out = h[:, None] * _A
    out += _B
    return out


def _sequences(texts: Iterable[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= SEQUENCE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n_licenses, licenses (different template
    ids, sorted, comma-joined), spans (struct template, start, end, containment; code points) of every copy.

    templates are all_templates() unless given; read_templates(folder) reads others. A template is found if the
    text holds at least 0.8 of its 5-word shingles. Equally contained templates are all named. Null and empty texts
    have none; an empty table gives no rows, and no templates find nothing; repeated rows are scanned
    one by one; overlapping copies of different templates are all reported; other columns are ignored.
    Time grows in proportion to a text's length. No shuffle.
    """
    shared = Shared(documents.sparkSession, all_templates() if templates is None else templates)

    def start():
        index = shared.build(Index)

        def each(batch):
            found = [x for part in _sequences(t or "" for t in batch["text"].to_pylist()) for x in index.scan_all(part)]
            names = [sorted({n for n, *_ in x}) for x in found]
            kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
            yield batch_of(
                doc_id=batch["doc_id"], n_licenses=pa.array([*map(len, names)], pa.int64()), licenses=pa.array([*map(",".join, names)], pa.string()),
                spans=pa.array([[{"template": n, "start": a, "end": b, "containment": c} for n, a, b, c in x] for x in found], kind),
            )

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", F.col("text")), start, f"doc_id {kind}, n_licenses bigint, licenses string, spans array<struct<template:string,start:int,end:int,containment:double>>")
