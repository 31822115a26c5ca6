"""Licence scan: MinHash bands retrieve templates for text windows, exact shingle containment verifies them.

Templates are put in classes by their number of 5-word shingles. For each class a text is covered by overlapping windows, so
laid that any place of a template of the class lies whole in one of them, also with foreign words inside: up to ``INSERTED``
and a quarter of the class's largest size, where a match can lose the shingles around them. From a window's size follows the least Jaccard
similarity that a match can have, and from that the number of MinHash bands (of one row) that
miss it with a probability of at most ``MISS``. Windows that share a band with a template are
verified against its shingles themselves.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from hearthgrid.llm.common import map_rows

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
#: Words that one worker holds, and the longest of them.
CACHE_WORDS, CACHE_LETTERS = 500_000, 64
#: Foreign words that a match may hold between its first and its last place, besides a quarter of its size class.
INSERTED = 24
CHUNK = 1 << 16  # words that are hashed at once
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)

# Notices and licence texts to look for.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD (conditions)": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details.""",
}

FINDINGS = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]
)


class WordHashes(dict):
    """Word -> hash of its lower case, filled as words come up."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.lower().encode())
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def shingle_hashes(words: list[str]) -> np.ndarray:
    """Hash of each 5-word shingle."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out = out * MIX + h[k : len(h) - SHINGLE + 1 + k]
    return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one row that a pair of this Jaccard similarity misses with at most this probability."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


@dataclass
class SizeClass:
    """Templates of ``most // 2 < shingles <= most``, their bands, and the windows that find them."""

    most: int
    step: int
    blocks: int
    bands: int
    keys: np.ndarray  # sorted band values
    owners: np.ndarray  # template of each


class Templates:
    """Templates ready for look-ups; a template needs five words at least."""

    def __init__(self, texts: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> None:
        self.names, self.containment = list(texts), containment
        words = [words_of(texts[n]) for n in self.names]
        if any(len(w) < SHINGLE for w in words):
            raise ValueError(f"templates need at least {SHINGLE} words")
        self.shingles = [shingles_of(w) for w in words]
        # templates are measured by their places; repeated shingles only make a match more likely
        places = [len(w) - SHINGLE + 1 for w in words]
        by_class: dict[int, list[int]] = {}
        for i, n in enumerate(places):
            by_class.setdefault(1 << (n - 1).bit_length(), []).append(i)
        plans = []
        # a run of foreign words inside a match breaks SHINGLE - 1 shingles at least: small templates can't lose so many
        room = {}
        for most, members in by_class.items():
            lost = max(len(self.shingles[i]) - math.ceil(containment * len(self.shingles[i]) - 1e-9) for i in members)
            room[most] = INSERTED + most // 4 if lost >= SHINGLE - 1 else 0
        #: Places that a match of each template may take.
        self.longest = [(most := 1 << (n - 1).bit_length()) + room[most] for n in places]
        for most, members in sorted(by_class.items()):
            step = max(1, most // 2)
            # the whole match lies in one window wherever it starts
            blocks = -(-(most + room[most] + step - 1) // step)
            least = 1.0
            for i in members:
                shared = math.ceil(containment * len(self.shingles[i]) - 1e-9)
                least = min(least, shared / (blocks * step + len(self.shingles[i]) - shared))
            plans.append((most, step, blocks, bands_for(least, miss), members))
        count = max((p[3] for p in plans), default=1)
        rng = np.random.default_rng(17)
        self.factors = rng.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.classes = []
        for most, step, blocks, bands, members in plans:
            keys, owners = [], []
            for i in members:
                least_of = self.minhash(shingle_hashes(words[i]))[:bands].min(axis=1)
                keys.append(self.band_keys(least_of[:, None])[:, 0])
                owners.append(np.full(bands, i))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.classes.append(SizeClass(most, step, blocks, bands, keys[order], owners[order]))
        self.reach = max((c.step * c.blocks for c in self.classes), default=0) + SHINGLE

    def minhash(self, hashes: np.ndarray) -> np.ndarray:
        """One row for each hash function."""
        mixed = hashes[None, :] * self.factors[:, None]
        return mixed ^ (mixed >> np.uint64(31))

    @staticmethod
    def band_keys(least: np.ndarray) -> np.ndarray:
        """Band values made distinct between bands."""
        return least * MIX + np.arange(len(least), dtype=np.uint64)[:, None]

    def retrieve(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """``(template, first shingle, end)`` of the windows that share a band with a template."""
        found = set()
        if not len(hashes):
            return found
        values = self.minhash(hashes)
        for c in self.classes:
            n = -(-len(hashes) // c.step)
            padded = np.full((c.bands, n * c.step), np.iinfo(np.uint64).max, np.uint64)
            padded[:, : len(hashes)] = values[: c.bands]
            block = padded.reshape(c.bands, n, c.step).min(axis=2)
            least = block.copy()
            for k in range(1, min(c.blocks, n)):
                np.minimum(least[:, : n - k], block[:, k:], out=least[:, : n - k])
            keys = self.band_keys(least)
            at = np.searchsorted(c.keys, keys.ravel())
            hit = np.flatnonzero(c.keys[np.minimum(at, len(c.keys) - 1)] == keys.ravel())
            for p in hit:
                window, value = p % n, keys.ravel()[p]
                for q in range(at[p], len(c.keys)):
                    if c.keys[q] != value:
                        break
                    found.add((int(c.owners[q]), int(window) * c.step, min(len(hashes), (int(window) + c.blocks) * c.step)))
        return found

    def matches(self, t: int, words: list[str]) -> Iterator[tuple[float, int, int, int]]:
        """Minus the containment, the length, start and end (in words) of every shortest stretch of ``words`` that holds enough of a template.

        A stretch is no longer than a match may be; its first shingle does not stand in it again.
        """
        wanted, most = self.shingles[t], self.longest[t]
        need = math.ceil(self.containment * len(wanted) - 1e-9)
        places = [(i, s) for i, s in enumerate(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if s in wanted]
        held: Counter[tuple[str, ...]] = Counter()
        left = 0
        for i, shingle in places:
            held[shingle] += 1
            while i - places[left][0] >= most or held[places[left][1]] > 1:
                first = places[left][1]
                held[first] -= 1
                if not held[first]:
                    del held[first]
                left += 1
            if len(held) >= need:
                start = places[left][0]
                yield -len(held) / len(wanted), i - start, start, i + SHINGLE

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """Template, start, end and containment of every match; of overlapping ones of a template the fullest, then shortest, then first."""
        raw = WORD.findall(text)
        if len(raw) < SHINGLE:
            return []
        windows = set()
        for at in range(0, len(raw), CHUNK):
            hashes = shingle_hashes(raw[at : at + CHUNK + self.reach])
            windows |= {(t, at + a, at + b) for t, a, b in self.retrieve(hashes)}
        verified: set[tuple[int, float, int, int, int]] = set()
        for t, first, end in windows:
            words = [w.lower() for w in raw[first : end + SHINGLE - 1]]
            verified |= {(t, *m[:2], first + m[2], first + m[3]) for m in self.matches(t, words)}
        if not verified:
            return []
        # matches that were taken do not overlap: only the neighbours in place can
        taken: dict[int, list[tuple[int, int, float]]] = {}
        for t, share, _, a, b in sorted(verified):
            own = taken.setdefault(t, [])
            at = bisect_left(own, (a,))
            if (at == 0 or own[at - 1][1] <= a) and (at == len(own) or b <= own[at][0]):
                own.insert(at, (a, b, -share))
        spans = [m.span() for m in WORD.finditer(text)]
        return sorted((self.names[t], spans[a][0], spans[b - 1][1], share) for t, own in taken.items() for a, b, share in own)


def scan(docs: DataFrame, texts: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, start, end, containment`` of every template found in every row of ``docs`` (``doc_id, text``).

    Words are compared in lower case without punctuation; ``start`` and ``end`` count code points. A repeated row or a NULL id has the
    matches of its text; NULL, empty and short texts have none; an empty table gives an empty result;
    other columns are ignored. Templates are a parameter of bounded size and go to the tasks with the function.
    """
    templates = Templates(texts, containment)

    def rows(ids, all_texts):
        for doc_id, text in zip(ids, all_texts, strict=True):
            for match in templates.find(text or ""):
                yield doc_id, *match

    return map_rows(docs.select("doc_id", "text"), rows, FINDINGS)
