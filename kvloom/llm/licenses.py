"""License scans by conditional compression.

A stretch of words around a telling word is compressed with each notice as a raw dictionary. The notices that save most bytes
are tried first: the best stretch of the same length is lined up with the notice word by word, and what differs decides. Of the
others all are tried that could explain more words than the best place found, so the ranking saves work and loses nothing.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of license notices, as their publishers give them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "GPL header warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Apache-2.0 disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Licenses that a file can name in one line of a fixed form.
IDENTIFIERS = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
NOTICES |= {f"{name} identifier": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
#: Words that a short notice may have in another form or in one another's place; names and versions are never among them.
LOOSE = ({"license", "licence", "licenses", "licences"}, {"licensed", "licenced", "released", "distributed", "published", "available", "provided"}, {"work", "program", "software", "project", "library", "code", "file", "document", "text"}, {"version", "v", "ver"})
#: A text without any of these, or of the longest words of notices that hold none of them, is not looked at.
TELLING = r"(?i)licen[sc]e|redistribut|permission|warrant|unencumbered"
#: Notices tried at once for each stretch, and the share of a notice's words that may differ; of a notice of fewer than 20 words only LOOSE ones may.
TRIED = 4
SLACK = 0.05
SCHEMA = "doc_id long, n_blocks long, n_found long, licenses string, spans array<struct<license: string, first: int, last: int, n_differences: int>>"
_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_worker: dict = {}


def telling(notices: dict[str, str]) -> str:
    """Pattern of which every notice holds a match, in one word."""
    more = {max(text.split(), key=len) for text in notices.values() if not re.search(TELLING, text)}
    return "|".join([TELLING, *(re.escape(normal(w)) for w in sorted(more))])


def normal(word: str) -> str:
    return word.casefold().strip(".,;:!?()[]{}\"'“”‘’")


class Scanner:
    def __init__(self, notices: dict[str, str]) -> None:
        import zstandard

        self.words = {name: [w for w in map(normal, text.split()) if w] for name, text in notices.items()}
        self.loose = {w: i for i, group in enumerate(LOOSE) for w in group}
        self.sets = {name: set(words) for name, words in self.words.items()}
        self.longest = max(map(len, self.words.values()))
        self.plain = zstandard.ZstdCompressor(level=3)
        self.with_notice = {
            name: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(self.words[name]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name in notices
        }
        self.telling = re.compile(telling(notices))

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of words around telling ones. Those that meet become one; one that grows long is cut with the longest notice as overlap."""
        out: list[list[int]] = []
        for i, w in enumerate(words):
            if self.telling.search(w):
                first, last = max(0, i - self.longest), min(len(words), i + self.longest)
                if out and first <= out[-1][1] and last - out[-1][0] <= 6 * self.longest:
                    out[-1][1] = last
                else:
                    out.append([first, last])
        return [(a, b) for a, b in out]

    def rank(self, words: list[str]) -> list[str]:
        """Names of all notices by the bytes that each saves, the most first, of equal ones by name."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = {name: alone - len(c.compress(data)) for name, c in self.with_notice.items()}
        return sorted(saved, key=lambda n: (-saved[n], n))

    def most(self, name: str) -> int:
        """Words that a place of the notice can have at most."""
        n = len(self.words[name])
        return n + (int(SLACK * n) if n >= 20 else 0)

    def confirm(self, name: str, words: list[str]) -> list[tuple[int, int, int]]:
        """(first, last, differences) of each place where the notice stands."""
        notice = self.words[name]
        n, out, at = len(notice), [], 0
        if n < 20:
            form = lambda w: self.loose.get(w, w)
            shape, here = [form(w) for w in notice], [form(w) for w in words]
            while at + n <= len(words):
                if here[at] == shape[0] and here[at : at + n] == shape:
                    out.append((at, at + n, sum(a != b for a, b in zip(notice, words[at : at + n], strict=True))))
                    at += n
                else:
                    at += 1
            return out
        limit = int(SLACK * n)
        # words of the notice up to each place: a stretch that holds too few of them can't be it
        upto = [0, *itertools.accumulate(w in self.sets[name] for w in words)]
        matcher = difflib.SequenceMatcher(None, autojunk=False)
        matcher.set_seq2(notice)
        head = set(notice[: limit + 1])
        while at + n - limit <= len(words):
            if words[at] in head and upto[min(at + n + limit, len(words))] - upto[at] >= n - limit:
                matcher.set_seq1(words[at : at + n + limit])
                parts = [m for m in matcher.get_matching_blocks() if m.size]
                end = parts[-1].a + parts[-1].size if parts else 0
                same = sum(m.size for m in parts)
                differences = max(n, end) - same
                if differences <= limit and not self._telling_apart(notice, words[at : at + end]):
                    out.append((at, at + end, differences))
                    at += end
                    continue
            at += 1
        return out

    @staticmethod
    def _telling_apart(notice: list[str], words: list[str]) -> bool:
        """Whether versions (words with a digit) differ: a name can't make up for a wrong version."""
        digits = lambda ws: [w for w in ws if any(c.isdigit() for c in w)]
        return digits(notice) != digits(words)

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, int]]]:
        """Number of stretches, and (license, first word, last word, differences) of the notices in a text, in order; the more words explain a place, the better."""
        raw = _SPACE.findall(text)
        found: set[tuple[str, int, int, int]] = set()
        blocks = self.blocks(raw)
        for first, last in blocks:
            places, words = zip(*[(first + i, w) for i, w in enumerate(map(normal, raw[first:last])) if w], strict=True)
            left = list(words)
            while any(left):
                ranked = self.rank([w for w in left if w])
                hits = [(name, *h) for name in ranked[:TRIED] for h in self.confirm(name, left)]
                for name in ranked[TRIED:]:
                    if self.most(name) >= max((h[2] - h[1] for h in hits), default=0):
                        hits += [(name, *h) for h in self.confirm(name, left)]
                if not hits:
                    break
                name, a, b, d = min(hits, key=lambda h: (h[1] - h[2], h[3], h[0], h[1]))
                found.add((name, places[a], places[b - 1] + 1, d))
                left[a:b] = [""] * (b - a)
        return len(blocks), sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of documents: doc_id, n_blocks, n_found, licenses (distinct names, sorted, joined by commas), spans.

    Spans count words from 0, the last is exclusive. Whole texts are scanned, however long; a null or empty text, or one without a
    telling word, has none. Case and the marks around a word don't count as differences; every other word does, and a different
    version is never passed over. In a notice of fewer than 20 words only words of LOOSE may differ, within their group. A passage
    that holds two notices has two spans, one inside another has the longer one. Other columns are not read, whatever their names;
    repeated rows give repeated rows, and an empty table none. There is no shuffle.
    """
    notices = NOTICES if notices is None else notices

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(notices.items()))
        if key not in _worker:
            _worker[key] = Scanner(notices)
        scanner = _worker[key]
        for batch in batches:
            done = [(0, []) if t is None else scanner.scan(t) for t in batch.column(1).to_pylist()]
            spans = [[{"license": n, "first": a, "last": b, "n_differences": d} for n, a, b, d in f] for _, f in done]
            kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("n_differences", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([n for n, _ in done], pa.int64()), pa.array([len(f) for _, f in done], pa.int64()), pa.array([",".join(sorted({x[0] for x in f})) for _, f in done], pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_blocks", "n_found", "licenses", "spans"],
            )

    return docs.select("doc_id", F.when(F.col("text").rlike(telling(notices)), F.col("text")).alias("text")).mapInArrow(rows, SCHEMA)
