"""Operator 2: license scan by conditional compression.

A block is the text as many words before and after a license word as the longest
template has, with the strange words allowed in it; blocks that overlap are one.
Words are lower-case, a version reads the same as ``v2.0``, ``v. 2.0`` and
``version 2``, and the numbers of list items are no words.

A template is a candidate of a block if the block has all its decisive words:
numbers, license names, qualifiers, negations and modal verbs. Each candidate is
put to a block as zstandard raw dictionary, and candidates are ranked by the
share that it takes off the compressed block. In that order, every place of the
block is held against the exact wording: at least ``agreement`` of the
template's words in order, at most ``strange`` words between them, no decisive
word missing or added, none of a narrower license right after, and no negation
before it in the sentence. Of confirmed notices that share words the one with
more words less its differences stays, then the one of higher rank. A license without a
template is no license of its relatives: it gives nothing.

One row a document: how many blocks were looked at, the confirmed licenses, and
for the one of the highest saving (ties: the name that sorts last) the words
missing and added. A null or empty text has no block. Texts are looked at whole,
however long; blocks of words that repeat take no more than their length.
Repeated rows get a row each, an empty table gives an empty result, and further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import words as W

# How licenses are named in a sentence, and the verbs before it.
VERBS = ["Licensed under", "Released under", "Distributed under", "Available under"]
NAMES = [
    ("MIT", "the MIT License"),
    ("MIT-0", "the MIT No Attribution License"),
    ("Apache-1.1", "the Apache Software License, Version 1.1"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.0", "the GNU Lesser General Public License, version 2.0"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    ("MPL-1.1", "the Mozilla Public License, version 1.1"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("EPL-1.0", "the Eclipse Public License, version 1.0"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("CC0-1.0", "CC0 1.0"),
]
# The parts of Creative Commons names.
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_VERSIONS = ["2.0", "3.0", "4.0"]

# Wording of common notices.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_APACHE_CREDIT = "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation. Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."
NOTICES = [
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", f"{_MIT}, subject to the following conditions"),
    ("MIT-0", f"{_MIT}."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-1.1", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY} {_APACHE_CREDIT}"),
    ("BSD-style", f"{_BSD}"),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY}"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES}"),
    ("BSD-4-Clause", f"{_BSD}: {_BSD_SOURCE} {_BSD_BINARY} {_BSD_ADVERT} {_BSD_NAMES}"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("all-rights-reserved", "All rights reserved."),
]
GNU = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.0", "Lesser General Public License", "2.0"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
       ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]

# Words that make another license, or none. Numbers are decisive too.
LICENSE_WORDS = (
    "mit isc bsd apache gnu gpl lgpl agpl lesser affero general mozilla mpl eclipse boost cc cc0 creative commons attribution noncommercial noderivatives sharealike "
    "by nc nd sa no public domain unencumbered warranty advertising endorse neither nor source binary"
).split()
NEGATIONS = "not no never cannot neither nor without unless except isn aren wasn weren doesn don didn formerly".split()
MODALS = "may must shall only all any".split()
DECISIVE = frozenset(LICENSE_WORDS + NEGATIONS + MODALS)
#: Right after a notice these name a narrower license than the notice does.
NARROWER = frozenset("nc nd sa noncommercial noderivatives sharealike attribution".split())

TRIGGER = r"(?i)licen[sc]|copyright|rights\W+reserved|redistribut|permission\W+(is\W|to\W+use)|free\W+software|public\W+domain|\bcc0?\b|\bbsd\b|released\W+under|distributed\W+under|available\W+under|subject\W+to\W+the"
_TRIGGER = re.compile(TRIGGER[4:], re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_ITEM = re.compile(r"(?:^|[\n.:;])[^\w\n]*\Z")
CACHE = 20_000
CACHE_BYTES = 1 << 16


def templates() -> list[tuple[str, str]]:
    """(license, wording): the notices, then every name after every verb."""
    names = NAMES + [(f"CC-{short}-{v}", f"CC {short} {v}") for short, _ in COMMONS for v in COMMONS_VERSIONS]
    names += [(f"CC-{short}-{v}", f"a Creative Commons {long} {v}") for short, long in COMMONS for v in COMMONS_VERSIONS]
    gnu = [(i, wording.format(name=name, version=version)) for i, name, version in GNU for wording in (_GNU, _GNU_ONLY)]
    return NOTICES + gnu + [(i, f"{verb} {name}") for i, name in names for verb in VERBS]


def decisive(word: str) -> bool:
    return word in DECISIVE or any(c.isdigit() for c in word)


def tokens(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """The words of a text, their starts and ends, and whether a sentence or paragraph ends before each."""
    words: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    breaks: list[bool] = []
    before = 0
    for m in _WORD.finditer(text):
        word, gap = m.group().lower(), text[before : m.start()]
        stop = not words or any(c in gap for c in ".;!?") or gap.count("\n") > 1
        if word.isdecimal() and len(word) < 3 and text[m.end() : m.end() + 1] in (".", ")") and (not words or words[-1] != "version") and _ITEM.search(gap if words else "\n" + gap):
            continue  # the number of a list item
        before = m.end()
        if word[0] == "v" and len(word) > 1 and word[1].isdecimal():
            words.append("version")
            starts.append(m.start())
            ends.append(m.start() + 1)
            breaks.append(stop)
            word, stop = word[1:], False
        elif word in ("v", "ver"):
            word = "version"
        elif word == "library" and words and words[-1] == "gnu":
            word = "lesser"
        elif word == "licence":
            word = "license"
        if word.endswith(".0") and word[0].isdecimal():
            word = word[:-2]
        words.append(word)
        starts.append(m.start())
        ends.append(m.end())
        breaks.append(stop)
    return words, starts, ends, breaks


class Scanner:
    def __init__(self, agreement: float = 0.9, strange: int = 3):
        import zstandard

        self.agreement, self.strange = agreement, strange
        self.alone = zstandard.ZstdCompressor(level=3)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        found = templates()
        self.names = [name for name, _ in found]
        self.wording = [tokens(text)[0] for _, text in found]
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=raw)) for words in self.wording]
        self.counts = [Counter(words) for words in self.wording]
        #: Words that a template cannot do without.
        self.needed = [Counter({w: n for w, n in counts.items() if decisive(w)}) for counts in self.counts]
        #: Words from a license word to the end of its notice at most, and as many as a sentence is looked back.
        self.reach = max(map(len, self.wording)) + strange + 5
        self.seen: OrderedDict[tuple, list[tuple]] = OrderedDict()

    def blocks(self, text: str) -> list[tuple[list[str], list[bool]]]:
        """The words round every license word, in one block where they overlap, and where sentences begin."""
        hits = [m.span() for m in _TRIGGER.finditer(text)]
        if not hits:
            return []
        words, starts, ends, breaks = tokens(text)
        spans: list[list[int]] = []
        for i, j in hits:
            left, right = max(bisect_left(ends, i) - self.reach, 0), min(bisect_left(starts, j) + self.reach, len(words))
            if spans and left <= spans[-1][1]:
                spans[-1][1] = right
            else:
                spans.append([left, right])
        return [(words[i:j], breaks[i:j]) for i, j in spans]

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(saving, template) of the candidates of a block, best first."""
        total = Counter(words)
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        found = []
        for t, counts in enumerate(self.counts):
            if all(total[w] >= n for w, n in self.needed[t].items()) and sum(min(n, total[w]) for w, n in counts.items()) >= self.agreement * len(self.wording[t]):
                found.append((-round(1 - len(self.given[t].compress(raw)) / size, 6), t))
        return [(-saving, t) for saving, t in sorted(found)]

    def confirm(self, template: int, block: list[str]) -> tuple[int, list[int], list[str], list[str]] | None:
        """(words less differences, their places in the block, missing, added) of the best run of matching parts that the wording allows."""
        want = self.wording[template]
        parts = [b for b in SequenceMatcher(None, want, block, autojunk=False).get_matching_blocks() if b.size]
        best = None
        for i in range(len(parts)):
            size = 0
            for j in range(i, len(parts)):
                size += parts[j].size
                added = parts[j].b + parts[j].size - parts[i].b - size
                if added > self.strange:
                    break
                score = 2 * size - len(want) - added
                if size >= self.agreement * len(want) and (best is None or score > best[0]):
                    ours = [k for b in parts[i : j + 1] for k in range(b.b, b.b + b.size)]
                    theirs = {k for b in parts[i : j + 1] for k in range(b.a, b.a + b.size)}
                    inside = set(ours)
                    missing = [w for k, w in enumerate(want) if k not in theirs]
                    strange = [block[k] for k in range(ours[0], ours[-1]) if k not in inside]
                    if not any(map(decisive, missing + strange)):
                        best = (score, ours, missing, strange)
        return best

    def find(self, template: int, words: list[str]) -> Iterator[tuple[int, list[int], list[str], list[str]]]:
        """What ``confirm`` says, with places in ``words``, from every word on that has enough of the template near it."""
        counts, span = self.counts[template], len(self.wording[template]) + self.strange
        need = self.agreement * len(self.wording[template])
        have: Counter[str] = Counter()
        shared, head, after = 0, 0, 0
        for first, w in enumerate(words):
            for new in words[head : first + span]:
                if new in counts:
                    have[new] += 1
                    shared += have[new] <= counts[new]
            head = max(head, min(first + span, len(words)))
            if w in counts:
                if first >= after and shared >= need and (found := self.confirm(template, words[first : first + span])):
                    yield found[0], [first + i for i in found[1]], *found[2:]
                    if not found[2] and not found[3]:  # nothing of this template inside a perfect copy is better
                        after = first + found[1][-1] + 1
                shared -= have[w] <= counts[w]
                have[w] -= 1

    def refused(self, words: list[str], breaks: list[bool], ours: list[int]) -> bool:
        """Whether the sentence denies the notice before it, or narrows it right after."""
        for i in range(ours[0] - 1, max(ours[0] - 5, -1), -1):
            if breaks[i + 1]:
                break
            if words[i] in NEGATIONS:
                return True
        for i in range(ours[-1] + 1, min(ours[-1] + 3, len(words))):
            if breaks[i]:
                break
            if words[i] in NARROWER:
                return True
        return False

    def judge(self, words: list[str], breaks: list[bool]) -> list[tuple]:
        """(saving, license, missing, added) of every confirmed notice; no two share a word."""
        matches = []
        for rank, (saving, t) in enumerate(self.ranked(words)):
            for score, ours, missing, added in self.find(t, words):
                if not self.refused(words, breaks, ours):
                    matches.append((-score, rank, ours[0], ours, saving, self.names[t], " ".join(missing), " ".join(added)))
        hits, taken = [], set()
        for _, _, _, ours, *hit in sorted(matches):
            if taken.isdisjoint(ours):
                taken.update(ours)
                hits.append(tuple(hit))
        return hits

    def scan(self, text: str) -> tuple:
        hits, blocks = [], self.blocks(text)
        for words, breaks in blocks:
            key = (" ".join(words), tuple(breaks))
            found = self.seen.get(key)
            if found is None:
                found = self.judge(words, breaks)
                if len(key[0]) <= CACHE_BYTES:
                    self.seen[key] = found
                if len(self.seen) > CACHE:
                    self.seen.popitem(last=False)
            hits += found
        best = max(hits, key=lambda h: (h[0], h[1], h[2:])) if hits else (None, None, None, None)
        return len(blocks), ",".join(sorted({h[1] for h in hits})), *best


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses, and of the best: saving, license, missing, added."""
    names = ["doc_id", "n_blocks", "licenses", "saving", "license", "missing", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in W.slices(batch, "text"):
                column = part.column("text")
                hit = pc.fill_null(pc.match_substring_regex(column, TRIGGER), False)
                rows = [scanner.scan(t.as_py()) if h else (0, "", None, None, None, None) for t, h in zip(column, hit.to_pylist())]
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
                yield pa.record_batch([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_blocks long, licenses string, saving double, license string, missing string, added string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
