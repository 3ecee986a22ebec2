"""License texts and notices in documents, by matching templates with markup.

A template is wording with two kinds of marked regions, written as in the SPDX matching guidelines: text between ``<<beginOptional>>``
and ``<<endOptional>>`` may be absent, and ``<<var;name="owner";words=1-12>>`` stands for any words, as many as it says. It is compiled once into an
automaton over words: an arc per word of the wording, an arc for any word in a replaceable region, and arcs around optional ones. A place in a text
is a match when the automaton accepts from there, that is when all mandatory wording stands there exactly, punctuation and
case of ASCII letters aside. Of several ends the longest counts. Texts are read whole; each word where a template can begin is tried.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII letters in lower case, digits and all bytes of other characters make words; the rest of ASCII separates them.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
_LIMITS = re.compile(r"words=(\d+)-(\d*)")

#: Phrases without markup. Fixed values.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words=1-16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";words=1-16>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Templates of licenses, notices and statements by label. The wording of the public license texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "apache-2-notice": """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organisation";words=1-16>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.<<endOptional>> """ + _DISCLAIMER,
    "cc-by-nc-4": "CC BY-NC 4.0",
    "cc-license": """licensed under a Creative Commons Attribution<<beginOptional>>-NonCommercial<<endOptional>><<beginOptional>>-ShareAlike<<endOptional>><<beginOptional>>-NoDerivatives<<endOptional>>
        <<beginOptional>><<var;name="version";words=2-2>><<endOptional>> <<beginOptional>>International<<endOptional>> License""",
    "copyright-notice": """Copyright <<beginOptional>>(c)<<endOptional>> <<beginOptional>>©<<endOptional>> <<var;name="years and owner";words=1-12>> <<beginOptional>>.<<endOptional>> All rights reserved""",
    "gpl-3-notice": """licensed under the GNU General Public License, <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License, or (at your option) any later version<<endOptional>>""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version <<var;name="version";words=1-1>> of the License, or (at your option) any later version.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.<<endOptional>>""",
    "mit-notice": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";words=1-16>> BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "mpl-2-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of the MPL was not distributed with this file, You can
        obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/.<<endOptional>>""",
    "spdx-tag": 'SPDX-License-Identifier: <<var;name="identifier";words=1-6>>',
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8, ASCII letters in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclasses.dataclass(frozen=True)
class Automaton:
    """``arcs`` of each state: word to next states, None for any word. States are closed over arcs around optional regions. ``wording`` counts words of the wording."""

    start: tuple[int, ...]
    arcs: tuple[dict[bytes | None, tuple[int, ...]], ...]
    final: frozenset[int]
    wording: int

    def firsts(self) -> set[bytes]:
        """Words with which a match can begin; a template that begins with a replaceable region has none such."""
        found = {w for s in self.start for w in self.arcs[s]}
        if None in found or self.final & set(self.start):
            raise ValueError("a template must begin with mandatory wording")
        return found

    def match(self, words: list[bytes], at: int) -> tuple[int, float] | None:
        """End of the longest match that starts at a word, and the share of the wording that it has; None where there is none."""
        live, best, i = dict.fromkeys(self.start, 0), None, at
        while live:
            done = [n for s, n in live.items() if s in self.final]
            if done:
                best = (i, max(done) / self.wording)
            if i == len(words):
                break
            after: dict[int, int] = {}
            for s, n in live.items():
                for key, gain in ((words[i], 1), (None, 0)):
                    for t in self.arcs[s].get(key, ()):
                        after[t] = max(after.get(t, 0), n + gain)
            live, i = after, i + 1
        return best


def compile_template(template: str) -> Automaton:
    """The automaton of a template. Regions may nest; a replaceable region without an upper limit takes words without end."""
    arcs: list[list[tuple[bytes | None, int]]] = [[]]
    around: list[list[int]] = [[]]

    def state() -> int:
        arcs.append([])
        around.append([])
        return len(arcs) - 1

    here, opened, wording = 0, [], 0
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            for word in words_of(part):
                there = state()
                arcs[here].append((word, there))
                here, wording = there, wording + 1
        elif part == "beginOptional":
            opened.append(here)
            there = state()
            around[here].append(there)
            here = there
        elif part == "endOptional":
            there = state()
            around[here].append(there)
            around[opened.pop()].append(there)
            here = there
        else:
            least, most = _LIMITS.search(part).groups()
            skips = []
            for n in range(int(most or least)):
                if n >= int(least):
                    skips.append(here)
                there = state()
                arcs[here].append((None, there))
                here = there
            if not most:
                arcs[here].append((None, here))
            for s in skips:
                around[s].append(here)
    if opened:
        raise ValueError("an optional region is not closed")

    def closed(s: int) -> tuple[int, ...]:
        seen, todo = {s}, [s]
        while todo:
            for t in around[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return tuple(sorted(seen))

    table = []
    for own in arcs:
        step = defaultdict(set)
        for word, t in own:
            step[word].update(closed(t))
        table.append({w: tuple(sorted(ts)) for w, ts in step.items()})
    return Automaton(closed(0), tuple(table), frozenset({here}), max(wording, 1))


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[bytes, list[tuple[str, Automaton]]]:
    """By first word, the templates that can begin with it."""
    found = defaultdict(list)
    for label, text in templates:
        automaton = compile_template(text)
        for word in automaton.firsts():
            found[word].append((label, automaton))
    return dict(found)


def places(words: list[bytes], table: dict[bytes, list[tuple[str, Automaton]]]) -> list[tuple[str, int, int, float]]:
    """(label, first word, word after the last, share of the wording) of every place where a template matches."""
    found = []
    for i, word in enumerate(words):
        for label, automaton in table.get(word, ()):
            hit = automaton.match(words, i)
            if hit:
                found.append((label, i, *hit))
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of df: id, ``n_words``, ``phrase_places`` and ``template_places``, arrays of (label, start, end, share) counted in words, every place of each.

    A null text is an empty one; neither has places. Repeated rows give rows of their own, an empty table none; other columns play no part, whatever their names.
    ``templates`` and ``phrases`` are by default those of this module.
    """
    own = (tuple((phrases if phrases is not None else PHRASES).items()), tuple((templates if templates is not None else TEMPLATES).items()))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [compiled(x) for x in own]
        for batch in batches:
            counts, found = [], ([], [])
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                for k in (0, 1):
                    found[k].append([dict(zip(("label", "start", "end", "share"), p, strict=True)) for p in places(words, tables[k])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *[pa.array(x, kind) for x in found]], names=["id", "n_words", "phrase_places", "template_places"])

    spot = "array<struct<label:string,start:long,end:long,share:double>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_words long, phrase_places {spot}, template_places {spot}").withColumnRenamed("id", id_col)
