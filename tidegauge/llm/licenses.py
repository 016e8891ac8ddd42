"""Licence texts: templates with optional and replaceable regions, compiled into automata over words.

In a template, ``[[ ... ]]`` may be left out (it may hold other regions), ``{a|b}`` is any one of some words and ``<m-n>`` stands for m to n words
of any kind. All other wording is mandatory and must match exactly, word by word, in lower case and without
punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.words import flat, sliced, words_of

# fixed values: phrases and their labels
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# parts of the notices published with the GNU licences
_SENTENCE = "[[this {work|program|library|software|file} is]] {licensed|released|distributed} under the [[terms of the]] gnu"
_HEADER = """[[[[this {work|program|library|software|file} is]] free software]] [[you {can|may}]] redistribute it and or modify it
    under the terms of the gnu"""
_PUBLISHED = "as published by the free software foundation"
_LATER = "[[or [[at your option]] [[any]] later [[version]]]]"


def _sentence(name: str, version: str) -> str:
    return f"{_SENTENCE} {name} general public license [[{_PUBLISHED} [[either]]]] version {version} [[of the license]] {_LATER}"


def _header(name: str, version: str) -> str:
    return f"{_HEADER} {name} general public license {_PUBLISHED} [[either]] version {version} {_LATER}"


# parts of the published licences
_NO_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
    warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {} be liable for any claim
    damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
    the use or other dealings in the software"""
_CONTRIBUTORS = "{its|their} contributors"
_BSD_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list
    of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above
    copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
    provided with the distribution"""
_BSD_DISCLAIMER = """this software is provided by <1-12> as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <1-12> be liable for any direct
    indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
    services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
    liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
    possibility of such damage"""
# wording of public licences and notices, with the regions that vary
TEMPLATES = {
    "mit-text": """[[the mit license mit]] [[copyright [[c]] <1-12> [[all rights reserved]]]] permission is hereby granted free of charge
        to any person obtaining a copy of {this|the} software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software """
    + _NO_WARRANTY.format("authors or copyright holders"),
    "isc-text": """[[isc license]] [[copyright [[c]] <1-12>]] permission to use copy modify and [[or]] distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and <1-12> {disclaims|disclaim} all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <1-12> be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""",
    "bsd-text": f"""{_BSD_CONDITIONS} [[[[3]] neither the name of <1-12> nor the names of {_CONTRIBUTORS} may be used to
        endorse or promote products derived from this software without specific prior written permission]] {_BSD_DISCLAIMER}""",
    "bsd-4-text": f"""{_BSD_CONDITIONS} [[3]] all advertising materials mentioning features or use of this software must display the
        following {{acknowledgement|acknowledgment}} this product includes software developed by <1-16> [[4]] neither the name of <1-12> nor the
        names of {_CONTRIBUTORS} may be used to endorse or promote products derived from this software without specific prior written
        permission {_BSD_DISCLAIMER}""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial
        and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law """
    + _NO_WARRANTY.format("authors"),
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will <1-12> be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of
        this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
        product an {acknowledgment|acknowledgement} in the product documentation would be appreciated but is not required [[2]] altered source
        versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not
        be removed or altered from any source distribution""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 [[the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at <1-12>]]""",
    "gpl-2.0-notice": _sentence("", "2"),
    "gpl-3.0-notice": _sentence("", "3"),
    "lgpl-2.0-notice": _sentence("library", "2"),
    "lgpl-2.1-notice": _sentence("lesser", "2 1"),
    "lgpl-3.0-notice": _sentence("lesser", "3"),
    "gpl-2.0-header": _header("", "2 [[of the license]]"),
    "gpl-2.0-only-header": f"{_HEADER} general public license version 2 {_PUBLISHED}",
    "gpl-3.0-header": _header("", "3 [[of the license]]"),
    # the lesser licence has no version 2, yet notices name it; without the words after it this could be 2.1
    "lgpl-2.0-header": _header("{library|lesser}", "2 of the license"),
    "lgpl-2.1-header": _header("lesser", "2 1 [[of the license]]"),
    "lgpl-3.0-header": _header("lesser", "3 [[of the license]]"),
    "agpl-3.0-notice": _sentence("affero", "3"),
    "agpl-3.0-header": _header("affero", "3 [[of the license]]"),
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license [[v]] 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at {http|https} [[www]] mozilla org mpl 2 0""",
    "epl-2.0-notice": """[[this program and the accompanying materials are]] made available under the terms of the eclipse public license
        [[{v|version}]] {2|v2} 0""",
    "cc0-1.0-notice": "to the extent possible under law <1-12> has waived all copyright and related or neighboring rights to <1-12>",
    "cc-by-4.0-notice": """[[this work is]] licensed under [[a|the]] creative commons attribution 4 0 international [[{license|licence}]]""",
    "spdx-line": "spdx license identifier {mit|isc|apache|bsd|gpl|lgpl|agpl|mpl|epl|zlib|unlicense|cc0|cc}",
    "mit-notice": "{licensed|released|distributed} under the [[terms of the]] mit license",
    "cc-by-nc-4.0-notice": "[[this work is]] {licensed|released} under [[a|the]] cc by nc 4 0 [[license]]",
    "rights-reserved": "[[copyright [[c]] <1-12>]] all rights reserved",
}
FULL_WORDS = 20  # an accepted text of so many words is a whole licence or notice
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"\[\[|\]\]|\{[^}]*\}|<\d+-\d+>|[^\s\[\]{}<>]+")
ANY = None


class Automaton:
    """States are numbers; ``moves`` reads one of some words (or any word), ``jumps`` reads none."""

    def __init__(self, template: str):
        self.moves: list[tuple[frozenset[bytes] | None, int] | None] = [None]
        self.jumps: dict[int, list[int]] = {}
        self.least, opened = 0, []
        self.mandatory: list[bytes] = []
        for part in _MARKUP.findall(template):
            if part == "[[":
                opened.append(self._end())
            elif part == "]]":
                self.jumps.setdefault(opened.pop(), []).append(self._end())
            elif part[0] == "<":
                least, most = map(int, part[1:-1].split("-"))
                begun = [self._read(ANY) for _ in range(most)]
                for state in begun[least:]:
                    self.jumps.setdefault(state, []).append(self._end())
            else:
                words = frozenset(w.encode() for w in part.strip("{}").split("|"))
                self._read(words)
                if not opened:
                    self.least += 1
                    if len(words) == 1:
                        self.mandatory += words
        self.accepting = self._end()
        self.anchor = max(self.mandatory, key=len)
        self.begin = self.closure([0])

    def _end(self) -> int:
        return len(self.moves) - 1

    def _read(self, words: frozenset[bytes] | None) -> int:
        state = self._end()
        self.moves[state] = (words, state + 1)
        self.moves.append(None)
        return state

    def closure(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for state in self.jumps.get(todo.pop(), ()):
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        return frozenset(seen)

    def firsts(self) -> set[bytes]:
        return {w for s in self.begin if (m := self.moves[s]) and m[0] for w in m[0]}

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        return self.closure([m[1] for s in states if (m := self.moves[s]) and (m[0] is ANY or word in m[0])])

    def end_of(self, words: list[bytes], at: int) -> int:
        """Where the longest accepted run from ``at`` ends, or -1."""
        states, end = self.begin, -1
        while states:
            if self.accepting in states:
                end = at
            if at == len(words):
                break
            states, at = self.step(states, words[at]), at + 1
        return end


def automata() -> dict[str, Automaton]:
    return {label: Automaton(template) for label, template in TEMPLATES.items()}


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place of a phrase, in words from 0."""
    out = []
    for phrase, label in PHRASES.items():
        parts = [w.encode() for w in phrase.split()]
        out += [(i, label) for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts]
    return sorted(out)


def template_places(words: list[bytes], raw: bytes, compiled: dict[str, Automaton]) -> list[tuple[int, int, str]]:
    """Start, end and label of accepted texts; of one template, the longest from the left, not overlapping."""
    out = []
    for label, automaton in compiled.items():
        if automaton.anchor not in raw:
            continue
        firsts, upto = automaton.firsts(), 0
        for i, word in enumerate(words):
            if i >= upto and word in firsts and (end := automaton.end_of(words, i)) > i:
                out.append((i, end, label))
                upto = end
    return sorted(out)


FOUND = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,
    score double, spans string"""


def found(docs: DataFrame) -> DataFrame:
    """Licence phrases and texts of every row of ``docs`` (``doc_id, text``).

    ``n_base, first_word, last_word, base_labels`` are of the phrases alone, ``labels`` of phrases and templates, ``spans`` (label:start:end in
    words) of templates. ``score`` is 1 for a whole text of FULL_WORDS words or more, 0.8 for an accepted notice, 0.5 for a phrase
    only, else 0. Null and empty texts have no words, null places and empty labels. Null ids and repeated rows
    stay rows of their own; other columns are not read.
    """
    compiled = automata()
    needles = {phrase.split()[-1].encode() for phrase in PHRASES} | {a.anchor for a in compiled.values()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            counts = words_of(batch.column("text"), True, _WORD_BYTES).counts()
            data, offsets = flat(batch.column("text"))
            raw = data.tobytes().lower()  # bytes: A-Z only
            rows: list[list] = [[] for _ in range(7)]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own, base, texts = raw[a:b], [], []
                if any(x in own for x in needles):
                    words = _WORD.findall(own)
                    base, texts = phrase_places(words), template_places(words, own, compiled)
                longest = max((end - start for start, end, _ in texts), default=0)
                base_labels = {label for _, label in base}
                values = (
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    ",".join(sorted(base_labels)),
                    ",".join(sorted(base_labels | {label for *_, label in texts})),
                    1.0 if longest >= FULL_WORDS else 0.8 if texts else 0.5 if base else 0.0,
                    ",".join(f"{label}:{start}:{end}" for start, end, label in texts),
                )
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), *map(pa.array, rows, kinds)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FOUND)
