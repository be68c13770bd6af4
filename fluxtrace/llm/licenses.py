"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is text in which `<<opt>> ... <</opt>>` marks words that may be absent (and may hold other regions) and
`<<var a-b>>` stands for a to b words of any kind. All other words are mandatory and must match exactly; case,
punctuation and spacing do not count. Each template becomes a nondeterministic automaton over words. It is tried around
every place of its anchor (its first run of mandatory words) and accepts where the simulation reaches its last state.

Labels with `-notice` stand for a sentence that names the license, those with `-header` or `-grant` for its usual header or
its permission alone, `spdx-` for an identifier line; a bare label asks for the whole wording, disclaimer included.

Edge cases: null and empty texts hold no license (score 0, first and last word null); a notice repeated in a text counts
at each place; columns other than doc_id and text do not matter; the whole of every text is read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, batches, folded_words, pieces, plain

# Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses and of the usual notices, with the regions that may differ.
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software"
_ISC = "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "neither the name of <<var 1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by the <<var 1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<var 1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = {
    "mit-notice": "released under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0-notice": "licensed under the <<opt>>terms of the<</opt>> apache license <<opt>>version<</opt>> 2.0",
    "apache-2.0-header": "licensed under the apache license version 2.0 <<opt>>the license<</opt>> you may not use this <<var 1-3>> except in compliance with the license <<opt>>you may obtain a copy of the license at <<opt>>http<</opt>> www apache org licenses license 2.0<</opt>>",
    "cc-by-4.0-notice": "licensed under <<opt>>a creative commons attribution<</opt>> cc by 4.0",
    "cc-by-sa-4.0-notice": "licensed under cc by sa 4.0",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4.0",
    "gpl-3.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> <<opt>>version<</opt>> 3",
    "gpl-2.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> <<opt>>version<</opt>> 2",
    "lgpl-3.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu lesser general public license <<opt>>version<</opt>> 3",
    "mpl-2.0-notice": "subject to the terms of the mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2.0",
    "mit-grant": _MIT,
    "mit": f"{_MIT} the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var 1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": _ISC,
    "isc": f"{_ISC} the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD_SOURCE} <<var 0-1>> {_BSD_BINARY} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_SOURCE} <<var 0-1>> {_BSD_BINARY} <<var 0-1>> {_BSD_NAME} {_BSD_END}",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "spdx-mit": "spdx license identifier mit",
    "spdx-isc": "spdx license identifier isc",
    "spdx-apache-2.0": "spdx license identifier apache 2.0",
    "spdx-bsd-2-clause": "spdx license identifier bsd 2 clause",
    "spdx-bsd-3-clause": "spdx license identifier bsd 3 clause",
    "spdx-gpl-2.0": "spdx license identifier gpl 2.0",
    "spdx-gpl-3.0": "spdx license identifier gpl 3.0",
    "spdx-lgpl-3.0": "spdx license identifier lgpl 3.0",
    "spdx-mpl-2.0": "spdx license identifier mpl 2.0",
    "spdx-cc-by-4.0": "spdx license identifier cc by 4.0",
    "spdx-cc0-1.0": "spdx license identifier cc0 1.0",
    "spdx-unlicense": "spdx license identifier unlicense",
}

#: A match with so many mandatory words scores a half on its own.
HALF_WORDS = 4


_MARK = re.compile(r"<<(/?opt|var (\d+)-(\d+))>>|([^\s<]+)")


class Automaton:
    """One template. State s reads a word and goes on; `skips` are moves that read nothing; `anys` read any word."""

    def __init__(self, label: str, template: str):
        self.label, self.mandatory = label, 0
        self.words: list[dict[bytes, int]] = [{}]
        self.anys: list[set[int]] = [set()]
        self.skips: list[set[int]] = [set()]
        anchor: list[bytes] = []
        opened: list[int] = []
        last, closed = 0, False
        self.before = [0, 0]  # fewest and most words before the anchor
        for mark, low, high, word in _MARK.findall(template):
            closed = closed or bool(mark and anchor)
            if mark == "opt":
                opened.append(last)
            elif mark == "/opt":
                if not opened:
                    raise ValueError(f"{label}: a region ends that was not begun")
                self.skips[opened.pop()].add(last)
            elif mark:
                for i in range(int(high)):
                    self.anys[last].add(new := self._state())
                    if i >= int(low):
                        self.skips[last].add(new)
                    last = new
                if not anchor:
                    self.before[0] += 0 if opened else int(low)
                    self.before[1] += int(high)
            for w in folded_words(word.encode()):
                self.words[last][w] = new = self._state()
                last = new
                if opened:
                    self.before[1] += not anchor
                    continue
                self.mandatory += 1
                if not closed:
                    anchor.append(w)
        if opened or not anchor:
            raise ValueError(f"{label}: " + ("a region does not end" if opened else "no word is mandatory"))
        self.anchor, self.last = b" ".join(anchor), last
        self.closed = [self._closure({s}) for s in range(len(self.words))]

    def _state(self) -> int:
        for table in (self.words, self.anys, self.skips):
            table.append({} if table is self.words else set())
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, done = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - done:
                done.add(s)
                todo.append(s)
        return frozenset(done)

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the words from start on begin with a text of the template."""
        now = self.closed[0]
        for i in range(start, len(words) + 1):
            if self.last in now:
                return True
            if i == len(words) or not now:
                return False
            step = {self.words[s][words[i]] for s in now if words[i] in self.words[s]} | {t for s in now for t in self.anys[s]}
            now = frozenset().union(*(self.closed[s] for s in step)) if step else frozenset()
        return False

    def places(self, joined: bytes, words: list[bytes]) -> list[int]:
        """Starts of the texts of the template, for each place of the anchor the last one that fits; joined: the words with
        one space before and after each. Words are counted on from the place before, so many places take linear time."""
        found, at, counted, start, anchor = [], 0, 0, 0, b" " + self.anchor + b" "
        while (at := joined.find(anchor, at)) >= 0:
            start += joined.count(b" ", counted, at)
            counted = at
            fits = (s for s in range(start - self.before[0], start - self.before[1] - 1, -1) if s >= 0 and self.accepts(words, s))
            if (first := next(fits, None)) is not None and found[-1:] != [first]:
                found.append(first)
            at += 1
        return found


def compiled(templates: dict[str, str] = TEMPLATES) -> list[Automaton]:
    return [Automaton(label, text) for label, text in templates.items()]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_out = batches({"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()})


def scan_text(text: bytes | None, base: list[tuple[Automaton, str]], others: list[Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = folded_words(text)
    joined = b" " + b" ".join(words) + b" "
    places, labels, rest = [], set(), 1.0
    for automaton, label in base:
        if found := automaton.places(joined, words):
            places += found
            labels.add(label)
            rest *= HALF_WORDS / (HALF_WORDS + automaton.mandatory)
    every = set(labels)
    for automaton in others:
        if automaton.places(joined, words):
            every.add(automaton.label)
            rest *= HALF_WORDS / (HALF_WORDS + automaton.mandatory)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1 - rest


def license_scan(docs: DataFrame, *, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: places and labels of the base phrases, all labels, and a score from 0 to 1 that grows with the mandatory words matched."""

    def scan(parts):
        phrases = [(Automaton(phrase, phrase), label) for phrase, label in base.items()]
        others = compiled(templates)
        for batch in pieces(parts):
            rows = [scan_text(text, phrases, others) for text in as_bytes(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield _out(dict(zip(_out_names, [batch.column(0), *map(list, columns)], strict=True)))

    return plain(docs, "doc_id", "text").mapInArrow(scan, SCHEMA)


_out_names = [x.split()[0] for x in SCHEMA.split(", ")]
