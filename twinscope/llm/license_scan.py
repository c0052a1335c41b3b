"""License scans: template markup compiled into token automata.

A template is text with ``<<optional>>...<</optional>>`` regions, which may be
absent, and ``<<var N M>>`` regions, which stand for N to M arbitrary words. All
other words are mandatory and must match exactly, in order. A template becomes a
position automaton over words; states without consumption (skipping an optional
region, leaving a variable one) are closed when it is compiled. A scan starts the
automaton wherever its first words can stand and takes the first place at which
it accepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_MARK = re.compile(r"<<(optional|/optional|var (\d+) (\d+))>>")

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Fixed value: the two conditions that several licenses open with.
_LIST = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<optional>>1.<</optional>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<optional>>2.<</optional>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)

# Mandatory, optional and replaceable wording of public license texts and of the notices that they ask for.
TEMPLATES = {
    "mit": [
        "<<optional>>the mit license<<optional>> mit<</optional>><</optional>> <<optional>>copyright <<var 0 12>><</optional>> permission is hereby granted, free of charge, to any person obtaining a copy of "
        "this software and associated documentation files (the \"software\"), to deal in the software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following "
        "conditions: the above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> "
        "shall be included in all copies or substantial portions of the software.",
        "<<optional>>released<</optional>><<optional>>licensed<</optional>><<optional>>distributed<</optional>> under the <<optional>>terms of the<</optional>> mit license",
    ],
    "mit-0": [
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), "
        "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the software, and to permit persons to whom the software is furnished to do so. the software is provided \"as is\"",
    ],
    "apache-2": [
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use <<var 1 4>> except in compliance with "
        "the license. you may obtain a copy of the license at <<optional>>http<</optional>><<optional>>https<</optional>> www.apache.org/licenses/license-2.0",
        "licensed under the apache license, version 2<<optional>>.0<</optional>>",
        "apache license version 2.0, january 2004 <<optional>>http<</optional>><<optional>>https<</optional>> www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution",
    ],
    "bsd-2-clause": [
        _LIST + "this software is provided by <<var 1 12>> as is",
    ],
    "bsd-3-clause": [
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. <<optional>>3.<</optional>> neither the name of "
        "<<var 1 14>> nor the names of <<optional>>its<</optional>><<optional>>the<</optional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-4-clause": [
        "all advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes software developed by <<var 1 16>> neither the name of",
    ],
    "0bsd": [
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software is provided \"as is\"",
    ],
    "isc": [
        "permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "zlib": [
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. "
        "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: <<optional>>1.<</optional>> the origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    ],
    "bsl-1": [
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") "
        "to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software",
        "distributed under the boost software license, version 1.0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "wtfpl": [
        "do what the fuck you want to public license",
    ],
    "cc0-1": [
        "<<optional>>to the extent possible under law<<var 0 16>><</optional>> has waived all copyright and related or neighboring rights to",
        "cc0 1.0 universal",
        "licensed under <<optional>>the<</optional>> cc0",
    ],
    "gpl-2": [
        "it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or <<optional>>(at your option)<</optional>> any later version",
        "under the terms of the gnu general public license version 2 <<optional>>only<</optional>> as published by the free software foundation",
        "gnu general public license version 2, june 1991",
        "licensed under the gnu general public license, version 2<<optional>> or later<</optional>>",
    ],
    "gpl-3": [
        "<<optional>>this work is<</optional>> licensed under the gnu general public license, version 3<<optional>> or later<</optional>>",
        "under the terms of the gnu general public license as published by the free software foundation, either version 3 of the "
        "license, or <<optional>>(at your option)<</optional>> any later version",
        "gnu general public license version 3, 29 june 2007",
    ],
    "lgpl-2.1": [
        "under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or <<optional>>(at your option)<</optional>> any later version",
        "gnu lesser general public license version 2.1, february 1999",
    ],
    "lgpl-3": [
        "under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or <<optional>>(at your option)<</optional>> any later version",
        "gnu lesser general public license version 3, 29 june 2007",
    ],
    "agpl-3": [
        "under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or <<optional>>(at your option)<</optional>> any later version",
        "gnu affero general public license version 3, 19 november 2007",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, "
        "you can obtain one at <<optional>>http<</optional>><<optional>>https<</optional>> <<optional>>www<</optional>> mozilla.org/mpl/2.0",
        "mozilla public license version 2.0",
    ],
    "epl-2": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license <<optional>>v<</optional>><<optional>>v.<</optional>> 2.0",
        "eclipse public license <<optional>>-<</optional>> v 2.0 the accompanying program is provided under the terms of this eclipse public license",
    ],
    "cc-by": [
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> creative commons attribution <<optional>>4.0<</optional>><<optional>>3.0<</optional>> <<optional>>international<</optional>><<optional>>unported<</optional>> license",
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> cc by <<optional>>4.0<</optional>><<optional>>3.0<</optional>> license",
    ],
    "cc-by-sa": [
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> creative commons attribution-sharealike <<optional>>4.0<</optional>><<optional>>3.0<</optional>> <<optional>>international<</optional>><<optional>>unported<</optional>> license",
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> cc by-sa",
    ],
    "cc-by-nd": [
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> creative commons attribution-noderivatives <<var 0 2>> <<optional>>international<</optional>> license",
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> cc by-nd",
    ],
    "cc-by-nc": [
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> cc by-nc<<optional>> 4.0<</optional>>",
        "licensed under <<optional>>a<</optional>><<optional>>the<</optional>> creative commons attribution-noncommercial <<var 0 2>> <<optional>>international<</optional>> license",
    ],
}


def words(text: str) -> list[str]:
    """ASCII capitals lowered; maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return _WORD.findall(text.translate(_LOWER) if not text.islower() else text)


@dataclass(frozen=True)
class Automaton:
    """States are positions in the wording. ``step[s]`` maps a word to a state, ``free[s]`` is where any word leads."""

    label: str
    start: frozenset[int]
    step: tuple[tuple[str, int] | None, ...]  # the word that state s waits for, and the state after it
    free: tuple[int, ...]  # the state after any word, or -1
    empty: tuple[frozenset[int], ...]  # states that s reaches without a word, itself included
    final: int
    mandatory: int

    @classmethod
    def compiled(cls, label: str, markup: str) -> Automaton:
        step: list[tuple[str, int] | None] = []
        free: list[int] = []
        jumps: list[list[int]] = []
        mandatory, open_at, at = 0, [], 0

        def state() -> int:
            step.append(None)
            free.append(-1)
            jumps.append([])
            return len(step) - 1

        here = state()

        def text(part: str) -> None:
            nonlocal here, mandatory
            for w in words(part):
                after = state()
                step[here] = (w, after)
                here = after
                mandatory += not open_at

        for m in _MARK.finditer(markup):
            text(markup[at : m.start()])
            at = m.end()
            if m[1] == "optional":
                open_at.append(here)
            elif m[1] == "/optional":
                begin, after = open_at.pop(), state()
                jumps[here].append(after)
                jumps[begin].append(after)
                here = after
            else:
                least, most = int(m[2]), int(m[3])
                passed = []
                for i in range(most):
                    if i >= least:
                        passed.append(here)
                    after = state()
                    free[here] = after
                    here = after
                after = state()
                for s in [*passed, here]:
                    jumps[s].append(after)
                here = after
        text(markup[at:])
        if open_at:
            raise ValueError(f"an optional region of {label} isn't closed")
        closed = []
        for s in range(len(step)):
            seen, todo = {s}, [s]
            while todo:
                for t in jumps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closed.append(frozenset(seen))
        return cls(label, closed[0], tuple(step), tuple(free), tuple(closed), here, mandatory)

    def first_words(self) -> set[str]:
        return {self.step[s][0] for s in self.start if self.step[s]}

    def match(self, text: list[str], at: int) -> int | None:
        """The end of the shortest match that starts at word ``at``, or None."""
        live = self.start
        for i in range(at, len(text) + 1):
            if self.final in live:
                return i
            if i == len(text) or not live:
                return None
            after: set[int] = set()
            for s in live:
                if self.step[s] and self.step[s][0] == text[i]:
                    after |= self.empty[self.step[s][1]]
                if self.free[s] >= 0:
                    after |= self.empty[self.free[s]]
            live = after
        return None


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        self.phrases = [(tuple(p.split()), label) for p, label in phrases.items()]
        self.automata = [Automaton.compiled(label, t) for label, forms in templates.items() for t in forms]
        self.starts: dict[str, list[Automaton]] = {}
        for a in self.automata:
            if a.final in a.start:
                raise ValueError(f"a template of {a.label} has no mandatory word")
            for w in a.first_words():
                self.starts.setdefault(w, []).append(a)
        self.heads: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for p, label in self.phrases:
            self.heads.setdefault(p[0], []).append((p, label))
        self.interesting = self.starts.keys() | self.heads.keys()

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """``(n_words, n_base, first_word, last_word, base_labels, labels, score)`` of a whole text."""
        own = words(text or "")
        places: list[int] = []
        base: set[str] = set()
        found: dict[str, int] = {}
        for w in self.interesting.intersection(own):
            at = -1
            while True:
                try:
                    at = own.index(w, at + 1)
                except ValueError:
                    break
                for phrase, label in self.heads.get(w, ()):
                    if tuple(own[at : at + len(phrase)]) == phrase:
                        places.append(at)
                        base.add(label)
                        found[label] = max(found.get(label, 0), len(phrase))
                for a in self.starts.get(w, ()):
                    if found.get(a.label, 0) < a.mandatory and a.match(own, at) is not None:
                        found[a.label] = a.mandatory
        most = max(found.values(), default=0)
        return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1 - 1 / (1 + most)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``: a row a row of ``docs``.

    Null counts as the empty text. ``n_base`` counts all places of all base
    phrases; the two word columns are null without any. ``score`` is 1 - 1/(1+m)
    for the most mandatory words m that one match holds, 0 without a match.
    Repeated rows get equal results; other columns aren't read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
