"""License scans: templates with optional and replaceable regions, compiled to automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches
from .wordstream import chunks, separators

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII, once A-Z are a-z.
WORDS = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases with the labels that the scan's contract names, word for word.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# License texts and notices in the words that their publishers give them, without
# signs and in lower case, as templates. [a | b] is optional, {n} stands for up to n words of any kind
# (names, years), the rest is mandatory.
_AS_IS = "is provided [by {12}] as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted [subject to the limitations in the disclaimer below] provided that the following conditions are met"
_BSD_TERMS = "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GNU = "this [program | library | file | {3}] is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software [and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software]",
        "mit license [copyright [c] {12} [all rights reserved]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "[released | licensed | distributed | available] under the [terms of the] mit [open source] license",
    ],
    "apache-2": [
        "apache [software] license [v | version] 2 [0]",
        "licensed under the apache license version 2 0 [the license]",
        "licensed under the apache license version 2 0 the license you may not use this {2} except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "cc-by-nc": ["[licensed under] [a] [creative commons] cc by nc [4 | 3 | 2] [0 | 5] [international | unported]", "creative commons attribution noncommercial [{2} license]"],
    "cc-by": ["this work is licensed under [a | the] creative commons attribution {2} [international | unported] license"],
    "gpl-3": [
        "gnu general public license [as published by the free software foundation] [either] [v | version] 3 [of the license] [or at your option any later version]",
        f"{_GNU} either version 3 of the license or at your option any later version [this {{3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details]",
    ],
    "gpl-2": [f"{_GNU} [either] version 2 [of the license] [or at your option any later version]"],
    "lgpl": ["gnu [lesser | library] general public license [as published by the free software foundation] [either] [v | version] 2 1 [of the license] [or at your option any later version]"],
    "bsd": [_BSD],
    "bsd-2": [f"{_BSD} {_BSD_TERMS} this software {_AS_IS}"],
    "bsd-3": [f"{_BSD} {_BSD_TERMS} [3] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [this software {_AS_IS}]"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {4} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
}


@dataclass
class Automaton:
    """A template's automaton. State s goes to step[s][word] or, if that is so, to any_step[s]; it is accepted in `accept`."""

    label: str
    step: list[dict[bytes, set[int]]]
    any_step: list[set[int]]
    start: set[int]
    accept: int
    anchor: bytes

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at word `at`, or -1."""
        states, end = self.start, -1
        for i in range(at, len(words)):
            word = words[i]
            following: set[int] = set()
            for s in states:
                following |= self.step[s].get(word, _NONE)
                following |= self.any_step[s]
            if not following:
                break
            states = following
            if self.accept in states:
                end = i + 1
        return end

    def first_words(self) -> set[bytes]:
        return {w for s in self.start for w in self.step[s]}


_NONE: frozenset[int] = frozenset()
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def compiled(label: str, template: str) -> Automaton:
    """Compiles a template. Its anchor is its longest mandatory word, which every match contains."""
    words: list[list[tuple[bytes, int]]] = [[]]
    free: list[set[int]] = [set()]
    skips: list[set[int]] = [set()]
    anchors: list[str] = []

    def state() -> int:
        words.append([])
        free.append(set())
        skips.append(set())
        return len(words) - 1

    tokens = re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", template)
    at = 0

    def sequence(here: int, depth: int) -> int:
        """Follows tokens until the region ends; returns the state after it."""
        nonlocal at
        while at < len(tokens) and tokens[at] not in "]|":
            token = tokens[at]
            at += 1
            if token == "[":
                after = state()
                skips[here].add(after)
                while True:
                    inner = state()
                    skips[here].add(inner)
                    skips[sequence(inner, depth + 1)].add(after)
                    at += 1
                    if tokens[at - 1] == "]":
                        break
                here = after
            elif token[0] == "{":
                for _ in range(int(token[1:-1])):
                    after = state()
                    free[here].add(after)
                    skips[here].add(after)
                    here = after
            else:
                if not depth:
                    anchors.append(token)
                after = state()
                words[here].append((token.encode(), after))
                here = after
        return here

    accept = sequence(0, 0)

    def closed(states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in skips[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    step: list[dict[bytes, set[int]]] = []
    for pairs in words:
        d: dict[bytes, set[int]] = {}
        for word, to in pairs:
            d.setdefault(word, set()).update(closed({to}))
        step.append(d)
    return Automaton(label, step, [closed(f) if f else set() for f in free], closed({0}), accept, max(anchors, key=len).encode())


@lru_cache(1)
def _automata() -> tuple[list[Automaton], list[Automaton]]:
    return [compiled(k, v) for k, v in BASE.items()], [compiled(k, v) for k, vs in TEMPLATES.items() for v in vs]


def scan(words: list[bytes], base: list[Automaton], own: list[Automaton]) -> dict:
    """Places and labels in one text's words: all places of base phrases, and matches of the templates."""
    starts: dict[bytes, list[tuple[Automaton, bool]]] = {}
    for automata, is_base in ((base, True), (own, False)):
        for a in automata:
            for word in a.first_words():
                starts.setdefault(word, []).append((a, is_base))
    places: list[int] = []
    spans: list[tuple[int, int, str]] = []
    base_labels, labels = set(), set()
    for i, word in enumerate(words):
        for a, is_base in starts.get(word, ()):
            end = a.longest(words, i)
            if end < 0:
                continue
            labels.add(a.label)
            spans.append((i, end, a.label))
            if is_base:
                places.append(i)
                base_labels.add(a.label)
    covered = sum(1 for _ in {k for lo, hi, _ in spans for k in range(lo, hi)})
    return {"places": places, "base_labels": base_labels, "labels": labels, "spans": spans, "score": covered / len(words) if words else 0.0}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels and places of license wording in every row's whole text; spans has every match (start, end, label), by words.

    n_base counts every place where a phrase of BASE stands, first_word and last_word are the least
    and greatest of these (null without any), labels also has what the templates accept, and score
    is the share of the text's words inside any match. A null or empty text has no words, empty
    labels and score 0. Repeated rows stay; other columns are not read. One pass, no shuffle: words
    are hashed for all texts of a batch at once, and the automata run on the texts that hold a
    mandatory word of some template.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, own = _automata()
        anchor_text = b" ".join(sorted({a.anchor for a in [*base, *own]})).decode()
        anchors = next(chunks(pa.array([anchor_text]), WORDS))[2].hashes()
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base_labels, labels = [""] * n, [""] * n
            spans: list[list[dict]] = [[] for _ in range(n)]
            for lo, hi, words in chunks(batch.column(1), WORDS):
                n_words[lo:hi] = np.diff(words.first)
                hit = np.flatnonzero(np.isin(words.hashes(), anchors))
                for d in np.unique(np.searchsorted(words.first, hit, "right") - 1):
                    found = scan(_WORD.findall(words.text(d).lower()), base, own)
                    places, i = found["places"], lo + int(d)
                    n_base[i], score[i] = len(places), found["score"]
                    if places:
                        first[i], last[i] = places[0], places[-1]
                    spans[i] = [{"start": a, "end": b, "label": label} for a, b, label in found["spans"]]
                    base_labels[i], labels[i] = ",".join(sorted(found["base_labels"])), ",".join(sorted(found["labels"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(spans, _SPANS)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: int, end: int, label: string>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan says of every document, without the spans."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
