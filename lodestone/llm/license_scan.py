"""License scan by sentence rules.

A text is cut into sentences; each normalised sentence that is a known
licence sentence becomes that sentence's number; the numbers, in text order,
are matched against ordered rules. A rule matches where its sentences follow
each other in the sequence, with at most ``gap`` words of other text between
two of them. Longer rules win over shorter ones that they contain.

Sentences are looked for twice: within lines, and across line breaks for
wrapped notices (comment marks at line starts are dropped).

Defined results: a null or empty text has no match; equal matches at several
places all count; repeated rows come back each; offsets are code points of
the original text; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, tidy

MAX_GAP = 40

# Known licence sentences, and the rules over their names, in order.
SENTENCES = {
    "apache-grant": "Licensed under the Apache License, Version 2.0.",
    "apache-grant-long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-free-21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-free-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-licensed": "Licensed under CC0 1.0.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "rights-reserved": "All rights reserved.",
}
RULES = (
    ("Apache-2.0", ("apache-grant-long", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-grant-long", "apache-copy")),
    ("Apache-2.0", ("apache-grant-long",)),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl-work-3",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-only", ("gpl-work-2",)),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("LGPL-2.1-or-later", ("lgpl-free-21", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-free-21",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-free-3",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("EPL-2.0", ("epl-terms",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("CC0-1.0", ("cc0-licensed",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
)
# Every licence of the rules also has its machine-readable tag.
TAGGED = tuple(dict.fromkeys(name for name, _ in RULES if not name.startswith("LicenseRef")))
SENTENCES |= {f"tag-{name}": f"SPDX-License-Identifier: {name}" for name in TAGGED}
RULES += tuple((name, (f"tag-{name}",)) for name in TAGGED)

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
# a tag's colon doesn't end a sentence
BREAK = re.compile(r"(?<!Identifier:)(?<=[.!?:;])[)\"']*\s+|\n+")
WRAPPED_BREAK = re.compile(r"(?<!Identifier:)(?<=[.!?:;])[)\"']*\s+|\n\s*\n")
COMMENT = re.compile(r"^[ \t]*(?:\*|//|#|;|--|/\*|\d+\.)+[ \t]*", re.MULTILINE)


def normalised(sentence: str) -> str:
    """Lower-case words joined by single spaces; punctuation goes."""
    return " ".join(WORD.findall(sentence.lower()))


def pieces(sentence: str) -> list[str]:
    """A known sentence as the scanner would cut it."""
    return [normalised(x) for x in BREAK.split(sentence) if normalised(x)]


@dataclass(frozen=True)
class Catalogue:
    """Sentence pieces by number, rules over the numbers, and cue words."""

    numbers: dict[str, int]
    rules: tuple[tuple[str, tuple[int, ...]], ...]
    cues: re.Pattern

    @staticmethod
    def build(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> Catalogue:
        numbers: dict[str, int] = {}
        parts = {k: [numbers.setdefault(p, len(numbers)) for p in pieces(s)] for k, s in sentences.items()}
        ordered = [(name, tuple(n for k in keys for n in parts[k])) for name, keys in rules]
        ordered.sort(key=lambda r: -len(r[1]))  # stable: longer rules first, then as listed
        cues = sorted({max(p.split(" "), key=len) for p in numbers})
        return Catalogue(numbers, tuple(ordered), re.compile("|".join(map(re.escape, cues))))


def sentence_spans(text: str, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in breaks.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def known_sentences(text: str, catalogue: Catalogue) -> list[tuple[int, int, int]]:
    """``(start, end, number)`` of known sentences, by start."""
    if not catalogue.cues.search(text.lower()):
        return []
    found = {}
    plain = COMMENT.sub(lambda m: " " * len(m[0]), text)  # offsets stay
    for source, breaks in ((text, BREAK), (plain, WRAPPED_BREAK)):
        for s, e in sentence_spans(source, breaks):
            k = catalogue.numbers.get(normalised(source[s:e]))
            if k is not None:
                found.setdefault((s, k), (s, e, k))
    return sorted(found.values())


def words_between(text: str, places: list[tuple[int, int]]) -> list[int]:
    """Blank-separated words of each stretch ``[a, b)`` of a text, read once."""
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    out = []
    for a, b in places:
        lo, hi = bisect_left(starts, a), bisect_left(starts, b)
        inside = a < b and not text[a].isspace() and (lo == len(starts) or starts[lo] != a)  # begins within a word
        out.append(hi - lo + inside)
    return out


def match_rules(text: str, found: list[tuple[int, int, int]], catalogue: Catalogue, gap: int = MAX_GAP) -> list[tuple[int, int, str, int]]:
    """``(start, end, licence, sentences)``; no sentence serves two matches.

    From a sentence only those within ``gap`` words are looked at, so the work
    is linear in the sentences.
    """
    near: list[list[int]] = [[] for _ in found]  # what may follow each sentence
    edge: list[tuple[int, int]] = []
    for i, (_, end, _) in enumerate(found):
        for j in range(i + 1, len(found)):
            if len(near[i]) > 2 * gap + 2:  # two passes, each with a word a sentence at least
                break
            if found[j][0] >= end:
                near[i].append(j)
                edge.append((end, found[j][0]))
    words = iter(words_between(text, edge))
    near = [[j for j in js if next(words) <= gap] for js in near]
    out, used = [], set()
    for name, numbers in catalogue.rules:
        for i, (start, _, k) in enumerate(found):
            if k != numbers[0] or i in used:
                continue
            chain, at = [i], i
            for want in numbers[1:]:
                nxt = next((j for j in near[at] if found[j][2] == want and j not in used), None)
                if nxt is None:
                    break
                chain.append(nxt)
                at = nxt
            if len(chain) == len(numbers):
                used.update(chain)
                out.append((start, found[at][1], name, len(chain)))
    return sorted(out)


def find_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = MAX_GAP) -> DataFrame:
    """``(doc_id, n_sentences, matches array<struct<...>>)`` for each row."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue.build(sentences, rules)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("sentences", pa.int64())]))
        for b in batches:
            counts, rows = [], []
            for t in b.column(1).to_pylist():
                found = known_sentences(t or "", catalogue)
                counts.append(len(found))
                rows.append([dict(zip(("start", "end", "license", "sentences"), m)) for m in match_rules(t or "", found, catalogue, gap)] if found else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_sentences", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(scan), "doc_id long, n_sentences long, matches array<struct<start: long, end: long, license: string, sentences: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the sorted distinct licences, and the matches as text."""
    return found.select(
        "doc_id", "n_sentences",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )
