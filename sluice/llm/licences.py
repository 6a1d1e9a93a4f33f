"""Licence scans: matching statistics against a suffix automaton of licence templates, chained into covered spans.

The automaton is built over the words of all templates (a generalised one: each template starts from the root). Streaming
a text's words through it gives, at each word, the longest run of words ending there that stands in some template. Long
runs that follow one another in a template, with gaps no longer than they are, make a chain; a chain that covers enough
of its template yields the template's label. Fixed phrases are looked up in the same stream: a state tells which phrases
end there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cached, over_batches
from .textbatch import ascii_lower, buffers, span_hashes, spans, word_table

#: Phrases that are always reported, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of public licences and their usual notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification you just do what the fuck you want to"),
]

#: Words of a run that a chain is made of; share of a template that a chain covers at least; words at least.
LEAST_RUN, LEAST_SHARE, LEAST_WORDS = 4, 0.6, 6


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    #: For each template that has the state's words, where they first end.
    ends: dict[int, int] = field(default_factory=dict)
    #: Phrases that the state's longest run of words ends with.
    phrases: list[int] = field(default_factory=list)


class Automaton:
    """A generalised suffix automaton of sequences of word numbers."""

    def __init__(self, sequences: list[list[int]], phrases: list[list[int]]) -> None:
        self.states = [State(0, -1)]
        self.phrase_words = [len(p) for p in phrases]
        for t, words in enumerate([*sequences, *phrases]):
            last = 0
            for at, w in enumerate(words):
                last = self._grow(last, w)
                if t < len(sequences):
                    self.states[last].ends.setdefault(t, at)
        order = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in order:
            if (up := self.states[s].link) > 0:
                have = self.states[up].ends
                for t, at in self.states[s].ends.items():
                    have[t] = min(at, have.get(t, at))
        homes: dict[int, list[int]] = {}
        for k, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.states[s].next[w]
            homes.setdefault(s, []).append(k)
        for s in reversed(order):
            self.states[s].phrases = homes.get(s, []) + (self.states[self.states[s].link].phrases if self.states[s].link > 0 else [])

    def _clone(self, p: int, q: int, w: int) -> int:
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next), {}))
        new = len(states) - 1
        states[q].link = new
        while p >= 0 and states[p].next.get(w) == q:
            states[p].next[w] = new
            p = states[p].link
        return new

    def _grow(self, last: int, w: int) -> int:
        states = self.states
        q = states[last].next.get(w)
        if q is not None:
            return q if states[q].length == states[last].length + 1 else self._clone(last, q, w)
        states.append(State(states[last].length + 1, 0))
        new, p = len(states) - 1, last
        while p >= 0 and w not in states[p].next:
            states[p].next[w] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[w]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, w)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and the number of words matched that end there."""
        states, s, n = self.states, 0, 0
        for w in words:
            to = states[s].next.get(w)
            while to is None and s > 0:
                s = states[s].link
                n = states[s].length
                to = states[s].next.get(w)
            if to is not None:
                s, n = to, n + 1
            yield s, n


class Scanner:
    """Templates and phrases, ready to scan texts' words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.labels = [x for x, _ in templates]
        self.phrase_labels = list(phrases.values())
        split = [t.split() for _, t in templates], [p.split() for p in phrases]
        vocabulary = sorted({w for part in split for words in part for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.size = [len(t) for t in split[0]]
        #: Shorter stretches of known words can hold neither a phrase nor a run.
        self.least = min([LEAST_RUN, *(len(p) for p in split[1] if p)])
        self.automaton = Automaton(*([[number[w] for w in words] for words in part] for part in split))
        data, offs = buffers(pa.array(vocabulary))
        own = span_hashes(data, offs[:-1], offs[1:])
        order = np.argsort(own)
        self.hashes, self.numbers = own[order], order
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.table, self.lower = word_table(), ascii_lower()

    def scan(self, col: pa.Array) -> list[dict]:
        """For each text: n_words, base (starts and phrases), matches (start, words, template, its end in the template)."""
        data, offs = buffers(col)
        data = self.lower[data]
        starts, ends, first = spans(self.table[data], offs)
        out = [{"n_words": int(n), "base": [], "runs": []} for n in np.diff(first)]
        if not len(starts):
            return out
        h = span_hashes(data, starts, ends)
        at = np.flatnonzero(self.coarse[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        known = self.hashes[place] == h[at]
        at, number = at[known], self.numbers[place[known]]
        row = np.searchsorted(first, at, side="right") - 1
        joins = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])
        edges = np.flatnonzero(np.concatenate([[True], ~joins, [True]])) if len(at) else np.zeros(0, np.int64)
        states, sizes = self.automaton.states, self.automaton.phrase_words
        number = number.tolist()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < self.least:
                continue
            r, from_word = int(row[a]), int(at[a] - first[row[a]])
            mine, before = out[r], (0, 0)
            for k, (s, n) in enumerate(self.automaton.stream(number[a:b])):
                if states[s].phrases:
                    mine["base"] += [(from_word + k + 1 - sizes[p], p) for p in states[s].phrases if n >= sizes[p]]
                if n <= before[1] and before[1] >= LEAST_RUN:
                    mine["runs"].append((from_word + k - before[1], *reversed(before)))
                before = s, n
            if before[1] >= LEAST_RUN:
                mine["runs"].append((from_word + b - a - before[1], *reversed(before)))
        return out

    def spans_of(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of runs (start, words, state): label, first word, end, covered share; the best chain of each template
        at each place."""
        open_: dict[int, list] = {}
        done: list[tuple] = []

        def close(t: int) -> None:
            start, end, _, words = open_.pop(t)
            if words >= LEAST_WORDS and words >= LEAST_SHARE * self.size[t]:
                done.append((self.labels[t], start, end, min(1.0, words / self.size[t])))

        for start, words, state in runs:
            for t, last in self.automaton.states[state].ends.items():
                here = last - words + 1
                if (c := open_.get(t)) is not None:
                    _, end, upto, have = c
                    if here > upto - words and last > upto and start - end <= max(words, have):
                        new = min(words, last - upto, start + words - end) if start < end or here <= upto else words
                        open_[t] = [c[0], start + words, last, have + new]
                        continue
                    if have >= words and start - end <= have and last <= upto:
                        continue  # a repetition inside the template
                    close(t)
                open_[t] = [start, start + words, last, words]
        for t in list(open_):
            close(t)
        return sorted(set(done), key=lambda x: (x[1], x[0]))


def best(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Without spans that lie within one of another label that covers a larger share of its template: licences that differ
    in a few words. A sweep that keeps the spans which have not ended, at most some for each template."""
    out, active = [], []
    for x in sorted(spans, key=lambda x: (x[1], -x[2], -x[3], x[0])):
        active = [y for y in active if y[2] > x[1]]
        if not any(y[2] >= x[2] and y[3] > x[3] and y[0] != x[0] for y in active):
            out.append(x)
        active.append(x)
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text: ``n_words``, ``phrases`` (word at which each place starts, label) and ``spans`` (label, first word,
    end word, covered share of the template; see ``best``).

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of all other non-ASCII characters. Null texts count
    as empty: no words, no spans. Rows are kept as they are, repeated or with null ids; other columns are not read. No
    shuffle; the templates are a parameter and bounded.
    """
    key = ("licences", tuple(templates), tuple(phrases.items()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = cached(key, lambda: Scanner(templates, phrases))
        found = scanner.scan(pc.fill_null(batch.column(1), ""))
        cols = [
            batch.column(0),
            pa.array([x["n_words"] for x in found], pa.int64()),
            pa.array([[{"word": w, "label": scanner.phrase_labels[p]} for w, p in sorted(x["base"])] for x in found], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
            pa.array([[dict(zip(("label", "word", "end", "share"), s, strict=True)) for s in best(scanner.spans_of(x["runs"]))] for x in found], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "phrases", "spans"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return over_batches(d, run, "id long, n_words long, phrases array<struct<word:long,label:string>>, spans array<struct<label:string,word:long,end:long,share:double>>", 1 << 20).withColumnRenamed("id", id_col)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("phrases.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
