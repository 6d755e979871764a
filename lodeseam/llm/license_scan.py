"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence tokens.

1. The automaton holds every run of words of all templates (licence notices) and
   phrases.  It is built once on the driver, from a few thousand words (bounded by
   ``MOST_WORDS``), and sent to the tasks.
2. A text is streamed through it: after each word, the state and the length of
   the longest run of words that ends there and occurs in a template.  Words of no
   template reset it, so that only the stretches between them are walked, all stretches of
   a batch in step; a long stretch is cut, and each part warmed up with as many words as the
   longest template has, which is as far as any match reaches back.
3. A phrase stands where its state is the reached one or a suffix of it.  The words that a
   template shares with the text are grouped by diagonal (place in the template less
   place in the text): what follows one another on a diagonal is one maximal match.
4. Maximal matches of at least ``LEAST`` words are chained per template: in order in the text
   and in the template, with at most ``GAP`` other words between.  A chain that covers at
   least ``SHARE`` of its template is a span; a span inside one that shares more goes.

One pass over the documents, without a shuffle: no source, phrase or group of copies can be
hot, and nothing is kept but one batch of about 2 MB.

Odd input: null or blank texts have no words; null doc_ids stay; rows that repeat a
doc_id are each scanned; very long texts are scanned whole; an empty table gives no
rows; other columns are not looked at.  Templates or phrases without words match nothing;
equal templates of different labels give both labels.  Words are compared as 64-bit identities.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, ranges, slices, table

LEAST, GAP, SHARE = 3, 12, 0.8
#: Bound on the words of all templates together.
MOST_WORDS = 1 << 18
#: Words of a stretch that are walked one after another.
_PART = 4096

#: Phrases and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Labels and the wording of common licence declarations and notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


class Automaton:
    """States of all runs of words of some token sequences, with matching statistics over batches."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.size, self.link, self.next = [0], [-1], [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        self.whole = []  # the state of each sequence
        for number, tokens in enumerate(sequences):
            state = 0
            for i, c in enumerate(tokens):
                state = self._extend(state, c)
                while len(ends) < len(self.size):
                    ends.append([])
                ends[state].append((number, i))
            self.whole.append(state)
        by_size = sorted(range(len(self.size)), key=lambda s: -self.size[s])
        for s in by_size:  # where a run ends, its suffixes end
            if self.link[s] > 0:
                ends[self.link[s]] += ends[s]
        self.ends = ends
        self.width = 1 + max((c for t in sequences for c in t), default=0)
        edges = sorted((s * self.width + c, t) for s, row in enumerate(self.next) for c, t in row.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.full(1, -1), np.zeros(1, np.int64))
        self.link, self.size = np.array(self.link), np.array(self.size)

    def _copy(self, state: int, size: int) -> int:
        self.size.append(size)
        self.link.append(self.link[state])
        self.next.append(dict(self.next[state]))
        return len(self.size) - 1

    def _split(self, state: int, c: int, to: int) -> int:
        """The state of the runs of ``to`` that are one word longer than those of ``state``."""
        if self.size[to] == self.size[state] + 1:
            return to
        copy = self._copy(to, self.size[state] + 1)
        self.link[to] = copy
        while state >= 0 and self.next[state].get(c) == to:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # known from an earlier sequence
            return self._split(last, c, self.next[last][c])
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        self.next.append({})
        new, state = len(self.size) - 1, last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, c, self.next[state][c])
        return new

    def step(self, state: np.ndarray, length: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states and lengths after one more token each."""
        state, length, open_ = state.copy(), length.copy(), np.arange(len(state))
        while len(open_):
            key = state[open_] * self.width + token[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[open_[known]] = self.to[at[known]]
            length[open_[known]] += 1
            open_ = open_[~known]
            lost = state[open_] == 0
            length[open_[lost]] = 0
            open_ = open_[~lost]
            state[open_] = self.link[state[open_]]
            length[open_] = self.size[state[open_]]
        return state, length

    def statistics(self, token: np.ndarray, first: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """State and length at every token; stretch i holds tokens first[i] to first[i + 1], and no match is longer than ``reach``."""
        counts = np.diff(first)
        parts = -(-counts // _PART)
        nth = ranges(np.zeros(len(parts), np.int64), parts)
        begin = np.repeat(first[:-1], parts) + nth * _PART
        stop = np.minimum(begin + _PART, np.repeat(first[1:], parts))
        warm = np.maximum(begin - reach, np.repeat(first[:-1], parts))
        states, lengths = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
        state = length = np.zeros(len(begin), np.int64)
        live, at = np.arange(len(begin)), warm.copy()
        while len(live):
            state, length = self.step(state, length, token[at])
            own = at >= begin[live]
            states[at[own]], lengths[at[own]] = state[own], length[own]
            at = at + 1
            more = at < stop[live]
            live, at, state, length = live[more], at[more], state[more], length[more]
        return states, lengths


class Scanner:
    """Templates and phrases, numbered words, and their automaton."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int, gap: int, share: float) -> None:
        self.labels, self.phrase_labels = [a for a, _ in templates], [a for a, _ in phrases]
        w = Words(pa.array([t for _, t in templates + phrases], pa.string()), ALNUM, lower=True)
        if len(w.start) > MOST_WORDS:
            raise ValueError(f"templates hold {len(w.start)} words, more than {MOST_WORDS}")
        self.vocabulary, token = np.unique(w.ids(), return_inverse=True)
        sequences = [token[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.words, n = np.array([len(s) for s in sequences[: len(templates)]], np.int64), len(templates)
        self.least, self.gap, self.share = least, gap, share
        self.reach = max(map(len, sequences), default=0)
        self.automaton = a = Automaton(sequences)
        # per state: phrases that end there (number, words), and places (template, word) with how much of a longer match they share
        held: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(sequences[n:]):
            if s:
                held.setdefault(a.whole[n + i], []).append((i, len(s)))
        phrase, place = [], []
        for s in range(len(a.size)):
            up, seen, own, ends = s, set(), [], []
            while up > 0:
                own += held.get(up, [])
                if a.size[up] >= least:
                    for t, p in a.ends[up]:
                        if t < n and (t, p) not in seen:
                            seen.add((t, p))
                            ends.append((t, p, a.size[up] if up != s else self.reach))
                up = a.link[up]
            phrase.append(own)
            place.append(ends)
        self.phrase, self.phrase_at = self._flat(phrase, 2)
        self.place, self.place_at = self._flat(place, 3)

    @staticmethod
    def _flat(rows: list[list[tuple]], width: int) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x for r in rows for x in r], np.int64).reshape(-1, width), np.cumsum([0, *map(len, rows)])

    def matches(self, words: Words) -> tuple[tuple, tuple]:
        """((first word, phrase) of each phrase's places, (text, template, word, word of the template, words) of each maximal match)."""
        ids = words.ids()
        token = np.searchsorted(self.vocabulary, ids)
        known = np.flatnonzero(self.vocabulary[np.minimum(token, len(self.vocabulary) - 1)] == ids) if len(self.vocabulary) else np.zeros(0, np.int64)
        new = np.append(True, (np.diff(known) != 1) | (np.diff(words.doc[known]) != 0))[: len(known)]
        states, lengths = self.automaton.statistics(token[known], np.append(np.flatnonzero(new), len(known)), self.reach)

        def spread(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = at[states + 1] - at[states]
            return np.repeat(np.arange(len(states)), counts), flat[ranges(at[states], counts)]

        i, found = spread(self.phrase, self.phrase_at)
        whole = found[:, 1] <= lengths[i]
        phrases = (known[i[whole]] - found[whole, 1] + 1, found[whole, 0])
        i, found = spread(self.place, self.place_at)
        size = np.minimum(found[:, 2], lengths[i])
        enough = size >= self.least
        end, size, template, place = known[i[enough]], size[enough], found[enough, 0], found[enough, 1]
        order = np.lexsort((end, end - place, template))
        end, size, template, place = (x[order] for x in (end, size, template, place))
        goes_on = (template[1:] == template[:-1]) & (np.diff(end) == 1) & (np.diff(place) == 1) & (words.doc[end[1:]] == words.doc[end[:-1]])
        last = np.append(~goes_on, True)[: len(end)]
        end, size, template, place = (x[last] for x in (end, size, template, place))
        return phrases, (words.doc[end], template, end - size + 1, place - size + 1, size)

    def spans(self, matches: tuple) -> list[tuple[int, str, int, int, float]]:
        """(text, label, first word, last word, share) of chains of matches that cover enough of their template."""
        doc, template, at, place, size = matches
        order = np.lexsort((place, at, template, doc))
        doc, template, at, place, size = (x[order] for x in matches)
        if not len(doc):
            return []
        # a cluster: matches of one text and template without a gap too long; pairs are laid end to end, far apart
        apart = np.cumsum(np.append(0, (np.diff(doc) != 0) | (np.diff(template) != 0))) * (int((at + size).max()) + self.gap + 1)
        reached = np.maximum.accumulate(at + size + apart)
        cuts = np.flatnonzero(np.append(True, (at + apart)[1:] - reached[:-1] > self.gap))
        enough = np.add.reduceat(size, cuts) >= self.share * self.words[template[cuts]]
        out = []
        for lo, hi in zip(cuts[enough], np.append(cuts[1:], len(doc))[enough], strict=True):
            t = int(template[lo])
            for a, b, covered in self._chains(at[lo:hi].tolist(), place[lo:hi].tolist(), size[lo:hi].tolist(), int(self.words[t])):
                out.append((int(doc[lo]), self.labels[t], a, b, covered / int(self.words[t])))
        return out

    def _chains(self, at: list[int], place: list[int], size: list[int], words: int) -> Iterator[tuple[int, int, int]]:
        """Disjoint chains (first word, last word, words covered), the best first, that cover enough of a template."""
        best, before, longest = list(size), [-1] * len(at), max(size)
        for j in range(len(at)):
            i = bisect_left(at, at[j] - longest - self.gap, 0, j)
            for i in range(i, j):
                # what overlaps in the text or the template counts once
                over = max(0, at[i] + size[i] - at[j], place[i] + size[i] - place[j])
                if over < size[j] and place[i] < place[j] and at[j] - at[i] - size[i] <= self.gap and best[i] + size[j] - over > best[j]:
                    best[j], before[j] = best[i] + size[j] - over, i
        used = [False] * len(at)
        for j in sorted(range(len(at)), key=lambda k: (-best[k], k)):
            if best[j] < self.share * words:
                break
            chain, i = [], j
            while i >= 0 and not used[i]:
                chain.append(i)
                i = before[i]
            if i < 0:
                for i in chain:
                    used[i] = True
                yield at[chain[-1]], at[j] + size[j] - 1, best[j]


def _outermost(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Spans by first word, without those inside another that shares more of its template (or as much, of the same label)."""
    out, near = [], []
    for s in sorted(spans, key=lambda s: (s[1], -s[2], -s[3], s[0])):
        near = [x for x in near if x[2] >= s[1]]  # the spans that reach this one: few, as templates are
        if not any(x[2] >= s[2] and (x[3] > s[3] or (x[3] == s[3] and x[0] == s[0])) for x in near):
            out.append(s)
            near.append(s)
    return out


_PLACES, _SPANS = "array<struct<word:long,label:string>>", "array<struct<label:string,first:long,last:long,share:double>>"
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, least: int = LEAST, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, phrases (word, label; by word), spans (label, first and last word, share of the template; by first word).

    templates and phrases: (label, wording); a template shorter than ``least`` words has to stand whole.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    sizes = Words(pa.array([t for _, t in templates], pa.string()), ALNUM).counts.tolist()
    short = [(x, n) for x, n in zip(templates, sizes, strict=True) if n < least]
    scanner = Scanner([x for x, n in zip(templates, sizes, strict=True) if n >= least], [*phrases, *(x for x, _ in short)], least, gap, share)
    sent, n_phrases = docs.sparkSession.sparkContext.broadcast(scanner), len(phrases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), ALNUM, lower=True)
                (at, number), matches = known.matches(words)
                first = words.first
                places: list[list] = [[] for _ in range(batch.num_rows)]
                spans: list[list] = [[] for _ in range(batch.num_rows)]
                for k in np.lexsort((number, at)).tolist():
                    d, n = int(words.doc[at[k]]), int(number[k])
                    label, w = known.phrase_labels[n], int(at[k] - first[d])
                    if n < n_phrases:
                        places[d].append({"word": w, "label": label})
                    else:
                        spans[d].append((label, w, w + short[n - n_phrases][1] - 1, 1.0))
                for d, label, a, b, covered in known.spans(matches):
                    spans[d].append((label, int(a - first[d]), int(b - first[d]), covered))
                found = [[dict(zip(("label", "first", "last", "share"), s, strict=True)) for s in _outermost(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(found, pa.list_(_SPAN))], ["doc_id", "n_words", "phrases", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, f"doc_id long, n_words long, phrases {_PLACES}, spans {_SPANS}")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its phrases and labels; the score is 1 with a phrase, else the greatest share of a template in a span."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, added = F.transform("phrases", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    joined = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    share = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)))
    words = F.transform("phrases", lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, added)).alias("labels"), F.least(share, F.lit(1.0)).alias("score"), F.col("spans"),
    )
