"""Licences in texts by matching statistics against a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template; a text streams through it, and at each word the length of the
longest run that ends there and stands in some template is known. Runs that cannot be extended are chained, in the order
of both text and template, into spans; a span that covers enough of a template gives its label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import LOWER, NOT_ALNUM, blocks, longs, words
from .license_texts import TEXTS

#: Phrases and the labels that each of their places gives.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Openings and short notices of public licences, by label; their texts are in license_texts.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)
TEMPLATES = (*NOTICES, *TEXTS)
#: Words of the shortest match that is chained; words between two matches of a chain, in the text and in the template; share of
#: a template to cover.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 3, 6, 0.8


class SuffixAutomaton:
    """Of several sequences of numbers. ``ends[state]``: (sequence, place of its last element) pairs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[tuple[int, int, int]] = []
        for s, sequence in enumerate(sequences):
            last = 0
            for at, x in enumerate(sequence):
                last = self._add(last, x)
                own.append((last, s, at))
        places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for state, s, at in own:  # a run ends wherever a longer run that it closes does
            while state > 0:
                places[state].add((s, at))
                state = self.link[state]
        self.ends = {state: sorted(p) for state, p in places.items()}

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, x: int, to: int) -> int:
        copy = self._new(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(x) == to:
            self.next[state][x] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, x: int) -> int:
        if (to := self.next[last].get(x)) is not None:  # the run stands in an earlier sequence
            return to if self.length[to] == self.length[last] + 1 else self._split(last, x, to)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and x not in self.next[state]:
            self.next[state][x] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][x]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, x, to)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each element."""
        state = length = 0
        for x in sequence:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.next[state]:
                state, length = self.next[state][x], length + 1
            else:
                state = length = 0
            yield length, state


def split(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), NOT_ALNUM, LOWER)[0]


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        hashed = [split(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.vocabulary = np.unique(np.concatenate(hashed))
        self.sizes = [len(h) for h in hashed]
        self.automaton = SuffixAutomaton([np.searchsorted(self.vocabulary, h).tolist() for h in hashed])
        self.phrases = [(label, split(p)) for p, label in phrases]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, -1 for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def shorter(self, length: int, state: int) -> Iterator[tuple[int, int]]:
        """(length, state) of a match and of those that end with it and stand in more templates, down to LEAST_MATCH words."""
        while length >= LEAST_MATCH:
            yield length, state
            state = self.automaton.link[state]
            length = self.automaton.length[state]

    def matches(self, run: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) of the matches of at least LEAST_MATCH words that can't go on in some template, ends exclusive: a
        run that ends in one template may go on in another."""
        seen, out = list(self.automaton.statistics(run)), []
        ends = self.automaton.ends
        following: set[tuple[int, int]] = set()
        for at in range(len(seen) - 1, -1, -1):
            here: set[tuple[int, int]] = set()
            for length, state in self.shorter(*seen[at]):
                if any((t, last + 1) not in following for t, last in ends[state]):
                    out.append((at + 1, length, state))
                here = set(ends[state])  # of the shortest, which has all
            following = here
        return sorted(out)

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(start, end, template, share covered) of the best chains. Matches come in order of their ends."""
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, length, state in matches:
            for template, last in self.automaton.ends[state]:
                by[template].append((end - length, end, last + 1))
        out = []
        for template, found in by.items():
            chains: list[tuple[int, int, int, int]] = []  # start, end, end in the template, words covered
            for start, end, there in found:
                best = (start, end, there, end - start)
                for a, b, t, n in reversed(chains):
                    if b + MOST_GAP < start:  # so do all before it
                        break
                    if b <= start <= b + MOST_GAP and t <= there - (end - start) <= t + MOST_GAP and n + end - start > best[3]:
                        best = (a, end, there, n + end - start)
                chains.append(best)
            good = [(a, b, template, n / self.sizes[template]) for a, b, _, n in chains if n >= LEAST_COVER * self.sizes[template]]
            out += good
        return sorted(out)


@cache
def scanner() -> Scanner:
    return Scanner()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    label = pa.list_(pa.string())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))
    for batch in batches:
        for lo, hi, buf, bounds in blocks(batch.column("text")):
            hashes, _, _, first = words(buf, bounds, NOT_ALNUM, LOWER)
            n = hi - lo
            doc = np.repeat(np.arange(n), np.diff(first))
            count = np.zeros(n, np.int64)
            least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for name, phrase in s.phrases:
                m = len(phrase)
                if len(hashes) < m:
                    continue
                hit = np.flatnonzero(np.all([hashes[j : len(hashes) - m + 1 + j] == phrase[j] for j in range(m)], axis=0))
                hit = hit[doc[hit] == doc[hit + m - 1]]
                where = hit - first[doc[hit]]
                np.add.at(count, doc[hit], 1)
                np.minimum.at(least, doc[hit], where)
                np.maximum.at(most, doc[hit], where)
                for d in np.unique(doc[hit]).tolist():
                    base[d].add(name)
            ids = s.ids(hashes)
            known = ids >= 0
            starts = np.flatnonzero(known & ~np.concatenate([[False], known[:-1] & (doc[:-1] == doc[1:])])) if len(ids) else np.empty(0, int)
            stops = np.flatnonzero(known & ~np.concatenate([known[1:] & (doc[:-1] == doc[1:]), [False]])) + 1 if len(ids) else np.empty(0, int)
            matched: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            long_ = stops - starts >= LEAST_MATCH
            for a, b in zip(starts[long_].tolist(), stops[long_].tolist()):
                d = int(doc[a])
                matched[d] += [(end + a - int(first[d]), length, state) for end, length, state in s.matches(ids[a:b].tolist())]
            spans = [s.spans(matched[d]) if d in matched else [] for d in range(n)]
            score = [max([x[3] for x in spans[d]], default=1.0 if base[d] else 0.0) for d in range(n)]
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, n),
                    longs(np.diff(first)),
                    longs(count),
                    pa.array(least, mask=none),
                    pa.array(most, mask=none),
                    pa.array([sorted(b) for b in base], label),
                    pa.array([[{"start": a, "end": b, "label": s.labels[t], "cover": c} for a, b, t, c in x] for x in spans], span),
                    pa.array([float(min(1.0, x)) for x in score], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "spans", "score"],
            )


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, spans, score) for every row of ``docs``.

    Words are counted from 0 in the lower-cased text (A-Z only). ``base``: labels of the phrases that stand there, ``n_base``
    their places, ``first_word`` and ``last_word`` the smallest and largest start (null without any). ``spans``: stretches
    that cover a template, their label and the share of it. ``score``: the largest share, 1 where there is only a phrase, 0
    without either. Null and empty texts have no words; rows that repeat come out as often; an empty table gives an empty
    result; other columns are not read.
    """
    named = docs.select("doc_id", "text")
    schema = f"doc_id {dict(named.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base array<string>, spans array<struct<start:long,end:long,label:string,cover:double>>, score double"
    return named.mapInArrow(_scan, schema)
