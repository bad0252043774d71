"""Licence scan: a generalised suffix automaton of licence tokens gives matching statistics; long matches are chained.

The automaton holds the token sequences of all templates (bounded: it is built from the template parameter alone). Each
text is streamed through it once: at every word the length of the longest suffix read so far that occurs in some
template, and where. Matches of at least ``MIN_MATCH`` words are chained per template when they move forward in both
text and template with small gaps (a passage that a template repeats may stand for any of its places); a chain covering enough of the template is a licence span. Short labelled phrases
are strings of the same automaton and are found at every place through the suffix links.
"""
from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame

from mailwarden.llm.common import map_texts
from mailwarden.llm.words import LOWER, hash_texts

#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening or operative passages of well-known public licences (fixed values).
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
           "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
           "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
           "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
           "other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                  "or (at your option) any later version. This program is distributed in the hope that it will be "
                  "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
                  "A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
               "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-mention": "Released under the MIT License.",
    "apache-mention": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-mention": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-mention": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 20, 0.6
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label: string, start: long, end: long, cover: double>>")
#: Bytes between words, after lower-casing A-Z.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class SuffixAutomaton:
    """Generalised suffix automaton over integer tokens; each state keeps all ends of its strings per template."""

    def __init__(self):
        self.next, self.link, self.size, self.ends = [{}], [-1], [0], [{}]

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.size.append(size)
        self.ends.append({})
        return len(self.next) - 1

    def _clone(self, p: int, q: int, token: int) -> int:
        c = self._state(self.size[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        return c

    def add(self, tokens: list[int], name: str) -> None:
        last = 0
        for place, token in enumerate(tokens):
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, q, token)
            else:
                cur, p = self._state(self.size[last] + 1), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = cur
                    p = self.link[p]
                if p < 0:
                    self.link[cur] = 0
                else:
                    q = self.next[p][token]
                    self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, token)
                last = cur
            self.ends[last].setdefault(name, set()).add(place + 1)

    def finish(self) -> None:
        """Hand the ends of long strings down to their suffixes."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            up = self.ends[self.link[s]]
            for name, ends in self.ends[s].items():
                up.setdefault(name, set()).update(ends)
        self.ends = [{name: sorted(ends) for name, ends in own.items()} for own in self.ends]

    def statistics(self, tokens, start: int = 0):
        """(place, state, length) of the longest match ending at each token."""
        s, length, nxt, link, size = 0, 0, self.next, self.link, self.size
        for i, token in enumerate(tokens, start):
            while s and token not in nxt[s]:
                s = link[s]
                length = size[s]
            t = nxt[s].get(token)
            if t is None:
                s = length = 0
            else:
                s, length = t, length + 1
            yield i, s, length


class LicenseModel:
    """Automaton, vocabulary and phrase table for a set of templates and labelled phrases."""

    def __init__(self, templates=None, phrases=None, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        names = [*templates, *phrases]
        raw = [(templates.get(n) or n).encode().translate(LOWER) for n in names]
        h, ptr = hash_texts(raw, GAP)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h)
        self.automaton = SuffixAutomaton()
        self.length = {}
        for k, name in enumerate(names):
            tokens = ids[ptr[k]:ptr[k + 1]].tolist()
            self.automaton.add(tokens, name)
            if name in templates:
                self.length[name] = len(tokens)
        self.automaton.finish()
        at = {}
        for k, name in enumerate(names):
            if name in phrases:
                tokens, state = ids[ptr[k]:ptr[k + 1]].tolist(), 0
                for t in tokens:
                    state = self.automaton.next[state][t]
                at[state] = (phrases[name], len(tokens))
        self.shortest = min([n for _, n in at.values()] + [min_match])
        #: per state: the phrases that end here, through the suffix links
        self.phrases = []
        for s in range(len(self.automaton.next)):
            found, p = [], s
            while p > 0:
                if p in at:
                    found.append(at[p])
                p = self.automaton.link[p]
            self.phrases.append(found)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 for words of no template."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def scan(self, tokens: np.ndarray):
        """(phrase places [(start, label)], maximal matches [(start, end, state)]) of one text."""
        places, matches = [], []
        known = np.flatnonzero(np.diff(np.concatenate(([False], tokens >= 0, [False])).astype(np.int8)))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.shortest:
                continue
            last = None
            for i, s, n in self.automaton.statistics(tokens[a:b].tolist(), a):
                for label, size in self.phrases[s]:
                    if size <= n:
                        places.append((i + 1 - size, label))
                if last and n <= last[2]:
                    matches.append((last[0] + 1 - last[2], last[0] + 1, last[1]))
                last = (i, s, n) if n >= self.min_match else None
            if last:
                matches.append((last[0] + 1 - last[2], last[0] + 1, last[1]))
        return places, matches

    def chain(self, matches) -> list[tuple]:
        """Covered template spans (label, start, end, cover): matches that go forward in text and template."""
        per, spans = {}, []
        for start, end, state in matches:
            for name, ends in self.automaton.ends[state].items():
                if name in self.length:
                    per.setdefault(name, []).append((start, end, ends))
        for name, found in per.items():
            spans += [(name, *x) for x in self._spans(found, self.length[name])]
        return sorted(spans, key=lambda x: (x[1], x[0]))

    def _spans(self, found, length: int) -> list[tuple[int, int, float]]:
        """Spans of one template. A match may stand for every place of its words in the template; each place continues the
        chain that covers most with it, or starts one. Of the chains that overlap in the text the best stays."""
        live, ended = [], []                             # [start, end, template end, words covered, continued]
        for start, end, ends in found:
            ended += [c for c in live if start - c[1] > self.max_gap and not c[4]]
            live = [c for c in live if start - c[1] <= self.max_gap]
            more = []
            for at in ends:
                begins, before, covered = at - (end - start), None, end - start
                for c in live:
                    if at > c[2] and begins - c[2] <= self.max_gap:
                        both = c[3] + max(0, end - start - max(0, c[1] - start, c[2] - begins))
                        if both > covered or (before and both == covered):
                            before, covered = c, both
                if before:
                    before[4] = True
                more.append([before[0] if before else start, end, at, covered, False])
            live += more
        ended += [c for c in live if not c[4]]
        kept: list[tuple[int, int, float]] = []          # by start, without overlap
        for start, end, _, covered, _ in sorted(ended, key=lambda c: (-c[3], c[0], c[2])):
            if covered / length < self.min_cover:
                break
            place = bisect.bisect(kept, (start, end, math.inf))
            if (place == 0 or kept[place - 1][1] <= start) and (place == len(kept) or end <= kept[place][0]):
                kept.insert(place, (start, end, min(1.0, covered / length)))
        return kept


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per row of ``df``, without a shuffle.

    ``score`` is the best template cover, or 0.5 where only phrases are found. A null or empty text has no words: counts
    0, places null, labels empty. Null ids and repeated rows are scanned like any other; other columns are not read.
    """
    model = model or LicenseModel()

    def work(rows):
        hashes, ptr = hash_texts([(t or b"").translate(LOWER) for _, t in rows], GAP)
        tokens, out = model.tokens(hashes), []
        for i, (key, _) in enumerate(rows):
            places, matches = model.scan(tokens[ptr[i]:ptr[i + 1]])
            spans = model.chain(matches)
            base = {label for _, label in places}
            starts = [p for p, _ in places]
            score = max([s[3] for s in spans] + [0.5 if places else 0.0])
            out.append((key, int(ptr[i + 1] - ptr[i]), len(places), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score,
                        [{"label": s[0], "start": s[1], "end": s[2], "cover": s[3]} for s in spans]))
        return out

    return map_texts(df, [df[id_col].alias("doc_id"), df[text_col].alias("text")], SCHEMA, work)
