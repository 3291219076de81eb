"""License scans (operator 5): a generalised suffix automaton over the words of licence templates.

The automaton of all templates is built once and broadcast; its size is that of the templates. A document's words
stream through it and give, at every word, the longest template factor that ends there. Matches that cannot be
extended and are long enough are chained in template order, and a template that its chain covers well enough is a
label, with the spans it covers.

Cases: a null or empty text has no words and no label, and the score 0; places of a phrase may overlap others and
all count; a template that occurs twice in a text is one label; of chains that cover as much the one that ends first
stands; a very long text is one value in one task, in proportion to its words; repeated rows are scanned each; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public licence wording by SPDX identifier; what follows a # tells several texts of a licence apart.
TEMPLATES = {
    "MIT#notice": "Released under the MIT License.",
    "Apache-2.0#notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only#notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0#notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0#notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0#notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0#long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT#grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause#clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0#header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-or-later#header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-or-later#header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later#header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0#header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following.",
}
#: Words of the shortest match that is chained, and the covered share of a template that makes it a label.
LEAST_MATCH, COVERED = 3, 0.7
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class SuffixAutomaton:
    """Generalised over several word sequences; each state knows one place (template, end) of its factors."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another template put this factor in before
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        now = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return now

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def place(self, template: int, words: list[int]) -> None:
        """Notes where each prefix ends, at its state and at all its suffixes' states; once all templates are in."""
        at = 0
        for end, word in enumerate(words, 1):
            at = self.next[at][word]
            s = at
            while s > 0:
                self.places[s].setdefault(template, []).append(end)
                s = self.link[s]

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest factor that ends at each word."""
        out, at, n = [], 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.next[at]:
                at, n = self.next[at][word], n + 1
            else:
                n = 0
            out.append((n, at))
        return out


class LicenseScanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: int = LEAST_MATCH, covered: float = COVERED):
        self.labels, self.least, self.covered = [k.split("#")[0] for k in templates], least, covered
        texts = [words_of(t) for t in templates.values()]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t} | {w for p in PHRASES for w in words_of(p)}))}
        ids = [[self.vocabulary[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in ids]
        self.automaton = SuffixAutomaton()
        for i, t in enumerate(ids):
            self.automaton.add(i, t)
        for i, t in enumerate(ids):
            self.automaton.place(i, t)
        self.phrases = [(np.array([self.vocabulary[w] for w in words_of(p)]), label) for p, label in PHRASES.items()]

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, place in the template, place in the text, length) of the matches that can't be extended."""
        out = []
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return out
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            if len(run) < self.least:
                continue
            stats = self.automaton.statistics(ids[run].tolist())
            for k, (n, state) in enumerate(stats):
                if n >= self.least and (k + 1 == len(stats) or stats[k + 1][0] != n + 1):
                    for template, ends in self.automaton.places[state].items():
                        out += [(template, e - n, int(run[0]) + k + 1 - n, n) for e in ends]
        return out

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
        """By template: words covered by the best chain that runs forward in the text and the template, and its spans
        in the text. A chain stays within a window of the text of twice the template's length."""
        out = {}
        for template in {m[0] for m in matches}:
            own = sorted({m[1:] for m in matches if m[0] == template}, key=lambda m: (m[1], m[0]))
            best = [(n, -1, at) for _, at, n in own]
            reach = 2 * self.sizes[template]
            low = 0
            for j, (tj, aj, nj) in enumerate(own):
                while own[low][1] < aj - reach:
                    low += 1
                for i in range(low, j):
                    ti, ai, ni = own[i]
                    cut = max(0, ti + ni - tj, ai + ni - aj)
                    if ti < tj and ai < aj and cut < nj and aj + nj - best[i][2] <= reach and best[i][0] + nj - cut > best[j][0]:
                        best[j] = (best[i][0] + nj - cut, i, best[i][2])
            j = max(range(len(own)), key=lambda k: (best[k][0], -k))
            total, spans = best[j][0], []
            while j >= 0:
                spans.append((own[j][1], own[j][1] + own[j][2]))
                j = best[j][1]
            out[template] = (total, spans[::-1])
        return out

    def settled(self, hit: list[int], shares: dict[int, float], chains: dict[int, tuple[int, list[tuple[int, int]]]]) -> list[int]:
        """The templates that explain their place best: one goes where templates of other labels, covered better (then by
        more words, then earlier in the list), hold half of its spans or more. Licences that differ in a name or number
        cover each other's wording."""
        kept: list[int] = []
        for t in sorted(hit, key=lambda t: (-shares[t], -chains[t][0], t)):
            spans = chains[t][1]
            others = [s for k in kept if self.labels[k] != self.labels[t] for s in chains[k][1]]
            shared = sum(any(a <= w < b for a, b in others) for x, y in spans for w in range(x, y))
            if 2 * shared < sum(y - x for x, y in spans):
                kept.append(t)
        return kept

    def scan(self, text: str) -> dict:
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        places, base = [], set()
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                at = np.flatnonzero(ids[:n] == phrase[0])
                for k in range(1, len(phrase)):
                    at = at[ids[at + k] == phrase[k]]
                if len(at):
                    base.add(label)
                    places += [(int(a), int(a) + len(phrase)) for a in at]
        chains = self.chains(self.matches(ids))
        shares = {t: min(1.0, c / self.sizes[t]) for t, (c, _) in chains.items()}
        hit = self.settled([t for t, s in shares.items() if s >= self.covered], shares, chains)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min((a for a, _ in places), default=None), "last_word": max((a for a, _ in places), default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {self.labels[t] for t in hit})), "score": float(max(shares.values(), default=0.0)),
            "spans": [{"label": self.labels[t], "first": a, "last": b} for t in sorted(hit) for a, b in chains[t][1]],
        }


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: int = LEAST_MATCH, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (covered template words)."""
    shared = docs.sparkSession.sparkContext.broadcast(LicenseScanner(templates, least, covered))
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,last:int>>"

    def make():
        scanner = shared.value

        def each(ids, texts):
            found = [scanner.scan(t) for t in texts]
            return {"doc_id": ids} | {c.split(" ")[0]: [f[c.split(" ")[0]] for f in found] for c in columns.split(", ")}

        return each

    return map_texts(docs, make, f"doc_id long, {columns}")
