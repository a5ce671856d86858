"""License scans by template markup.

A template is a license's wording with markup: `<<optional>> ... <<end>>` may be missing, `<<any N>>`
stands for up to N words of any kind, `<<one of: a | b c>>` for one of some wordings. It is compiled to an automaton over word hashes; a text is accepted
from a word on if every mandatory word follows in its place, exactly. Automata start only where a
template's leading words (up to two, before its first markup) stand, which numpy finds for all texts at
once. Phrases of the base list are found the same way.

Defined results: a null or empty text has no words, no labels and score 0. Overlapping places all count.
Rows are independent, whatever their doc_id (null, repeated), and keep their number. A text of any length is
turned into arrays as a whole (some 20 times its bytes). An empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM_LOWER, on_workers, pieces, raw, tidy, words_of

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License wordings and notices as published, with markup for what may be missing or differ.
_GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU <<any 2>> General Public License for more details."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<optional>> 1. <<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<optional>> 2. <<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY <<any 8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_CC_WORK = "This work is licensed under <<any 2>> Creative Commons"
_CC_SA, _CC_ND, _CC_NC = "<<one of: ShareAlike | Share Alike>>", "<<one of: NoDerivatives | NoDerivs | No Derivatives>>", "<<one of: NonCommercial | Non Commercial>>"
_CC_LICENSE = "<<optional>> <<one of: 4 0 | 3 0 | 2 0>> <<end>> <<one of: International | Unported | Generic>> <<optional>> Public <<end>> License"
TEMPLATES = {
    "mit-notice": "released under <<optional>> the terms of <<end>> the MIT License",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice <<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software. "
        f"{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<any 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, '
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0": (
        'licensed under the Apache License, Version 2.0 <<optional>> (the "License"); you may not use <<any 4>> except in compliance with the License. You may obtain a copy of the License at <<any 8>> '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License. <<end>>"
    ),
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": (
        f"{_BSD_CONDITIONS} <<optional>> 3. <<end>> Neither the name of <<any 8>> nor the names of <<any 4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"
    ),
    "gpl-2.0": "licensed under the GNU General Public License <<optional>> as published by the Free Software Foundation <<end>> <<optional>> either <<end>> <<one of: version 2 | v2 | v 2>> <<optional>> 0 <<end>>",
    "gpl-3.0": "licensed under the GNU General Public License <<optional>> as published by the Free Software Foundation <<end>> <<optional>> either <<end>> <<one of: version 3 | v3 | v 3>> <<optional>> 0 <<end>>",
    "gpl-notice": (
        "This program is free software<<optional>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        f"either version <<any 2>> of the License, or <<optional>> (at your option) <<end>> any later version. {_GNU_WARRANTY}"
    ),
    "lgpl-notice": (
        "This <<any 2>> is free software; you can redistribute it and/or modify it under the terms of the GNU <<one of: Lesser | Library>> General Public License as published by the Free Software Foundation; "
        "either version <<any 2>> of the License, or (at your option) any later version. This <<any 2>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        f"either version <<any 2>> of the License, or (at your option) any later version. {_GNU_WARRANTY}"
    ),
    "cc-by-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY 4.0",
    "cc-by-sa-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY-SA 4.0",
    "cc-by-nc-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY-NC 4.0",
    "cc-by-nc-sa-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY-NC-SA 4.0",
    "cc-by-nd-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY-ND 4.0",
    "cc-by-nc-nd-4.0": "licensed under <<optional>> a Creative Commons <<end>> <<optional>> the <<end>> CC BY-NC-ND 4.0",
    "cc-by-notice": f"{_CC_WORK} Attribution {_CC_LICENSE}",
    "cc-by-sa-notice": f"{_CC_WORK} Attribution {_CC_SA} {_CC_LICENSE}",
    "cc-by-nd-notice": f"{_CC_WORK} Attribution {_CC_ND} {_CC_LICENSE}",
    "cc-by-nc-notice": f"{_CC_WORK} Attribution {_CC_NC} {_CC_LICENSE}",
    "cc-by-nc-sa-notice": f"{_CC_WORK} Attribution {_CC_NC} {_CC_SA} {_CC_LICENSE}",
    "cc-by-nc-nd-notice": f"{_CC_WORK} Attribution {_CC_NC} {_CC_ND} {_CC_LICENSE}",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<any 8>>",
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "<<optional>> 1. <<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "<<optional>> 2. <<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<optional>> 3. <<end>> This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "copyright-reserved": "Copyright <<any 16>> All rights reserved",
}
_MARKUP = re.compile(r"<<(optional|end|any \d+|one of:[^>]*)>>")


def small_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text))


def choices(token: str) -> list[list[str]]:
    """The wordings that a `one of` token names."""
    return [small_words(x) for x in token.removeprefix("<<one of:").removesuffix(">>").split("|")]


def plain(markup: str) -> list[str]:
    """A template's words, in small letters, and its markup, as a list."""
    out, at = [], 0
    for m in [*_MARKUP.finditer(markup), None]:
        text = markup[at : m.start() if m else len(markup)]
        out += small_words(text)
        if m:
            out.append(m[0])
            at = m.end()
    return out


def hash_words(words: list[str]) -> np.ndarray:
    return words_of(*raw(pa.array([" ".join(words)], pa.large_string())), ALNUM_LOWER).hashes()


@dataclass
class Automaton:
    """States 0..n; edges by word hash, edges for any word, and the states that are reached without a word."""

    by_word: list[dict[int, int]]
    any_word: list[int | None]
    closed: list[frozenset[int]]
    depth: list[int]
    start: list[int]
    mandatory: int

    def run(self, words: list[int]) -> tuple[bool, float]:
        """(accepted, largest share of mandatory words in place) from the first word on."""
        last, now, best = len(self.by_word) - 1, self.closed[0], 0
        if last in now:
            return True, 1.0
        for word in words:
            after: set[int] = set()
            for state in now:
                to = self.by_word[state].get(word)
                if to is not None:
                    after |= self.closed[to]
                if self.any_word[state] is not None:
                    after |= self.closed[self.any_word[state]]
            if not after:
                break
            if last in after:
                return True, 1.0
            now, best = after, max(best, max(self.depth[s] for s in after))
        return False, best / self.mandatory


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; start has its first two words, fewer where markup begins before (none: it may start anywhere)."""
    by_word: list[dict[int, int]] = [{}]
    any_word: list[int | None] = [None]
    skips: list[list[int]] = [[]]
    depth, start, open_at = [0], [], []
    count, tokens = 0, plain(markup)

    def state() -> int:
        by_word.append({})
        any_word.append(None)
        skips.append([])
        depth.append(count)
        return len(by_word) - 1

    at = 0
    leading = True  # no markup so far
    for token in tokens:
        leading = leading and not token.startswith("<<")
        if token == "<<optional>>":
            open_at.append((at, count))
        elif token == "<<end>>":
            begin, count = open_at.pop()
            to = state()
            skips[at].append(to)
            skips[begin].append(to)
            at = to
        elif token.startswith("<<one of"):
            begin, ends, held = at, [], choices(token)
            for wording in held:
                at = begin
                for word in wording:
                    # wordings that begin alike share their states, as one word leads to one state
                    known = by_word[at].get(int(hash_words([word])[0]))
                    to = state() if known is None else known
                    by_word[at][int(hash_words([word])[0])] = to
                    at = to
                ends.append(at)
            if not open_at:
                count += min(map(len, held))
            at = state()
            for x in ends:
                skips[x].append(at)
        elif token.startswith("<<any"):
            begins = [at]
            for _ in range(int(token[6:-2])):
                to = state()
                any_word[at] = to
                at = to
                begins.append(at)
            to = state()
            for x in begins:
                skips[x].append(to)
            at = to
        else:
            word = int(hash_words([token])[0])
            if not open_at:
                count += 1
            if leading and len(start) < 2:
                start.append(word)
            to = state()
            by_word[at][word] = to
            at = to
    closed = []
    for k in range(len(by_word)):
        seen, todo = {k}, [k]
        while todo:
            for to in skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        closed.append(frozenset(seen))
    return Automaton(by_word, any_word, closed, depth, start, max(1, count))


def _longest(automaton: Automaton) -> int:
    return len(automaton.by_word)


def _places(hashes: np.ndarray, room: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted words stand one after the other, within one text."""
    if not len(wanted):
        return np.arange(len(hashes))
    at = np.flatnonzero((hashes == wanted[0]) & (room >= len(wanted)))
    for k in range(1, len(wanted)):
        at = at[hashes[at + k] == wanted[k]]
    return at


@tidy
def _scan(templates: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(hash_words(p.split()), label) for p, label in PHRASES.items()]
    automata = [(label, compile_template(x)) for label, x in templates.items()]
    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = words_of(data, offsets, ALNUM_LOWER)
            hashes, first, n = words.hashes(), words.first, part.num_rows
            owner = words.owner()
            room = first[owner + 1] - np.arange(len(hashes))
            n_base, low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base: list[set[str]] = [set() for _ in range(n)]
            for wanted, label in phrases:
                at = _places(hashes, room, wanted)
                docs = owner[at]
                n_base += np.bincount(docs, minlength=n)
                for d, place in zip(docs.tolist(), (at - first[docs]).tolist(), strict=True):
                    low[d] = place if low[d] < 0 else min(low[d], place)
                    high[d] = max(high[d], place)
                    base[d].add(label)
            found: list[set[str]] = [set() for _ in range(n)]
            score = np.where(n_base > 0, 0.5, 0.0)
            matches: list[list[dict]] = [[] for _ in range(n)]
            for label, automaton in automata:
                at = _places(hashes, room, np.array(automaton.start, np.uint64))
                for place in at.tolist():
                    d = int(owner[place])
                    accepted, share = automaton.run(hashes[place : min(place + _longest(automaton), first[d + 1])].tolist())
                    if accepted:
                        found[d].add(label)
                        matches[d].append({"label": label, "word": int(place - first[d])})
                    score[d] = max(score[d], share)
            missing = low < 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(n_base),
                    pa.array(low, pa.int64(), mask=missing),
                    pa.array(high, pa.int64(), mask=missing),
                    pa.array([",".join(sorted(x)) for x in base]),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)]),
                    pa.array(score),
                    pa.array([sorted(x, key=lambda m: (m["word"], m["label"])) for x in matches], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1: a template accepts; else the largest share of its mandatory words in place, 0.5 at least with a base phrase) and matches (template and word)."""
    on_workers(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long>>"
    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(lambda b: _scan(templates, b), schema)
