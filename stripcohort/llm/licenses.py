"""License scan: fixed phrases, and templates with optional and replaceable regions run as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A template of fewer mandatory words than these scores less than 1 where it is met.
SCORED_WORDS = 12
#: Fixed phrases (words in sequence) and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Pieces that several license texts share. Their wording.
_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<var:1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-20>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<opt>><<var:1-1>><<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. <<opt>><<var:1-1>><<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: License texts and notices whole, from the first word of the grant to the last of the disclaimer. <<opt>> ... <<end>> may be missing;
#: <<var:A-B>> stands for A to B words of any kind; all other wording is mandatory. Their wording.
TEMPLATES = (
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var:1-6>> and associated documentation files <<opt>>(the
<<var:1-3>>)<<end>>, to deal in the <<var:1-3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the <<var:1-3>>, and to permit persons to whom the <<var:1-3>> is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all
copies or substantial portions of the <<var:1-3>>. THE <<var:1-3>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-12>> BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
<<var:1-3>> OR THE USE OR OTHER DEALINGS IN THE <<var:1-3>>.""",
    ),
    ("bsd-2-text", _BSD + " " + _AS_IS),
    (
        "bsd-3-text",
        _BSD
        + """ <<opt>><<var:1-1>><<end>> Neither the name of <<var:1-20>> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
        + _AS_IS,
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:1-12>> DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<<end>> The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. <<opt>>2.<<end>> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <<opt>>3.<<end>> This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "apache-2-notice",
        """Licensed under the Apache License, Version 2.0 (the <<var:1-3>>); you may not use this file except in compliance with the <<var:1-3>>. You may
obtain a copy of the <<var:1-3>> at <<opt>>http://www.apache.org/licenses/LICENSE-2.0<<end>> <<opt>>https://www.apache.org/licenses/LICENSE-2.0<<end>>
Unless required by applicable law or agreed to in writing, software distributed under the <<var:1-3>> is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the <<var:1-3>> for the specific language governing permissions and
limitations under the <<var:1-3>>.""",
    ),
    (
        "gpl-notice",
        """This <<var:1-3>> is free software<<opt>>: you<<end>><<opt>>; you<<end>> can redistribute it and/or modify it under the terms of the GNU
<<opt>>Lesser<<end>><<opt>>Affero<<end>> General Public License as published by the Free Software Foundation, either version <<var:1-2>> of the
License, or (at your option) any later version. This <<var:1-3>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<opt>>Lesser<<end>><<opt>>Affero<<end>>
General Public License for more details.""",
    ),
    ("mit-notice", "<<opt>>this <<var:1-3>> is <<end>><<opt>>released <<end>><<opt>>licensed <<end>><<opt>>available <<end>>under the <<opt>>terms of the <<end>>MIT License"),
    ("apache-2-short", "licensed under the <<opt>>terms of the <<end>>Apache License, Version 2.0"),
    ("gpl-3-short", "licensed under the GNU General Public License<<opt>> as published by the Free Software Foundation<<end>>, <<opt>>either <<end>>version 3"),
    ("cc-by-nc-4-notice", "licensed under <<opt>>a <<end>><<opt>>the <<end>>CC BY-NC 4.0<<opt>> <<var:1-1>> license<<end>>"),
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lowered; on UTF-8, whose bytes from 0x80 on are word characters like their code points."""
    return WORD.findall(text.encode("utf-8", "replace").lower())


def _bounds(part: str) -> tuple[int, int]:
    """Least and most words of <<var:A-B>>."""
    least, most = part[6:-2].split("-")
    return int(least), int(most)


class Automaton:
    """A template as a token automaton: moves by a word, by any word, and around optional regions without one."""

    def __init__(self, template: str) -> None:
        self.literal: dict[int, tuple[bytes, int]] = {}
        self.any: dict[int, list[int]] = {}
        self.skip: dict[int, list[int]] = {}
        self.mandatory = 0
        state, opened = 0, []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<opt>>":
                opened.append(state)
            elif part == "<<end>>":
                self.skip.setdefault(opened.pop(), []).append(state)
            elif part.startswith("<<var:"):
                least, most = _bounds(part)
                for k in range(most):
                    self.any.setdefault(state + k, []).append(state + k + 1)
                    if k >= least:
                        self.skip.setdefault(state + k, []).append(state + most)
                state += most
            else:
                for word in words_of(part):
                    self.literal[state] = (word, state + 1)
                    self.mandatory += not opened
                    state += 1
        self.last = state
        self.start = self.closure({0: 0})
        self.firsts = {self.literal[s][0] for s in self.start if s in self.literal}
        if any(s in self.any for s in self.start) or self.last in self.start:
            raise ValueError("a template begins with a word that it names")
        # whether a word is inside an optional region, by the state that it leaves
        self.counted = self._mandatory_states(template)

    @staticmethod
    def _mandatory_states(template: str) -> set[int]:
        out, state, depth = set(), 0, 0
        for part in re.split(r"(<<[^>]*>>)", template):
            depth += (part == "<<opt>>") - (part == "<<end>>")
            if part.startswith("<<var:"):
                state += _bounds(part)[1]
            elif not part.startswith("<<"):
                for _ in words_of(part):
                    if not depth:
                        out.add(state)
                    state += 1
        return out

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.skip.get(s, ()):
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def run(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """Whether the words from at on are accepted, and the largest share of mandatory words met on the way."""
        states, best = dict(self.start), 0
        while True:
            if self.last in states:
                return True, 1.0
            if at >= len(words) or not states:
                return False, best / max(self.mandatory, 1)
            new: dict[int, int] = {}
            for s, n in states.items():
                word, t = self.literal.get(s, (None, -1))
                if word == words[at]:
                    m = n + (s in self.counted)
                    new[t] = max(new.get(t, -1), m)
                    best = max(best, m)
                for t in self.any.get(s, ()):
                    new[t] = max(new.get(t, -1), n)
            states = self.closure(new)
            at += 1


def scanner(phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> object:
    """text -> n_words, n_base, first_word, last_word, base labels, template labels, score."""
    fixed = [(words_of(p), label) for p, label in phrases]
    automata = [(label, Automaton(t)) for label, t in templates]

    def scan(text: str) -> tuple:
        words = words_of(text)
        own = set(words)
        places, labels = [], set()
        for phrase, label in fixed:
            if own.issuperset(phrase):
                found = [i for i in _places(words, phrase[0]) if words[i : i + len(phrase)] == phrase]
                places += found
                labels |= {label} if found else set()
        more, score = set(), 0.0
        at: dict[bytes, list[int]] = {}
        for label, a in automata:
            for first in a.firsts & own:
                if first not in at:
                    at[first] = _places(words, first)
                for i in at[first]:
                    done, share = a.run(words, i)
                    score = max(score, share * min(1.0, a.mandatory / SCORED_WORDS))
                    if done:
                        more.add(label)
        return len(words), len(places), min(places, default=None), max(places, default=None), labels, more, score

    return scan


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are those of the fixed phrases, overlaps counted. labels has the templates' too; a template is met
    where its mandatory wording stands exactly, optional regions stand or are missing, and replaceable ones have
    words of any kind; what stands before and after it is free. score is the largest share of a template's mandatory
    words met from one place on (1: met), times its mandatory words by SCORED_WORDS where it has fewer: common words
    make up much of a short notice, so its words alone say little, and nothing of what negates them. A null text is empty: no words, no labels, score 0. Repeated rows and null
    ids come back as they are; other columns of docs are left out.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(phrases, templates)
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
            columns += [pa.array([",".join(sorted(x)) for x in of], pa.string()) for of in ([r[4] for r in rows], [r[4] | r[5] for r in rows])]
            columns.append(pa.array([float(r[6]) for r in rows], pa.float64()))
            # ids stay in Arrow: as pandas numbers, those beside a null would lose their low digits
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
