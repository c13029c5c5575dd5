"""License scans: phrases, and templates with optional and replaceable regions.

Words are runs of ASCII letters and digits and of characters other than ASCII,
A-Z taken as a-z.  Base labels come from phrases (``PHRASES``): every place
where a phrase's words stand one after the other.

Templates are written in the markup that public licence lists use:
``<<beginOptional>> .. <<endOptional>>`` around wording that may be missing and
``<<var;name="..";words="n">>`` for at most n words that may be replaced by any
others.  A template is compiled into a token automaton; a text is accepted
where the automaton reaches its end, i.e. where all mandatory wording stands
exactly and in order with only such regions between.

Cases: null and empty texts have no words, labels or places and score 0; a
score is 1 when a template is accepted, else 0.5 when a phrase is found, else
0; overlapping places of phrases all count; repeated rows are scanned per row;
an empty table gives an empty result; input columns named like an output are
replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import NOT_ALNUM, chunks, text_bytes, words
from .common import without

#: fixed values: phrase and label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: the parts that the BSD licences have in common
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: <<beginOptional>>1<<endOptional>> <<beginOptional>>a<<endOptional>>
    Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. <<beginOptional>>2<<endOptional>> <<beginOptional>>b<<endOptional>> Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words="8">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";words="8">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: fixed values: label and wording in template markup, each a whole notice or licence text
TEMPLATES = {
    "tpl-apache-2.0-notice": """Licensed under the Apache License<<beginOptional>>, <<endOptional>>
        <<beginOptional>>Version<<endOptional>> 2.0""",
    "tpl-apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        <<var;name="what";words="4">> except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>>
        <<beginOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>
        <<beginOptional>>.txt<<endOptional>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "tpl-mit-notice": """<<var;name="verb";words="1">> under the <<beginOptional>>terms of the<<endOptional>>
        MIT License""",
    "tpl-mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="object";words="6">> and associated documentation files<<beginOptional>> (the
        "Software")<<endOptional>>, to deal in <<var;name="software";words="4">> without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of <<var;name="software";words="4">>, and to permit persons to whom <<var;name="software";words="4">> is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of <<var;name="software";words="4">>.
        <<var;name="software";words="4">> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="8">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        <<var;name="software";words="4">> OR THE USE OR OTHER DEALINGS IN <<var;name="software";words="4">>.""",
    "tpl-gpl-notice": """under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>>
        General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> <<beginOptional>>version<<endOptional>>
        <<beginOptional>>v<<endOptional>> <<var;name="version";words="1">>""",
    "tpl-gpl-header": """<<var;name="program";words="4">> is free software<<beginOptional>>:<<endOptional>> you can
        redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation<<beginOptional>>;<<endOptional>> either version <<var;name="version";words="2">> of the
        License, or (at your option) any later version. <<var;name="program";words="4">> is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "tpl-bsd-2-clause": f"""{BSD_START} {BSD_END}""",
    "tpl-bsd-3-clause": f"""{BSD_START} <<beginOptional>>3<<endOptional>>
        <<beginOptional>>c<<endOptional>> Neither the name of <<var;name="holder";words="8">> nor the names of
        <<var;name="whose";words="3">> contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. {BSD_END}""",
    "tpl-isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software
        for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";words="6">>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL <<var;name="holder";words="6">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "tpl-cc-by-nc": """Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative
        Commons<<endOptional>> CC BY-NC 4.0""",
    "tpl-cc-by": "Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY 4.0",
}
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def text_words(text: str) -> list[bytes]:
    """Words as UTF-8; ``bytes.lower`` changes A-Z only."""
    return _WORD.findall(text.encode().lower())


class Automaton:
    """States are positions in a template; ``word[s]`` leads to the next state,
    ``any_word`` states take any word, ``skip[s]`` are moves without a word."""

    def __init__(self, markup: str):
        self.word: dict[int, tuple[bytes, int]] = {}
        self.any_word: dict[int, int] = {}
        self.skip: dict[int, list[int]] = {}
        at, opened, pos = 0, [], 0
        for m in [*_MARKUP.finditer(markup), None]:
            for w in text_words(markup[pos:m.start()] if m else markup[pos:]):
                self.word[at] = w, at + 1
                at += 1
            if m is None:
                break
            pos, what = m.end(), m.group(1)
            if what == "beginOptional":
                opened.append(at)
            elif what == "endOptional":
                self.skip.setdefault(opened.pop(), []).append(at)
            else:
                n = int(re.search(r'words="(\d+)"', what).group(1))
                for k in range(n):
                    self.any_word[at + k] = at + k + 1
                    self.skip.setdefault(at + k, []).append(at + n)
                at += n
        self.end = at
        self.start = self._closed({0})
        self.first = {self.word[s][0] for s in self.start if s in self.word}
        self.free = any(s in self.any_word for s in self.start)
        #: the longest mandatory word: a text without it is not accepted
        optional = {k for a, bs in self.skip.items() for b in bs for k in range(a, b)}
        self.needs = max((w for s, (w, _) in self.word.items() if s not in optional), key=len)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts_at(self, text: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words from ``at``, if any."""
        states, best = self.start, None
        while True:
            if self.end in states:
                best = at
            if at >= len(text):
                return best
            after = {self.any_word[s] for s in states if s in self.any_word}
            after |= {self.word[s][1] for s in states if s in self.word and self.word[s][0] == text[at]}
            if not after:
                return best
            states, at = self._closed(after), at + 1

    def found(self, text: list[bytes]) -> bool:
        return any((self.free or w in self.first) and self.accepts_at(text, k) is not None
                   for k, w in enumerate(text))


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    return {label: Automaton(markup) for label, markup in TEMPLATES.items()}


def scan_text(low: bytes) -> tuple:
    """(n_base, first_word, last_word, base_labels, labels, score) of lower-case bytes."""
    may = [(label, a) for label, a in automata().items() if a.needs in low]
    if not may and b"license" not in low:
        return 0, None, None, "", "", 0.0
    text = _WORD.findall(low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = [w.encode() for w in phrase.split()]
        found = [k for k, w in enumerate(text) if w == p[0] and text[k:k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    accepted = {label for label, a in may if a.found(text)}
    score = 1.0 if accepted else 0.5 if places else 0.0
    return (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | accepted)), score)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less the text, plus the columns of the module's text."""
    outputs = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()),
               ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()),
               ("score", T.DoubleType())]
    df = without(docs, *(n for n, _ in outputs))
    at = [c.lower() for c in df.columns].index(text.lower())
    others = [i for i in range(len(df.columns)) if i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in others), *(T.StructField(n, k) for n, k in outputs)])
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, 1 << 20):
                edges = offsets[i:j + 1] - offsets[i]
                piece = data[offsets[i]:offsets[j]]
                start, _ = words(piece, edges, NOT_ALNUM)
                n_words = np.diff(np.searchsorted(start, edges))
                rows = [scan_text(piece[edges[k]:edges[k + 1]].tobytes().lower()) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in others), pa.array(n_words, pa.int64()),
                     *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return df.mapInArrow(run, schema)
