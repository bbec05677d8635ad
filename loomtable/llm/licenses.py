"""License scans by template-markup matching.

A template is a license wording with markup: ``<<optional>> ... <</optional>>``
may be missing, ``<<var:N>>`` stands for up to N words of any kind.  Each
template is compiled into an automaton over words; a text is accepted where
its words follow the mandatory wording exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.common import bounded_batches, pieces

#: Separators become spaces, A-Z lower case; what is left are words of [0-9a-z] and bytes of other characters.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

# Base phrases and the labels that they give.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of public licenses with markup.
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<var:1>> Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. <<var:1>> Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BSD_NAMES = """<<var:1>> Neither the name of <<var:20>> nor the names of <<var:4>> contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var:20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:20>>
    BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
    THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: list[tuple[str, str]] = [
    # notices of one line
    ("mit", "released under <<optional>>the terms of<</optional>> the <<optional>>expat or<</optional>> mit license"),
    ("apache", "licensed under the apache license <<optional>>version<</optional>> 2"),
    ("gpl", "licensed under the <<optional>>terms of the<</optional>> gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license"),
    ("cc", "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons <<optional>>cc<</optional>> attribution <<optional>>noncommercial<</optional>> <<optional>>sharealike<</optional>> <<optional>>noderivatives<</optional>> <<var:2>> license"),
    ("cc", "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<optional>>creative commons<</optional>> cc by"),
    # whole wordings
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var:12>> (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:20>> BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var:3>> except in compliance with
        the License. You may obtain a copy of the License at <<var:10>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This <<var:4>> is free software: you can redistribute it and/or modify it under the terms of the GNU
        <<optional>>Lesser<</optional>> <<optional>>Affero<</optional>> General Public License as published by the Free Software
        Foundation, either version <<var:2>> of the License, or <<optional>>(at your option)<</optional>> any later version.
        <<var:5>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<optional>>Lesser<</optional>>
        <<optional>>Affero<</optional>> General Public License for more details.""",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd-2-clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("bsd-3-clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    (
        "isc",
        """Permission to use, copy, modify, <<optional>>and<</optional>> <<optional>>or<</optional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:20>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ),
]

_MARK = re.compile(r"<<optional>>|<</optional>>|<<var:(\d+)>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TokenAutomaton:
    """States with one edge (a word, or None for any) and jumps that read nothing."""

    def __init__(self, template: str):
        self.edge: list[bytes | None] = []
        self.jumps: list[list[int]] = []
        self.reads: list[bool] = []
        opened: list[int] = []
        last = 0
        for m in [*_MARK.finditer(template), None]:
            for w in words_of(template[last : m.start() if m else None].encode()):
                self._state(w)
            if m is None:
                break
            last = m.end()
            if m[1]:
                first = len(self.edge)
                for k in range(int(m[1])):
                    self._state(None)
                    self.jumps[first + k].append(first + int(m[1]))
            elif m[0] == "<<optional>>":
                opened.append(self._fork())
            elif not opened:
                raise ValueError("optional region closed but not opened")
            else:
                self.jumps[opened.pop()].append(len(self.edge))
        if opened:
            raise ValueError("optional region not closed")
        self.end = len(self.edge)
        self.closed = [self._closure(s) for s in range(self.end + 1)]
        #: words that a match can begin with; None if any may
        starts = {self.edge[s] for s in self.closed[0] if s != self.end}
        if self.end in self.closed[0] or None in starts:
            raise ValueError("a template needs a mandatory word before and apart from its regions")
        if any(self.end in c for c in self.closed[: self.end]):
            raise ValueError("a template needs a mandatory word behind its regions, which would match nothing there")
        self.starts = starts
        self.words = {w for w in self.edge if w is not None}

    def _state(self, word: bytes | None) -> None:
        self.edge.append(word)
        self.jumps.append([])
        self.reads.append(True)

    def _fork(self) -> int:
        self._state(None)
        self.reads[-1] = False
        self.jumps[-1].append(len(self.edge))
        return len(self.edge) - 1

    def _closure(self, state: int) -> list[int]:
        seen, todo = set(), [state]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                if s < self.end:
                    todo += self.jumps[s]
        return [s for s in seen if s == self.end or self.reads[s]]

    def match(self, words: list[bytes], at: int) -> int | None:
        """Words read by the shortest accepted run from position ``at``, or None."""
        now = set(self.closed[0])
        n = 0
        while now:
            if self.end in now:
                return n
            if at + n >= len(words):
                return None
            w = words[at + n]
            now = {t for s in now if self.edge[s] is None or self.edge[s] == w for t in self.closed[s + 1]}
            n += 1
        return None

    def first(self, words: list[bytes]) -> int | None:
        for at, w in enumerate(words):
            if w in self.starts and self.match(words, at) is not None:
                return at
        return None


_OUT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_templates", T.LongType())]
)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """License labels of each document (doc_id, text), without a shuffle.

    n_base counts all places where a base phrase's words stand together,
    first_word and last_word are the smallest and largest start (null without
    one).  score is 1 if a template accepts, 0.5 for base phrases alone, else
    0; n_templates counts accepting templates.  A null text is empty (no
    words, labels ""); ids may be null or repeated, each row has its own
    result; other columns are not read.
    """
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(words_of(k.encode()), v) for k, v in BASE_PHRASES.items()]
        automata = [(label, TokenAutomaton(x)) for label, x in given]
        # a template's longest mandatory-looking word must occur before its automaton runs; a phrase's last word likewise
        anchors = [min(a.starts, key=len) if len(a.starts) == 1 else b"" for _, a in automata]
        for batch, texts in pieces(batches, 1):
            out: list[list] = [[] for _ in range(8)]
            for x in texts:
                low = x.translate(_TABLE)
                words = low.split()
                places: list[int] = []
                base: set[str] = set()
                if b"license" in low:
                    for k, w in enumerate(words):
                        if w == b"license":
                            for phrase, label in phrases:
                                s = k - len(phrase) + 1
                                if s >= 0 and words[s : k + 1] == phrase:
                                    places.append(s)
                                    base.add(label)
                labels, accepted = set(base), 0
                for (label, a), anchor in zip(automata, anchors, strict=True):
                    if anchor in low and a.first(words) is not None:
                        labels.add(label)
                        accepted += 1
                row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if accepted else 0.5 if base else 0.0, accepted)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=_OUT.names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
