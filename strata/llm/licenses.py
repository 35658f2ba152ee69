"""License scans with templates compiled to token automata (operator 10).

A template is wording with markup: ``<<optional>> ... <<end>>`` encloses words a text may
leave out, ``<<any N>>`` stands for up to N words of any kind. It compiles to an automaton
over tokens: an optional region can be jumped over, a replaceable region loops on any word a
bounded number of times. A text is accepted where the automaton reads all mandatory words in
order, exactly, with nothing else between them. Spacing, punctuation and case do not count.

A license's label stands for its whole mandatory wording: grant, all conditions and disclaimer.
Notices, and the opening sentences of MIT (``mit-text``) and BSD (``bsd-grant``), have labels of
their own, which say nothing of what follows.

Beside the templates, every place where the words of a base phrase stand consecutively is
counted. Labels are those of base phrases and of accepted templates; the score is the largest
share of a template's mandatory words that the text follows from the template's beginning, if
those are ``LEAST`` words or more (1 where one is accepted; a base phrase alone counts 0.5).

Null and empty texts have no words, no labels and score 0. Rows are answered one by one:
repeated rows and ids, null ids and further columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import Rolling, lower, released, steps, text_bytes, word_spans

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}



def _whole(name: str, *regions: tuple[str, str]) -> str:
    """A published text up to the end of its terms, with ``regions`` put for their patterns."""
    text = resources.files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")
    end = "END OF TERMS AND CONDITIONS"
    text = text[: text.index(end)] + end
    for pattern, region in regions:
        text, found = re.subn(pattern, region, text, count=1, flags=re.DOTALL)
        if not found:
            raise ValueError(f"{name} has no {pattern}")
    return text


_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    " software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
)
_MIT = (
    f"{_MIT_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
    " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to"
    " do so, subject to the following conditions: The above copyright notice and this permission notice"
    " <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of"
    " the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN"
    " AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE"
    " OR OTHER DEALINGS IN THE SOFTWARE"
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met"
)
_BSD_2 = (
    " <<any 1>> Redistributions of source code must retain the above copyright notice, this list of conditions and"
    " the following disclaimer. <<any 1>> Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_ADVERTISING = (
    " <<any 1>> All advertising materials mentioning features or use of this software must display the following"
    " acknowledgement: This product includes software developed by <<any 20>>"
)
_BSD_NAMES = (
    " <<any 1>> Neither the name of <<any 12>> <<optional>>nor the names of <<any 3>> contributors<<end>> may be used"
    " to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY <<any 12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN"
    " NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR"
    " PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,"
    " EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_GPL_NOTICE = (
    "This <<any 3>> is free software <<any 1>> you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation <<optional>>either<<end>> version"
)

#: Labels and templates of the method.
TEMPLATES = {
    "mit-notice": "<<optional>>This <<any 3>> is<<end>> released under the <<optional>>terms of the<<end>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    " software and associated documentation files <<optional>>(the \"Software\")<<end>>, to deal in"
    " <<optional>>the Software<<end>> <<any 3>> without restriction",
    "mit-license": _MIT,
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\")<<end>>",
    "apache-2.0-license": _whole("apache-2.0", (r"https?://www\.apache\.org/licenses/", "<<optional>><<any 1>> www.apache.org/licenses<<end>>")),
    "gpl-2.0": "<<any 3>> is licensed under the GNU General Public License, <<optional>>as published by the Free"
    " Software Foundation, either<<end>> version 2",
    "gpl-3.0": "<<any 3>> is licensed under the GNU General Public License, <<optional>>as published by the Free"
    " Software Foundation, either<<end>> version 3",
    "gpl-2.0-notice": f"{_GPL_NOTICE} 2 of the License",
    "gpl-3.0-notice": f"{_GPL_NOTICE} 3 of the License",
    "gpl-2.0-license": _whole(
        "gpl-2.0",
        (r"Copyright \(C\).*?(?=Everyone is permitted)", "<<optional>>Copyright <<any 30>><<end>> "),
        (r"GNU Lesser General", "GNU <<any 1>> General"),
    ),
    "gpl-3.0-license": _whole("gpl-3.0", (r"Copyright \(C\).*?(?=Everyone is permitted)", "<<optional>>Copyright <<any 30>><<end>> ")),
    "cc-by-4.0": "Licensed under CC BY <<any 0>> 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC <<optional>>Attribution NonCommercial<<end>> 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA <<optional>>Attribution ShareAlike<<end>> 4.0",
    "bsd-grant": _BSD_GRANT,
    "bsd-2-clause": _BSD_GRANT + _BSD_2 + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_GRANT + _BSD_2 + _BSD_NAMES + _BSD_DISCLAIMER,
    "bsd-4-clause": _BSD_GRANT + _BSD_2 + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER,
}

#: Bytes that part words; letters have been lower-cased before.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Mandatory words a text has to follow before that counts.
LEAST = 3
_MARK = re.compile(r"<<(optional|end|any \d+)>>")


def words_of(text: str) -> list[str]:
    data = lower(np.frombuffer(text.encode(), np.uint8))
    begins, ends, _ = word_spans(data, np.array([0, len(data)]), GAPS)
    raw = data.tobytes()
    return [raw[b:e].decode() for b, e in zip(begins, ends, strict=True)]


class Automaton:
    """A template's states: a word to read, or any word; and where optional regions jump to."""

    def __init__(self, template: str):
        self.words: list[str | None] = []
        self.jumps: dict[int, set[int]] = {}
        self.mandatory: list[int] = [0]  # mandatory words before each state
        opened = None
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for word in words_of(part):
                    self._add(word, opened is None)
            elif part == "optional":
                opened = len(self.words)
            elif part == "end":
                self.jumps.setdefault(opened, set()).add(len(self.words))
                opened = None
            else:
                first, count = len(self.words), int(part.split()[1])
                for _ in range(count):
                    self._add(None, False)
                for k in range(count):
                    self.jumps.setdefault(first + k, set()).add(first + count)
        self.end = len(self.words)
        self.total = self.mandatory[self.end]
        #: Words that can be read first among the mandatory or optional ones; a leading
        #: replaceable region may be empty, so it need not be tried.
        self.start = 0
        while self.start < self.end and self.words[self.start] is None:
            self.start += 1
        self.first = {self.words[s] for s in self._close({self.start}) if s < self.end and self.words[s]}

    def _add(self, word: str | None, mandatory: bool) -> None:
        self.words.append(word)
        self.mandatory.append(self.mandatory[-1] + mandatory)

    def _close(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for target in self.jumps.get(todo.pop(), ()):
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return seen

    def follow(self, words: list[str], at: int) -> float:
        """Largest share of the mandatory words read from word ``at`` on; 1.0 accepts."""
        states, most = self._close({self.start}), 0
        while True:
            most = max(most, max(self.mandatory[s] for s in states))
            if self.end in states:
                return 1.0
            if at == len(words):
                break
            word = words[at]
            states = self._close({s + 1 for s in states if self.words[s] is None or self.words[s] == word})
            if not states:
                break
            at += 1
        return most / self.total if most >= LEAST else 0.0


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, t in templates.items()]
        self.starts = sorted({w for _, a in self.automata for w in a.first})
        texts = sorted({w for p, _ in self.phrases for w in p} | set(self.starts))
        data, offsets = text_bytes(pa.array(texts))
        self.codes = dict(zip(texts, Rolling(data).runs(offsets[:-1], offsets[1:]), strict=True))

    def scan(self, column: pa.Array) -> list[tuple]:
        data, offsets = text_bytes(column)
        data = lower(data)
        begins, ends, counts = word_spans(data, offsets, GAPS)
        codes = Rolling(data).runs(begins, ends)
        owner = np.repeat(np.arange(len(column)), np.diff(counts))
        places: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in self.phrases:
            hit = codes == self.codes[phrase[0]]
            for k, word in enumerate(phrase[1:], 1):
                hit[: len(hit) - k] &= (codes[k:] == self.codes[word]) & (owner[k:] == owner[: len(owner) - k])
                hit[len(hit) - k :] = False
            for i in np.flatnonzero(hit).tolist():
                places.setdefault(int(owner[i]), []).append((i - int(counts[owner[i]]), label))
        tries: dict[int, list[int]] = {}
        for i in np.flatnonzero(np.isin(codes, [self.codes[w] for w in self.starts])).tolist():
            tries.setdefault(int(owner[i]), []).append(i)
        raw, rows = data.tobytes(), []
        for d in range(len(column)):
            found, base = places.get(d, []), {label for _, label in places.get(d, [])}
            labels, score = set(base), 0.5 if base else 0.0
            if d in tries:
                words = None
                for i in tries[d]:
                    word = raw[begins[i] : ends[i]].decode()
                    for label, automaton in self.automata:
                        if word in automaton.first:
                            if words is None:
                                span = slice(counts[d], counts[d + 1])
                                words = [raw[b:e].decode() for b, e in zip(begins[span].tolist(), ends[span].tolist(), strict=True)]
                            share = automaton.follow(words, i - int(counts[d]))
                            score = max(score, share)
                            if share == 1.0:
                                labels.add(label)
            at = [p for p, _ in found]
            rows.append((int(counts[d + 1] - counts[d]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
        return rows


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Base phrases, accepted templates and score of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]):
        scanner = Scanner(phrases, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for part in steps(batches, "text"):
            columns = zip(*scanner.scan(part.column("text")), strict=True)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(released(run), SCHEMA)


def query(spark, sf_dir):
    from strata.llm.common import read

    return license_scan(read(spark, sf_dir, "documents"))
