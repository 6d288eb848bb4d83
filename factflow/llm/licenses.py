"""License scans by template-markup matching.

A template is a licence's wording with marked regions: `<<optional>> ... <<end>>` may be missing, `<<any N>>` stands for
up to N words of any kind. Templates are compiled to token automata over normalised words. A text holds a licence if
some run of its words takes an automaton from its start to an accepting state, that is if all mandatory words match
exactly, in order, with nothing else between them than the marked regions allow.

The words of a text are runs of ASCII letters and digits (lower-cased) and of anything outside ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import table

# The phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The wording of public licences and notices, with their variable regions marked. Licence texts stand whole,
# from the grant to the end of the disclaimer; "-notice", "-header" and the CC names stand for short notices.
_AS_IS = """AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL
    EXEMPLARY OR CONSEQUENTIAL DAMAGES INCLUDING BUT NOT LIMITED TO PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR
    PROFITS OR BUSINESS INTERRUPTION HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR TORT
    INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
    DAMAGE"""
_BSD = """Redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met <<optional>> 1 <<end>> <<optional>> a <<end>> Redistributions of source code must retain the above copyright notice
    this list of conditions and the following disclaimer <<optional>> 2 <<end>> <<optional>> b <<end>> Redistributions in binary form must
    reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution"""
_ISC_END = """THE SOFTWARE IS PROVIDED AS IS AND <<any 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE DATA OR PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER
    TORTIOUS ACTION ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_GPL_END = """This program is distributed in the hope that it will be useful but WITHOUT ANY WARRANTY without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE See the GNU General Public License for more details"""
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License <<optional>> Version <<end>> 2.0""",
    "apache-2.0-header": """Licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with
        the License You may obtain a copy of the License at <<any 12>> Unless required by applicable law or agreed to in writing software
        distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or
        implied See the License for the specific language governing permissions and limitations under the License""",
    "gpl-2.0": """GNU General Public License <<optional>> as published by the Free Software Foundation either <<end>> version 2""",
    "gpl-3.0": """GNU General Public License <<optional>> as published by the Free Software Foundation either <<end>> version 3""",
    "gpl-2.0-notice": f"""This program is free software you can redistribute it and or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation either version 2 of the License or at your option any later version {_GPL_END}""",
    "gpl-3.0-notice": f"""This program is free software you can redistribute it and or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation either version 3 of the License or at your option any later version {_GPL_END}""",
    "lgpl-3.0": """GNU Lesser General Public License <<optional>> as published by the Free Software Foundation either <<end>> version 3""",
    "mit-notice": """<<optional>> Released <<end>> <<optional>> Licensed <<end>> under the <<optional>> terms of the <<end>> MIT License""",
    "mit": """Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so
        subject to the following conditions The above copyright notice and this permission notice <<optional>> including the next
        paragraph <<end>> shall be included in all copies or substantial portions of the Software THE SOFTWARE IS PROVIDED AS IS WITHOUT
        WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION
        OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE""",
    "isc": f"""Permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}""",
    "0bsd": f"""Permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is
        hereby granted {_ISC_END}""",
    "bsd-2-clause": f"""{_BSD} THIS SOFTWARE IS PROVIDED BY <<any 12>> {_AS_IS}""",
    "bsd-3-clause": f"""{_BSD} <<optional>> 3 <<end>> <<optional>> c <<end>> Neither the name of <<any 12>> nor the names of <<any 6>>
        contributors may be used to endorse or promote products derived from this software without specific prior written permission
        THIS SOFTWARE IS PROVIDED BY <<any 12>> {_AS_IS}""",
    "cc-by-4.0": """<<optional>> Licensed under <<end>> CC BY 4.0""",
    "cc-by-sa-4.0": """<<optional>> Licensed under <<end>> CC BY SA 4.0""",
    "cc-by-nc-4.0": """<<optional>> Licensed under <<end>> CC BY NC 4.0""",
    "cc-by-nc-nd-4.0": """<<optional>> Licensed under <<end>> CC BY NC ND 4.0""",
    "cc-by-long": """Creative Commons Attribution <<optional>> ShareAlike <<end>> <<optional>> NonCommercial <<end>> 4.0 International""",
}

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: ASCII capitals become small; every other byte that is no letter, digit or part of a wider character becomes a space.
_FOLD = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else _FOLD[b] for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def parse(markup: str) -> list:
    """The regions of a template: words (bytes), ("optional", regions) and ("any", most)."""
    out: list = []
    stack = [out]
    for mark, text in re.findall(r"<<\s*(.*?)\s*>>|([^<]+)", markup):
        if text:
            stack[-1].extend(words_of(text))
        elif mark == "optional":
            stack.append([])
        elif mark == "end":
            if len(stack) == 1:
                raise ValueError("<<end>> without <<optional>>")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m := re.fullmatch(r"any (\d+)", mark):
            stack[-1].append(("any", int(m[1])))
        else:
            raise ValueError(f"unknown mark <<{mark}>>")
    if len(stack) > 1:
        raise ValueError("<<optional>> without <<end>>")
    return out


class Automaton:
    """A token automaton: for each state, moves by a word, moves by any word, and the states reached without a word."""

    def __init__(self, regions: list):
        self.by_word: list[dict[bytes, int]] = [{}]
        self.by_any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        self.accept = self._build(regions, 0)
        self.closed = [self._closure(s) for s in range(len(self.free))]

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _build(self, regions: list, at: int) -> int:
        for r in regions:
            if isinstance(r, bytes):
                new = self._state()
                self.by_word[at][r] = new
                at = new
            elif r[0] == "optional":
                entry, out = self._state(), self._state()
                self.free[at] += [entry, out]
                self.free[self._build(r[1], entry)].append(out)
                at = out
            else:
                states = [at, *[self._state() for _ in range(r[1])]]
                out = self._state()
                for a, b in zip(states, states[1:], strict=False):
                    self.by_any[a] = b
                for s in states:
                    self.free[s].append(out)
                at = out
        return at

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def first_words(self) -> set[bytes]:
        return {w for s in self.closed[0] for w in self.by_word[s]}

    def accepts_at(self, words: list[bytes], at: int) -> int | None:
        """End of the shortest accepted run of words that begins at `at`; None if there is none."""
        states = self.closed[0]
        while self.accept not in states:
            if at == len(words):
                return None
            w, new = words[at], set()
            for s in states:
                if (t := self.by_word[s].get(w)) is not None:
                    new |= self.closed[t]
                if (t := self.by_any[s]) is not None:
                    new |= self.closed[t]
            if not new:
                return None
            states, at = new, at + 1
        return at


def as_regex(regions: list) -> str:
    """The same language as a regular expression over " word word ... ", for checks in SQL."""
    out = ""
    for r in regions:
        if isinstance(r, bytes):
            out += " " + re.escape(r.decode())
        elif r[0] == "optional":
            out += f"(?:{as_regex(r[1])})?"
        else:
            out += f"(?: [^ ]+){{0,{r[1]}}}"
    return out


class Scanner:
    """All templates and base phrases over one text at a time."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = {name: Automaton(parse(t)) for name, t in templates.items()}
        #: Template names by the words that can begin them.
        self.begins: dict[bytes, list[str]] = {}
        for name, a in self.automata.items():
            if a.accept in a.closed[0] or any(a.by_any[s] is not None for s in a.closed[0]):
                raise ValueError(f"template {name} does not begin with a mandatory word")
            for w in a.first_words():
                self.begins.setdefault(w, []).append(name)
        self.first = frozenset(self.begins)

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(template, first word, end) of each accepted run, longest-first order not implied."""
        out = []
        if self.first.isdisjoint(words):
            return out
        for i, w in enumerate(words):
            if w in self.first:
                for name in self.begins[w]:
                    end = self.automata[name].accepts_at(words, i)
                    if end is not None:
                        out.append((name, i, end))
        return out

    def base(self, words: list[bytes]) -> list[tuple[str, int]]:
        """(label, first word) of each place of a base phrase."""
        line, out = b" " + b" ".join(words) + b" ", []
        for phrase, label in self.phrases:
            at, before, n = line.find(phrase), 0, 0
            while at >= 0:
                n, before = n + line.count(b" ", before, at), at
                out.append((label, n))
                at = line.find(phrase, at + 1)
        return out


SCHEMA = "doc_id BIGINT, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base_labels STRING, labels STRING, score DOUBLE, spans ARRAY<STRUCT<template: STRING, first: BIGINT, end: BIGINT>>"
_SPAN = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            base, spans = scanner.base(words), scanner.spans(words)
            starts, own = [i for _, i in base], {b for b, _ in base}
            rows.append(
                {
                    "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {s[0] for s in spans})),
                    "score": 1.0 if spans else 0.5 if base else 0.0, "spans": [{"template": n, "first": a, "end": b} for n, a, b in spans],
                }
            )
        types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": _SPAN}
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array([r[k] for r in rows], types.get(k, pa.int64())) for k in names})


def scan(docs: DataFrame) -> DataFrame:
    """Licence scan of each row of `docs` (doc_id, text), row by row, without a shuffle.

    score: 1 where a template is accepted, 0.5 where only a base phrase stands, else 0. spans: the accepted runs of
    words. Null and empty texts have no words, empty labels and score 0. Repeated rows are scanned each by themselves. A text
    of any length is scanned whole, in time that grows with its length; an empty table gives no rows. Columns other than these two are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scan, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS pos FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE words[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES.items()
    )
    found = ", ".join(f"CASE WHEN regexp_matches(line, '{as_regex(parse(t))} ') THEN '{name}' END" for name, t in TEMPLATES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p AS ({places}), b AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM p GROUP BY doc_id
), t AS (
  SELECT doc_id, len(words) AS n_words, list_filter([{found}], lambda x: x IS NOT NULL) AS extra
  FROM (SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w)
)
SELECT t.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), extra))), ',') AS labels,
  CASE WHEN len(extra) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM t LEFT JOIN b USING (doc_id)
"""


OP2_SQL = _sql()
