"""Whole licence texts: accepted with their free regions filled, refused with a mandatory word changed."""

import re
import time

from factflow.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = "3. Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def filled(name):
    """A template's own words, with optional regions left in and free ones filled."""
    return re.sub(r"<<\s*(optional|end)\s*>>", " ", re.sub(r"<<any \d+>>", "Jane Doe", licenses.TEMPLATES[name]))


def names(text):
    return {n for n, _, _ in licenses.Scanner().spans(licenses.words_of(text))}


def test_bsd_texts_are_told_apart():
    assert names("Copyright (c) 2020, X\n" + BSD + AS_IS) == {"bsd-2-clause"}
    assert names(BSD + THIRD + AS_IS) == {"bsd-3-clause"}
    # each label needs the text to its end
    assert names(BSD) == set() and names(BSD + AS_IS[:-20]) == set() and names(BSD + THIRD + AS_IS.replace("TORT", "LAW")) == set()


def test_every_mandatory_word_counts():
    for name in ("mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "apache-2.0-header", "gpl-2.0-notice", "gpl-3.0-notice"):
        text = filled(name)
        assert name in names(f"before {text} after"), name
        words = text.split()
        for at in range(1, len(words), 7):
            if words[at] not in ("Jane", "Doe") and words[at].upper() not in ("1", "2", "3", "A", "B", "C"):
                changed = " ".join(words[:at] + ["zzz", "zzz"] + words[at + 1 :])
                # a changed word next to a free region may fall into it, never elsewhere
                if name in names(changed):
                    assert {"Jane", "Doe"} & set(words[max(0, at - 2) : at + 3]) or words[at].lower() in ("including", "the", "next", "paragraph", "or"), (name, words[at])
    assert names(filled("mit")[:400]) == set()


def test_empty_tables_long_texts_and_other_columns(spark):
    schema = "doc_id long, text string, labels string, spans int, score int"
    rows = [(1, None, "x", 1, 1), (2, "", "x", 1, 1), (3, "cc by " * 100_000 + BSD * 50, "x", 1, 1), (1, None, "x", 1, 1), (None, "MIT License", None, None, None)]
    began = time.time()
    got = {(r.doc_id, r.n_base, r.base_labels, r.first_word, r.last_word) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0, "", None, None), (2, 0, "", None, None), (3, 100_000, "cc-by", 0, 199_998), (None, 1, "mit", 0, 0)} and time.time() - began < 60
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
