"""Helpers that several operators share: shared-folder tables, document projections and token ids."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.shared import scratch_path, shared_dir, stored, stored_rows

__all__ = ["WORD", "TokenIds", "ascii_lower", "ascii_lower_bytes", "one_blas_thread", "release_memory", "scratch_path", "shared_dir", "slices", "stored", "stored_rows", "table", "token_ids", "vocabulary_path"]

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Record batches of at most `rows` rows, for work that holds much more than a row's bytes for each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_blas_thread() -> None:
    """Have numpy's linear algebra use one thread in this process: a Python worker has one core, and waiting threads burn
    others' time. Without a known library nothing is done."""
    import ctypes
    import glob
    import os

    import numpy

    for name in glob.glob(os.path.join(os.path.dirname(numpy.__file__) + ".libs", "*openblas*")):
        library = ctypes.CDLL(name)
        for call in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, call):
                getattr(library, call)(1)


def release_memory() -> None:
    """Give what this process has freed back to the system: a Python worker lives on after its task, beside the JVM and the
    other workers of its executor. Where the C library has no such call only Arrow's memory is given back."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def ascii_lower_bytes(raw: bytes) -> bytes:
    return raw.translate(_UPPER)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """A table that asks `make` for what it lacks. When it holds `most` it starts anew, and takes over what is asked for again."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value = self.old[key] if key in self.old else self.make(key)
        return value


class TokenIds:
    """Token ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    A byte-level vocabulary first cuts a text into words by a fixed pattern and merges bytes within each word. White
    space that stands alone between other characters opens the piece it precedes (a space) or is a word of its own (a
    line feed), so a text without neighbouring white space is a sequence of pieces. Pieces and words repeat far more
    often than texts do: the library's model encodes each new word once, and two bounded tables (pieces and words) answer
    for the rest. All other texts go to the library whole.
    """

    _NEIGHBOURS = re.compile(r"\s\s")

    def __init__(self, path: str, pieces: int = 450_000, words: int = 300_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.most = (pieces, words)
        self.pieces = _Memo(self._piece, pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        whole, start, pieces = [], len(self._word("\n")), self.pieces.__getitem__
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                whole.append(i)
                continue
            try:
                # a piece keeps its line feed, any other follows a space; a line feed put first makes the text's start like the rest
                out[i] = b"".join(map(pieces, ("\n" + text.replace("\n", " \n")).split(" ")))[start:]
            except TypeError:
                whole.append(i)
        if whole:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for i, e in zip(whole, encode([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece; None if white space of it stands by other white space, or may: its text goes to the library."""
        if piece.isascii() and piece.isalpha():
            # one word, and no other piece has it
            return self._ids(self.letters[0x20] + piece)
        if not piece or piece[-1].isspace() or (piece[0] != "\n" and piece[0].isspace()) or self._NEIGHBOURS.search(piece):
            return None
        if len(self.words) > self.most[1]:
            self.words.clear()
        words, word = self.words, self._word
        return b"".join([words.get(w) or word(w) for w in self.find(piece if piece[:1] == "\n" else " " + piece)])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            coded = word.replace(" ", self.letters[0x20])
        else:
            coded = word.encode().decode("latin-1").translate(self.letters)
        self.words[word] = out = self._ids(coded)
        return out

    def _ids(self, coded: str) -> bytes:
        ids = [t.id for t in self.tokenize(coded)]
        return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine; every executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, TokenIds] = {}


def token_ids(path: str | None = None) -> TokenIds:
    """The encoder of this Python worker; kept between tasks, so pieces stay known."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = TokenIds(path)
    return _encoders[path]
