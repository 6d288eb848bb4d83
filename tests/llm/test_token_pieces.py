"""Ids by pieces equal the library's; words of letters are held once."""

import struct

from factflow.llm.common import TokenIds, vocabulary_path

TEXTS = [
    "", " ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "\na", "a\n", "\t a", "a\tb", "a \tb", "a\t b", "\ta", "a\t", "it's we'll Don'T", "x y", "x  y", "x  y",
    "äö ü, 12345 3rd!", "a\r\nb", "a <|endoftext|> b", "你好 \U0001f600 é", "a\x0bb \x1c c", "end.\nNext line's 7", "\x85 z", "z \x1fz",
]


def test_pieces_equal_the_library():
    e = TokenIds(vocabulary_path())
    want = [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert e.encode(TEXTS) == want and e.encode(TEXTS) == want


def test_words_of_letters_are_held_once():
    e = TokenIds(vocabulary_path())
    e.encode(["some plain words"])
    assert {"plain", "words"} <= set(e.pieces) and not {" plain", " words"} & set(e.words)
