"""Token ids of a public word BPE through small pieces that never influence each other.

The vocabulary file normalises (NFC, white space, lower case), splits with a
pattern of letter runs, single digits, contractions and symbol runs, and merges
inside each split only.  A text may therefore be cut, without changing a token,

* at ASCII white space, and
* between an ASCII letter and an ASCII symbol that takes part in no contraction,
  no special token and no composition (``SYMBOLS``).

Lower-casing A-Z first merges spellings.  It is safe except before a combining
mark, which could compose with the small letter only; such texts, and texts in
which a special token may occur, go to the library whole.
"""

from __future__ import annotations

import re

#: ASCII symbols that may be cut from letters: all but ' < = > |
SYMBOLS = rb"!\"#$%&()*+,\-./:;?@\[\\\]^_`{}~"
_SOLID = rb"(?:[a-z]+|[" + SYMBOLS + rb"]+)"
_OTHER = rb"[^a-z\x09-\x0d\x20" + SYMBOLS + rb"]+"
#: pieces of a lower-cased text
PIECE = re.compile(_SOLID + rb"(?:" + _OTHER + _SOLID + rb"?)*|(?:" + _OTHER + _SOLID + rb"?)+")
#: a special token may be near, or a capital letter before a combining mark
_WHOLE = re.compile(rb"<\||[A-Z][\xcc\xcd\xd2\xe1\xe2\xe3\xef\xf0]")

_LOADED: dict[str, object] = {}


def load(path: str):
    """The library's tokenizer, once per Python worker, without truncation and padding."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def needs_whole(text: bytes) -> bool:
    return _WHOLE.search(text) is not None
