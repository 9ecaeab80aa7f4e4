"""Byte-level BPE encoding of whole texts through a cache of words.

The pre-tokeniser of such a vocabulary never joins a character to a white-space character that follows it, so a text
falls apart, before each white-space run, into units whose ids depend on nothing else.  Units repeat; each is encoded
once per worker (up to a bound) and a text's ids are the concatenation of its units' bytes.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: White space besides blank and line feed (fixed values, from the Unicode property).
OTHER_SPACE = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that regular-expression libraries disagree about, or that mark units here.
ODD = "\x00\x01\x1c\x1d\x1e\x1f"
_UNIT = re.compile(r"\s*\S+|\s+")
_CLOSING = ".,;:!?"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


_LETTER = _byte_letters()
_BLANK = _LETTER[32]


class TextEncoder(dict):
    """Unit -> ids as little-endian uint32 bytes.  A plain key stands for a blank and the key; a key after ``\\x00`` for
    a line feed and the rest; one after ``\\x01`` for the rest as it is."""

    def __init__(self, path: str, limit: int = 500_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path)
        self._tokenize = self._encode.model.tokenize
        self._tails: dict[str, bytes] = {}
        self._special = [t.content for t in self._encode.get_added_tokens_decoder().values()]
        self._limit, self._longest = limit, longest
        ids = np.arange(max(self._encode.get_vocab().values()) + 1, dtype=np.uint32).tobytes()
        self._bytes_of = [ids[k : k + 4] for k in range(0, len(ids), 4)]

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _letters(self, before: str, stem: str) -> bytes:
        """Ids of letters after a blank or nothing: one pre-token, of which the model needs no splitting."""
        letters = before.replace(" ", _BLANK) + stem if stem.isascii() else "".join([_LETTER[b] for b in (before + stem).encode()])
        return b"".join([self._bytes_of[t.id] for t in self._tokenize(letters)])

    def _tail(self, tail: str) -> bytes:
        if tail not in self._tails:
            ids = self._ids(tail)
            if len(self._tails) >= 1000:
                return ids
            self._tails[tail] = ids
        return self._tails[tail]

    def __missing__(self, key: str) -> bytes:
        head = key[:1]
        marked = head == "\x00" or head == "\x01"
        word = key[1:] if marked else key
        stem = word.rstrip(_CLOSING)
        if not stem.isalpha():
            out = self._ids(("" if head == "\x01" else "\n" if marked else " ") + word)
        elif len(stem) < len(word):  # the stem's ids are mostly at hand
            out = self[head + stem if marked else stem] + self._tail(word[len(stem) :])
        elif marked:
            out = self._letters("", stem)
            out = self._tail("\n") + out if head == "\x00" else out
        else:
            out = self._letters(" ", stem)
        if len(self) < self._limit and len(key) <= self._longest:
            self[key] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in ODD) or any(s in text for s in self._special):
            return self._ids(text)
        if (
            "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or text[0] in " \n"
            or text[-1] in " \n"
            or any(c in text for c in OTHER_SPACE)
        ):
            return b"".join([self["\x01" + unit] for unit in _UNIT.findall(text)])
        first, *rest = text.replace("\n", " \x00").split(" ")
        return self["\x01" + first] + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker and vocabulary."""
    return TextEncoder(path)
