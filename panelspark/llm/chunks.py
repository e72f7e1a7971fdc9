"""Token ids by the tokenizers library, with the ids of chunks remembered by each worker.

A text is cut where its tokenizer always begins anew, whatever stands around, so chunks can be encoded apart and most are met again:

* ``word`` (lower case, white space dropped): before and after every space and line feed; neither composes with its neighbours.
* ``byte`` (a pre-token may begin with one space): before every space, before and after every line feed, that stands between two
  characters that aren't white space. Chunks after a space are remembered without it, in a table of their own.

A chunk of letters with marks of punctuation at its end is two pre-tokens for either and is put together from both. A chunk of composed
Latin letters is one pre-token, which the library's model takes as it is: what stands before the model (normalising, splitting) is most
of the time of a short text.

The library finds added tokens (``<|endoftext|>``) before anything else and treats what stands around them apart: a text that holds one
is encoded as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

from panelspark.llm.common import held

#: No apostrophe: with letters behind it a pre-token of its own.
MARKS = '.,;:!?"#$%&()*+-/<=>@[]^_`{|}~\\'
#: Letters below this code point are Latin and in lower case one character each (the one exception is U+0130).
LATIN = "\u0250"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    out, more = [], 0x100
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else more))
        more += not shown
    return out


#: White space beside other, or other than the space and the line feed.
LOOSE = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


class Spaced(dict):
    """chunk -> bytes of its ids after a space, or of its ids if it begins with a line feed; emptied when full."""

    def __init__(self, plain: Chunks):
        super().__init__()
        self.plain = plain

    def __missing__(self, chunk: str) -> bytes:
        plain = self.plain
        if chunk.isascii() and chunk.isalpha():
            v = array(plain.code, [t.id for t in plain.model.tokenize(plain.space + chunk)]).tobytes()
        elif chunk[:1] == "\n":
            v = plain.feed + plain[chunk[1:]]
        elif (word := chunk.rstrip(MARKS)) != chunk and word.isascii() and word.isalpha():
            v = self[word] + plain[chunk[len(word) :]]
        else:
            v = plain.ids(" " + chunk)
        if len(self) >= plain.LIMIT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = v
        return v


class Chunks(dict):
    """chunk -> bytes of its ids; emptied when full, so its memory is bounded."""

    LIMIT = 1 << 20

    def __init__(self, path: str, kind: str, plain: bool = False):
        """``plain``: strings of special tokens inside a text are text like any other."""
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[0x20]
        added = self.library.get_added_tokens_decoder().values()
        self.added = [a.content for a in added if not (plain and a.special)]
        self.normalized = any(a.normalized and not (plain and a.special) for a in added)  # such a token can be met in texts that don't spell it
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.dtype.char  # of the array module: native and little-endian
        self.kind = kind
        self.spaced, self.feed = Spaced(self), self.direct("\n")

    def direct(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        v = self.ids(chunk)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = v
        return v

    def ids(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        letters = word.removeprefix(" ") if self.kind == "byte" else word
        if not chunk:
            return b""
        if not letters.isalpha() or not letters.isascii() and (max(letters) >= LATIN or "\u0130" in letters or not unicodedata.is_normalized("NFC", letters)):
            return self.direct(chunk)
        if word != chunk:
            marks = self[chunk[len(word) :]]
            return (self.spaced[letters] if letters is not word else self[word]) + marks
        if self.kind == "word" and letters != (low := letters.lower()):
            return self[low]
        if letters.isascii():
            raw = chunk if letters is chunk else self.space + letters
        else:
            raw = chunk.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(raw)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.normalized or any(a in text for a in self.added):
            return self.direct(text)
        get = self.__getitem__
        if self.kind == "word":
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, LOOSE)):
            return self._careful(text.split(" "))
        first, *parts = text.replace("\n", " \n").split(" ")
        return get(first) + b"".join(map(self.spaced.__getitem__, parts))

    @staticmethod
    def _edge(part: str) -> bool:
        return part[0].isspace() or part[-1].isspace()

    def _careful(self, parts: list[str]) -> bytes:
        """Joins parts again wherever the space between them touches other white space or the text's edge."""
        chunks = [parts[0]]
        for p in parts[1:]:
            before = chunks[-1]
            if p and before and not before[-1].isspace() and not p[0].isspace():
                chunks.append(" " + p)
            else:
                chunks[-1] = before + " " + p
        return b"".join(map(self.__getitem__, chunks))


def chunks(path: str, kind: str, plain: bool = False) -> Chunks:
    return held((path, kind, plain), lambda: Chunks(path, kind, plain))
