"""Byte-level BPE ids of whole texts through the tokenizers library, with memoised words.

The byte-level pattern never lets a token span a non-space character followed
by a space, and a space that is followed by a non-space starts a token.  So a
text may be cut before each such single space, and each piece encoded on its
own, with exactly the ids of the whole text.  Pieces repeat, so the library is
called once for each piece that is not in a bounded cache.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import struct
from codecs import charmap_decode

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s")
_SPACE = re.compile(r"\s")
#: Punctuation that may be taken off the end of an all-letter word: a run of it is one match of the pattern.
#: An apostrophe is not among it, as the pattern may join it to letters.
_TAIL = string.punctuation.replace("'", "")
#: Letters below U+0250, which are the same set in every Unicode version in use.
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
_ENDED = re.compile(f"({_LETTERS.pattern})([{re.escape(_TAIL)}]+)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _ids(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Piece (without its leading space) -> value; at most two generations of `limit` entries, long pieces left out."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str):
        value = self.old.pop(piece, None) or self.make(piece)
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class ByteBpe:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            split = json.load(f).get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only a byte-level pre-tokenizer with its own pattern and without a prefix space is supported")
        letters = _byte_letters()
        self._stand_ins = "".join(letters[b] for b in range(256))
        self._space = letters[32]
        self._simple = str(self.tokenizer.normalizer) == "None"
        self.pieces = Pieces(self._piece, limit)
        self.tails = Pieces(self._whole, 10_000)
        self.sizes = Pieces(self._size, limit)
        self.starts = Pieces(self._start, limit // 4)
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if self._simple:
            if _LETTERS.fullmatch(piece):
                plain = piece if piece.isascii() else charmap_decode(piece.encode("utf-8"), "strict", self._stand_ins)[0]
                return _ids([t.id for t in self.model.tokenize(self._space + plain)])
            ended = _ENDED.fullmatch(piece)
            if ended:
                return self.pieces[ended[1]] + self.tails[ended[2]]
            lines = self._lines(piece)
            if lines:
                return self.pieces[lines[0]] + self.line + self.starts[lines[1]]
        return self._whole(" " + piece)

    def _lines(self, piece: str) -> tuple[str, str] | None:
        """What stands before and after a line break that is the only white space: the pattern makes it a match of its own."""
        left, line, right = piece.partition("\n")
        return (left, right) if line and left and right and not _SPACE.search(left) and not _SPACE.search(right) else None

    def _start(self, text: str) -> bytes:
        """Ids of a text without white space at the beginning of a line."""
        if _LETTERS.fullmatch(text):
            plain = text if text.isascii() else charmap_decode(text.encode("utf-8"), "strict", self._stand_ins)[0]
            return _ids([t.id for t in self.model.tokenize(plain)])
        ended = _ENDED.fullmatch(text)
        return self.starts[ended[1]] + self.tails[ended[2]] if ended else self._whole(text)

    def _size(self, piece: str) -> int:
        if self._simple:
            ended = _ENDED.fullmatch(piece)
            if ended:
                return self.sizes[ended[1]] + len(self.tails[ended[2]]) // 4
            lines = self._lines(piece)
            if lines:
                return self.sizes[lines[0]] + (len(self.line) + len(self.starts[lines[1]])) // 4
        return len(self._piece(piece)) // 4

    def _cut(self, text: str) -> list[str]:
        return _CUT.split(text) if _ODD.search(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self._cut(text)
        return self._whole(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self._cut(text)
        return len(self._whole(parts[0])) // 4 + sum(map(self.sizes.__getitem__, parts[1:]))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """One encoder for each file and process, kept between tasks."""
    return ByteBpe(path)
