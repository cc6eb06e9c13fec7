"""Encoding of whole texts with a tokenizers file, one task-local word cache.

Texts repeat their words, so a worker encodes each different word once and joins
the results. The cut points are places where the tokenizer's own splitter cuts
whatever stands on the other side, so the ids are those of encoding the whole
text in one call (tests compare both). Words of plain Latin letters, digits and
punctuation go to the model directly; any other word, or text, goes through the
library's full encode.
"""

from __future__ import annotations

import re
from array import array

import regex
from tokenizers import Tokenizer

CACHE_WORDS = 400_000          # entries a worker keeps before it starts afresh
RECENT_WORDS = 300_000         # the same for word ids, where the entries before stay in reach

# The splitter patterns written in the two tokenizer files.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|"
WORD_END_PIECES = regex.compile(CONTRACTIONS + r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTE_LEVEL_PIECES = regex.compile(CONTRACTIONS + r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LATIN_OR_SPACE = re.compile("[!-~À-ÖØ-öø-ÿ \t\n\r\f\v]+")
# white space outside " \t\n\r\f\v"
_ODD_SPACE = re.compile("[%s]" % "".join(map(chr, (
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000))))
_SEGMENT = re.compile(rb"\s?\S+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _letters(piece: str) -> str:
    return piece if piece.isascii() and " " not in piece and piece.isprintable() else \
        piece.encode().decode("latin-1").translate(_LETTERS)


class WordIds(dict):
    """word (bytes without white space) -> its ids as little-endian unsigned 32-bit
    integers, for files whose splitter drops white space and lower-cases.

    Rare words are most of the work, and many differ only in case or punctuation, so the
    splitter's pieces are kept too. A full cache becomes the one to look in second."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        value = self.before.get(word)
        if value is None:
            value = self._ids(word.decode())
        if len(word) <= 64:
            if len(self) >= RECENT_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value

    def _ids(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self._piece(text.lower())
        if _LATIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._piece, WORD_END_PIECES.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        value = self.pieces.get(piece)
        if value is None:
            value = array("I", [t.id for t in self.model.tokenize(_letters(piece))]).tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= RECENT_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = value
        return value

    def encode(self, text: bytes) -> bytes:
        # a combining mark after white space stays with it, so words are independent
        return b"".join(map(self.__getitem__, text.split()))


class SegmentLengths(dict):
    """segment (white space and the word after it) -> byte lengths of its tokens, as
    unsigned 32-bit integers, for byte-level files."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model

    def _full(self, text: str) -> bytes:
        # one letter of a token stands for one byte
        return array("I", map(len, self.tokenizer.encode(text, add_special_tokens=False).tokens)).tobytes()

    def __missing__(self, segment: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = segment.decode()
        if _LATIN_OR_SPACE.fullmatch(text):
            value = array("I", [len(t.value) for p in BYTE_LEVEL_PIECES.findall(text)
                                for t in self.model.tokenize(_letters(p))]).tobytes()
        else:
            value = self._full(text)
        if len(segment) <= 64:
            self[segment] = value
        return value

    def lengths(self, text: bytes) -> bytes:
        whole = text.decode()
        if _ODD_SPACE.search(whole):
            return self._full(whole)
        return b"".join(map(self.__getitem__, _SEGMENT.findall(text)))


_open: dict[tuple[type, str], dict] = {}


def opened(kind: type, path: str):
    """One encoder per worker process and file."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
