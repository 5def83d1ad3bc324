"""Byte-pair encoding of repeated pieces with bounded memos; the pieces themselves go through the library's model."""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
import regex

from .common import Memo

#: Contractions as both public pre-tokenizers have them.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = regex.compile(CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PIECES = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Units with characters beyond Latin, which Unicode versions may class differently, or with special tokens go whole through the library.
_LAST_PLAIN = "\u017f"


def _byte_map() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as they are and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_MAP = _byte_map()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: So many ids, little-endian.
_packer = lru_cache(maxsize=64)(lambda n: struct.Struct(f"<{n}I").pack)


def _plain(unit: str) -> bool:
    return (unit.isascii() or max(unit) <= _LAST_PLAIN) and "<|" not in unit


class Units:
    """look_up: what units, texts between safe boundaries, encode to."""

    def __init__(self, path: str, units: int = 500_000, pieces: int = 20_000):
        self.whole, self.model = tokenizer(path), tokenizer(path).model
        self.units, self.pieces = Memo(self._encode, units), Memo(self._piece, pieces)

    def look_up(self, units: list[str]) -> list:
        return list(map(self.units.__getitem__, units))

    def _piece(self, piece: str):
        shown = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_MAP)
        return self._of(self.model.tokenize(shown))


class Counts(Units):
    """Numbers of tokens under a byte-level vocabulary."""

    _of = staticmethod(len)

    def _encode(self, unit: str) -> int:
        if not _plain(unit):
            return len(self.whole.encode(unit, add_special_tokens=False))
        return sum(map(self.pieces.__getitem__, BYTE_PIECES.findall(unit)))


class Ids(Units):
    """Little-endian 32-bit ids under a vocabulary of lower-case words."""

    @staticmethod
    def _of(tokens) -> bytes:
        return _packer(len(tokens))(*[t.id for t in tokens])

    def whole_ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            return self._of(self.model.tokenize(unit.lower()))
        if not _plain(unit):
            return self.whole_ids(unit)
        pieces = WORD_PIECES.findall(unit.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        # The pieces of an ASCII unit are units, too, and are held once.
        return b"".join(map((self.units if unit.isascii() else self.pieces).__getitem__, pieces))
