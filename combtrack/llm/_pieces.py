"""Encoding with the tokenizers library, piece by piece, where pieces can't influence each other."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from .op03_bpe import encode_text

_BLANK = re.compile(r"[ \t-\r]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Pieces that are one word of Latin letters, all composed and with a lower case of one letter, and punctuation after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_LOADED: dict = {}


def visible_bytes() -> list[str]:
    """The letters by which byte-level tokenizers write bytes: printable ones stand for themselves, others follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Ids by piece: the younger of two generations of `held` pieces; what neither knows is encoded."""

    def __init__(self, make, held: int) -> None:
        super().__init__()
        self.make, self.held, self.older = make, held, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.held:
            self.older = dict(self)
            self.clear()
        data = self.older.get(piece)
        if data is None:
            data = self.make(piece)
        self[piece] = data
        return data


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, for a tokenizer that drops white space.

    The library encodes each piece between runs of ASCII white space once while it is remembered; texts repeat their
    pieces. Plain words go to the library's model, as its normaliser and pattern leave them whole.
    """

    def __init__(self, path: str, held: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.visible = self.tokenizer.model, visible_bytes()
        self.pieces = _Pieces(self._encode, held)

    def _word(self, word: str) -> list[int]:
        shown = word if word.isascii() else "".join([self.visible[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def _encode(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain:
            word, mark = plain.groups()
            ids = self._word(word.lower())
            if mark:
                ids += self._word(mark)
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        # str.split() parts at more than ASCII white space, so it serves texts without other spaces and controls
        return b"".join(map(self.pieces.__getitem__, _BLANK.split(text) if _ODD_SPACE.search(text) else text.split()))


class RankEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, for a byte-level tokenizer of the same library.

    In such a file a token's id is its rank, so tiktoken merges alike from the file's vocabulary, several times faster.
    Strings of special tokens in a text become those tokens, as in the library's plain call.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        byte_of = {c: b for b, c in enumerate(visible_bytes())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the library's plain call gives the string of a special token in a text that token's id
        self.special = special
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str) -> bytes:
        if self.parts is None or not self.parts.search(text):
            return np.array(encode_text(self.coder, text, 1 << 16), "<u4").tobytes()
        out: list[int] = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else encode_text(self.coder, part, 1 << 16)
        return np.array(out, "<u4").tobytes()


def text_encoder(path: str, pattern: str | None = None) -> PieceEncoder | RankEncoder:
    """Once for each worker process; with a pattern the file's tokenizer is byte-level and splits by it."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankEncoder(path, pattern) if pattern else PieceEncoder(path)
    return _LOADED[path, pattern]
