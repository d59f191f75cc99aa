"""Token ids of a word-level BPE tokenizer file, fast on repeated words.

The tokenizer's file says: NFC, white space to a space, lower case, split into contractions, letter runs, single
digits and runs of other signs, then BPE with an end-of-word mark inside each piece. A piece's ids depend on nothing
around it, so they are kept by piece and by white-space chunk; a new piece goes to the library's BPE model. Texts with
characters outside `PLAIN` (or with a special token's string) go to the tokenizers library whole, so all texts get the
library's ids.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

#: ASCII but for the separators 0x1C-0x1F, Latin letters, and common dashes and quotes: NFC leaves them alone, and
#: Python's lower() and split() do to them what the tokenizer's normalizer does.
_PLAIN = [chr(i) for i in [*range(0x1C), *range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x132, 0x180), *range(0x2010, 0x2028), 0x20AC]]


def _cls(first: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == first and not c.isspace())


_NOT_PLAIN = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_cls('L')}]+|[{_cls('N')}]|[^\s{_cls('L')}{_cls('N')}]+")
_MOST = 200_000  # entries of a cache's generation; a cache holds two


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for code points from 256."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.pieces = _Known(self._bpe)
        self.chunks = _Known(self._chunk)

    def _bpe(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.library.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _NOT_PLAIN.search(text) or "<|" in text and any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


class _Known(dict):
    """text -> ids, remembered. A full generation becomes the old one; what is still met there moves to the new one, so
    that words in use stay whatever else comes by."""

    def __init__(self, made):
        super().__init__()
        self.made, self.old = made, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.made(text)
        if len(text) <= 64:
            if len(self) >= _MOST:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids
