"""Token ids of whole texts by a byte-level BPE vocabulary, with a bounded memo of words.

The pre-tokenisation pattern never lets a piece cross a space that stands before a character which
is not white space: the run of white space before it ends there, and the space belongs to the next
piece.  A text may therefore be cut in front of every such space and its parts encoded one by one;
equal parts have equal ids.  Natural text repeats its words, so most parts are found in the memo.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken

from .memo import claim

#: Parts remembered per Python worker (about 200 bytes each); no more are added when it is full.
MEMO_PARTS = 600_000
#: Parts longer than this are encoded without being remembered.
MEMO_CHARS = 64

_CUT = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?:\s|\Z)")


class WordMemo(dict):
    """part -> its ids as packed little-endian integers."""

    def __init__(self, encoding: tiktoken.Encoding, typecode: str, added: dict[str, int] | None = None):
        super().__init__()
        self._added = {token: array(typecode, [i]).tobytes() for token, i in (added or {}).items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._text = encoding.encode_ordinary
        self._piece = encoding._core_bpe.encode_single_piece
        self._typecode = typecode
        self.dtype = np.dtype({"H": "<u2", "I": "<u4"}[typecode])

    def _encode(self, part: str) -> list[int]:
        if part[1:].isalpha() and part[0] == " ":  # one piece of the pattern
            return self._piece(part.encode())
        return self._text(part) if part else []

    def __missing__(self, part: str) -> bytes:
        value = array(self._typecode, self._encode(part)).tobytes()
        if len(self) < MEMO_PARTS and len(part) <= MEMO_CHARS:
            self[part] = value
        return value

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        claim(self)
        if self._split and any(map(text.__contains__, self._added)):
            return b"".join(self._added.get(part) or self._plain(part) for part in self._split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
        head = self[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.__getitem__, [" " + p for p in parts[1:]]))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


_memos: dict[tuple, WordMemo] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def added_tokens(path: str) -> dict[str, int]:
    """Strings of a tokenizer's JSON file that stand for one id wherever a text holds them."""
    with open(path, encoding="utf-8") as lines:
        return {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}


def rank_vocabulary(path: str, added: str | None = None) -> WordMemo:
    """The memo of a rank file; ``added`` is the JSON file whose added tokens are cut out of texts first.

    Without it a text's special-token strings are ordinary text.
    """
    if (path, added) not in _memos:
        table = ranks(path)
        encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        extra = added_tokens(added) if added else {}
        _memos[path, added] = WordMemo(encoding, "H" if max([*table.values(), *extra.values()]) < 1 << 16 else "I", extra)
    return _memos[path, added]
