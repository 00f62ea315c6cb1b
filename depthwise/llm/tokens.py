"""Token ids of texts, inside tasks, with the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

#: Bound of the words that one Python worker remembers.
REMEMBERED = 100_000
#: Characters among which the re module's classes and the vocabulary's word pattern agree.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ]*")
_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_encoders: dict[str, "Encoder"] = {}


class Encoder(dict):
    """text -> ids as little-endian 16-bit bytes. The dictionary part maps words to their ids' bytes.

    `path` names the vocabulary as ranks. The added tokens of the JSON vocabulary have ids of their own. A lone surrogate counts as the
    replacement character.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.added = {t["content"]: np.array([t["id"]], "<u2").tobytes() for t in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = public_tokenizers.PATTERN
        self.bpe = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.bpe.encode_ordinary(word), "<u2").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.added.get(part) or self._ordinary(part) for part in self.cut.split(text) if part)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _WORDS.findall(text)))
        return np.array(self.bpe.encode_ordinary(text), "<u2").tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
