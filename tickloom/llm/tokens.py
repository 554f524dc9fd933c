"""Byte-level BPE ids of whole texts.

Ids are those that the `tokenizers` library gives for the JSON form of the same vocabulary without added
special tokens; tiktoken makes them from the rank file about five times as fast. The rank file is read on
the driver and broadcast, so workers need no vocabulary files.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's lines, the splitting pattern and the special tokens; small enough to broadcast."""

    name: str
    lines: bytes
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)

    @property
    def version(self) -> str:
        """Twelve digits of a hash of all that decides the ids."""
        return hashlib.sha256(b"\0".join([self.lines, self.pattern.encode(), repr(self.special).encode()])).hexdigest()[:12]

    @staticmethod
    def load(path: str | None = None, name: str = "byte_bpe_50k") -> Vocabulary:
        import public_tokenizers

        with open(path or public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            return Vocabulary(name, file.read(), public_tokenizers.PATTERN)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.lines.splitlines())}
        self.core: Any = tiktoken.Encoding(vocabulary.name, pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        return np.asarray(self.core.encode_to_numpy(text, allowed_special="all"), dtype="<u4").tobytes() if text else b""


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each version of a vocabulary in each worker process."""
    version = vocabulary.version
    if version not in _encoders:
        _encoders[version] = Encoder(vocabulary)
    return _encoders[version]
