"""Token ids of whole texts from a public byte-level vocabulary, as little-endian 16-bit bytes."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

#: Where the vocabulary lies on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: End-of-document id, free in the vocabulary.
EOD = 50256


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= EOD:
            raise ValueError("the vocabulary needs more than 16 bits, or holds the end-of-document id")
        self.full = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.full.encode_ordinary(text), dtype="<u2").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One for each process and vocabulary."""
    return Encoder(path)
