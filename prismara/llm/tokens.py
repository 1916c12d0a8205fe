"""Public tokenizers on executors: loaded once per Python worker from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_lengths(path: str = TOKENIZER) -> np.ndarray:
    """Bytes of each token id."""
    enc = encoder(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


@lru_cache(maxsize=4)
def directions(path: str, dims: int, seed: int) -> np.ndarray:
    """A fixed random direction of ``dims`` numbers for every token id."""
    return np.random.default_rng(seed).standard_normal((encoder(path).n_vocab, dims)).astype(np.float32)
