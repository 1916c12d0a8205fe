"""Word-piece encoding of query texts with a given vocabulary, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the start, end and unknown marks, and of the padding, in the usual vocabulary order.
START, END, PAD = 101, 102, 0
CONTEXT = 52
_PARTS = re.compile(r"\w+|[^\w\s]+")


def pieces(text: str, vocabulary: dict[str, int], longest: int = 100) -> list[int]:
    """Greedy longest pieces of each word or run of signs; a word that cannot be cut into pieces is one unknown."""
    unknown = vocabulary["[UNK]"]
    out: list[int] = []
    for word in _PARTS.findall(text.strip().lower()):
        ids, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            ids.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += ids if at == len(word) else [unknown]
    return out


def encode(text: str | None, vocabulary: dict[str, int], context: int = CONTEXT) -> list[int] | None:
    """Start, pieces cut to context - 2, end, padded to ``context``; None for a blank text."""
    if text is None or not text.strip():
        return None
    ids = [START, *pieces(text, vocabulary)[: context - 2], END]
    return ids + [PAD] * (context - len(ids))


def encoded(text: Column, vocabulary: dict[str, int], context: int = CONTEXT) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t, vocabulary, context) for t in texts])

    return run(text)
