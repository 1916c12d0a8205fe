"""Evaluation passages in training text.

A document and a test item share a passage if they have at least ``width`` consecutive words in common. Each shard of the corpus (a
run of documents of one input partition, closed once it holds ``SHARD_WORDS`` words) gets an FM-index; all ``width``-word phrases of the items are
searched backwards through it at once, their occurrences located by sampled suffix positions, and the hits merged to spans.

Words outside the items' vocabulary cannot be part of a hit. They act as breaks, and runs between breaks that are shorter than
``width`` are left out of the index; this changes no result. No text is shuffled: documents are read once, and only hits leave a task.

The items are the stated set of searches. Their phrases are sent to all tasks; the number of their characters is checked against
``ITEM_CHARS`` and larger sets are searched in blocks of items, one pass over the corpus for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.fmindex import FMIndex

WIDTH = 13
SHARD_WORDS = 1_000_000
ITEM_CHARS = 5_000_000
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The longest runs of Unicode letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if "İ" in text else WORD.findall(text.lower())


class Phrases:
    """The vocabulary of a set of items and their distinct phrases of ``width`` words as arrays: ``patterns`` (phrases, width), and for
    phrase p the items ``items[starts[p] : starts[p + 1]]``. Made once on the driver; tasks only look words up."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.vocabulary = width, {}
        number = self.vocabulary.setdefault
        encoded = [(item, np.array([number(w, len(self.vocabulary) + 2) for w in words(text or "")], np.int32)) for item, text in items]  # 1 is the break
        rows = [(item, np.lib.stride_tricks.sliding_window_view(ids, width)) for item, ids in encoded if len(ids) >= width]
        every = np.concatenate([r for _, r in rows]) if rows else np.zeros((0, width), np.int32)
        owner = np.repeat(np.array([i for i, _ in rows], np.int64), [len(r) for _, r in rows])
        # equal phrases are next to each other in this order, and so are their items
        order = np.lexsort((owner, *every.T[::-1])) if len(every) else np.zeros(0, np.int64)
        every, owner = every[order], owner[order]
        new = np.r_[True, (every[1:] != every[:-1]).any(1)] if len(every) else np.zeros(0, bool)
        keep = new | np.r_[True, owner[1:] != owner[:-1]] if len(every) else new
        self.patterns = every[new]
        self.items = owner[keep]
        self.starts = np.r_[np.flatnonzero(new[keep]), len(self.items)]
        # the alphabet is compact: only words that some item uses count
        self.size = len(self.vocabulary) + 1

    def encode(self, text: str) -> np.ndarray:
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))


def _long_runs(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, ids > 0, 0]))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= width
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def _search(phrases: Phrases, docs: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame | None:
    """Hits in a shard; docs: (doc_id, first word's number, word ids of a run)."""
    if not docs:
        return None
    text = np.concatenate([np.r_[ids, 1] for _, _, ids in docs])
    begins = np.cumsum([0] + [len(ids) + 1 for _, _, ids in docs[:-1]])
    index = FMIndex(text, phrases.size)
    low, high = index.ranges(phrases.patterns)
    hit = np.nonzero(high > low)[0]
    if not len(hit):
        return None
    count = high[hit] - low[hit]
    pattern = np.repeat(hit, count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
    at = index.locate(rows)
    run = np.searchsorted(begins, at, "right") - 1
    doc = np.array([d for d, _, _ in docs], np.int64)[run]
    word = at - begins[run] + np.array([s for _, s, _ in docs], np.int64)[run]
    n_items = phrases.starts[pattern + 1] - phrases.starts[pattern]
    item = phrases.items[np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items) + np.repeat(phrases.starts[pattern], n_items)]
    hits = pd.DataFrame({"doc_id": np.repeat(doc, n_items), "item_id": item, "word": np.repeat(word, n_items)})
    # overlapping hits of an item in a document make one span
    hits = hits.sort_values(["doc_id", "item_id", "word"]).drop_duplicates()
    new = (hits.doc_id != hits.doc_id.shift()) | (hits.item_id != hits.item_id.shift()) | (hits.word - hits.word.shift() > phrases.width)
    spans = hits.groupby(new.cumsum(), sort=False).agg(doc_id=("doc_id", "first"), item_id=("item_id", "first"), first_word=("word", "first"), last=("word", "last"))
    spans["end_word"] = spans.pop("last") + phrases.width
    return spans


def spans(documents: DataFrame, items: DataFrame, width: int = WIDTH, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word) of every passage of at least ``width`` words that a document shares with an item; words
    are numbered from 0, the end is exclusive, passages of one item that touch are merged.

    Null or empty texts and texts of fewer words have no passages; rows with a null key are left out; a repeated document or item key
    counts once (the spans of all its rows are united); empty tables give no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    tests = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    chars = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(chars // ITEM_CHARS) + 1
    corpus = documents.select(F.col(doc_key).cast("long").alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull() & F.col("t").isNotNull())
    out = None
    for block in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in part.collect()], width))  # ITEM_CHARS at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases: Phrases = shared.value
            if not len(phrases.patterns):
                return
            docs, held = [], 0
            for batch in batches:
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = phrases.encode(value.as_py())
                    for a, b in _long_runs(ids, width):
                        docs.append((doc, a, ids[a:b]))
                        held += b - a
                    if held >= shard_words:
                        if (found := _search(phrases, docs)) is not None:
                            yield pa.RecordBatch.from_pandas(found, preserve_index=False)
                        docs, held = [], 0
            if (found := _search(phrases, docs)) is not None:
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

        found = corpus.mapInArrow(run, "doc_id long, item_id long, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leaked(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id) of every document and item that share a passage."""
    return spans(documents, items, width).select("doc_id", "item_id").distinct()
