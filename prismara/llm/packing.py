"""Filling containers of a fixed number of tokens with documents, neighbours first.

Each document's hashed term vector (token counts under a root, so that long documents do not drown) is projected to a few dimensions;
the place of that point on a Hilbert curve orders the corpus so that similar documents are neighbours. Documents are range-partitioned
by that key and packed along the curve: each goes into the open container that it fills best; only ``OPEN`` containers are open at a
time, so memory is bounded and a container holds documents from one stretch of the curve. What is open at the end of a partition is
packed once more by decreasing size.

Only (document, tokens, key) is shuffled, never text. A tie in the key is broken by a hash of the document, so any number of copies of
one text spreads over partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.tokens import TOKENIZER, directions, encoder
from prismara.storage import materialise

CAPACITY = 4_096
OPEN = 64
DIMS, BITS = 4, 8
CONTAINERS_PER_TASK = 1_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension: the bits of each dimension are
    turned into the curve's frame from the top down, Gray-decoded and interleaved."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            set_ = (x[:, d] & bit) > 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, dims - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def measured(documents: DataFrame, doc_key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, key): tokens of the whole text and the document's place on the curve. A null or empty text has no tokens; a
    repeated key counts once (its longest text); null keys are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, project = encoder(tokenizer), directions(tokenizer, DIMS, 6)
        for batch in batches:
            sizes, points = [], np.zeros((batch.num_rows, DIMS))
            for i, value in enumerate(batch.column(1)):
                ids = enc.encode_ordinary(value.as_py() or "")
                sizes.append(len(ids))
                if ids:
                    term, count = np.unique(np.array(ids, np.int32), return_counts=True)
                    weight = np.sqrt(count)
                    points[i] = weight @ project[term] / np.sqrt(count.sum())
            # each coordinate is about standard normal, give or take its text's own terms: a logistic curve levels it
            cells = np.clip((1 / (1 + np.exp(-1.7 * points)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hilbert_keys(cells, BITS))], ["doc_id", "n_tokens", "key"])

    rows = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("t")).where(F.col("doc_id").isNotNull())
    counted = rows.mapInArrow(run, "doc_id long, n_tokens long, key long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "key")).alias("m")).select("doc_id", "m.n_tokens", "m.key")


class _Bins:
    """Open containers, found by the space left; items are opaque."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.limit = capacity, open_limit
        self.left: list[tuple[int, int]] = []
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> list | None:
        """Places the item; returns the items of a container that had to close, if one had to."""
        at = bisect_left(self.left, (size, -1))
        if at < len(self.left):
            free, name = self.left.pop(at)
        else:
            free, name = self.capacity, self.next
            self.next += 1
            self.items[name] = []
        self.items[name].append((size, item))
        if free > size:
            insort(self.left, (free - size, name))
        else:
            return self.items.pop(name)
        if len(self.left) > self.limit:
            return self.items.pop(self.left.pop(0)[1])
        return None


def _pack(sized: Iterator[tuple[int, tuple]], capacity: int, open_limit: int) -> Iterator[list]:
    bins = _Bins(capacity, open_limit)
    for size, item in sized:
        if (done := bins.put(size, item)) is not None:
            yield done
    rest = sorted((x for items in bins.items.values() for x in items), key=lambda x: (-x[0], x[1]))
    last = _Bins(capacity, len(rest) + 1)
    for size, item in rest:
        if (done := last.put(size, item)) is not None:
            yield done
    yield from last.items.values()


def pack(documents: DataFrame, capacity: int = CAPACITY, doc_key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, open_limit: int = OPEN) -> DataFrame:
    """(container_id, doc_id, piece_no, first_token, n_tokens): every document in exactly one container, in one piece, unless it has
    more than ``capacity`` tokens; then its pieces but the last have ``capacity`` tokens each. No container holds more than
    ``capacity``. A document without text takes no space but has its row. Empty input, no rows; repeated keys count once."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = materialise(measured(documents, doc_key, text, tokenizer), "measured")
    total, docs = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-int(total) // (capacity * CONTAINERS_PER_TASK)), -(-int(docs) // 1_000_000))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("long")))
    pieces = sizes.select("doc_id", "key", "n_tokens", piece.alias("piece_no"))
    pieces = pieces.select("doc_id", "key", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n"))
    mixed = F.xxhash64("doc_id").alias("mix")
    ordered = pieces.withColumn("mix", mixed).repartitionByRange(tasks, "key", "mix").sortWithinPartitions("key", "mix", "doc_id", "piece_no").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = 0

        def sized() -> Iterator[tuple[int, tuple]]:
            nonlocal part
            for pdf in batches:
                if len(pdf):
                    part = int(pdf["part"].iloc[0])
                for doc, no, first, n in zip(pdf["doc_id"].tolist(), pdf["piece_no"].tolist(), pdf["first_token"].tolist(), pdf["n"].tolist()):
                    yield n, (doc, no, first)

        held: list[tuple] = []
        for number, items in enumerate(_pack(sized(), capacity, open_limit)):
            held.extend(((part << 32) + number, doc, no, first, n) for n, (doc, no, first) in items)
            if len(held) >= 50_000:
                yield pd.DataFrame(held, columns=["container_id", "doc_id", "piece_no", "first_token", "n_tokens"])
                held = []
        yield pd.DataFrame(held, columns=["container_id", "doc_id", "piece_no", "first_token", "n_tokens"])

    return ordered.select("doc_id", "piece_no", "first_token", "n", "part").mapInPandas(run, "container_id long, doc_id long, piece_no long, first_token long, n_tokens long")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, used, free) of each container of pack()."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
