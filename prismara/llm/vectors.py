"""Vectors on executors: reading them from Arrow, bounded training samples, k-means, additive quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64
#: Most rows that the driver ever takes for training; everything else covers all rows.
SAMPLE = 32_768
#: Of these, rows that train codebooks; centres of cells are trained on all.
BOOK_SAMPLE = 8_192


def matrix(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors as float32) of the usable entries of a list column: ``dim`` finite components, not all zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    picked = column if len(rows) == len(column) else column.take(pa.array(rows))
    flat = picked.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)  # nulls become NaN
    scale = np.abs(values).max(1)
    good = np.isfinite(scale) & (scale > 0)
    if not good.all():
        rows, values, scale = rows[good], values[good], scale[good]
    values = values / scale[:, None]  # no overflow in the norm
    return rows, (values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]).astype(np.float32)


def unpack(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """Vectors from a binary column of little-endian float32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def pack(vectors: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(vectors, np.float32)
    width = data.shape[1] * 4
    offsets = pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, offsets, pa.py_buffer(data.tobytes())])


def sample(df: DataFrame, key: str, column: str, total: int, size: int = SAMPLE, dim: int = DIM) -> np.ndarray:
    """About ``size`` usable vectors as unit rows, chosen by a hash of their key: a bound on what the driver takes, whatever the table's size."""
    share = 1 << 24
    rate = share if total <= size else max(1, int(share * size / total))
    picked = df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(share)) < rate).select(F.col(column).alias("v"))
    table = picked.toArrow()
    if not table.num_rows:
        return np.zeros((0, dim), np.float32)
    return matrix(table.column(0).combine_chunks(), dim)[1]


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of Lloyd's algorithm from random members; an empty centre takes the member farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = x @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres)
        home = near.argmax(1)
        count = np.bincount(home, minlength=len(centres))
        order = np.argsort(home, kind="stable")
        filled = np.flatnonzero(count)
        starts = np.r_[0, np.cumsum(count[filled])[:-1]]
        centres[filled] = np.add.reduceat(x[order], starts, axis=0) / count[filled, None]
        if (empty := np.flatnonzero(count == 0)).size:
            far = np.argsort(near[np.arange(len(x)), home])[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


class Cells:
    """A division of the space by nearest centre."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.half = 0.5 * np.einsum("ij,ij->i", centres, centres)
        gram = centres @ centres.T
        self.apart = np.sqrt(np.maximum(2 * (self.half[:, None] + self.half[None, :] - gram), 1e-12)).astype(np.float32)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - self.half).argmax(1)

    def margins(self, x: np.ndarray, margin: float | np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row; then rows and cells of all rows that lie within ``margin`` of the border between home and cell)."""
        near = x @ self.centres.T - self.half
        home = near.argmax(1) if home is None else home
        inside = (near[np.arange(len(x)), home][:, None] - near) <= self.apart[home] * (margin if np.isscalar(margin) else margin[:, None])
        inside[np.arange(len(x)), home] = False
        rows, cells = np.nonzero(inside)
        return home, rows, cells


class Quantiser:
    """Additive quantisation: a vector is its cell's centre plus one word from each of several full-dimensional codebooks.

    The codebooks are first trained one after the other on residuals, then refitted together by least squares on beam-searched codes.
    """

    def __init__(self, cells: Cells, books: np.ndarray):
        self.cells, self.books = cells, books

    @classmethod
    def train(cls, x: np.ndarray, n_cells: int, n_books: int = 16, words: int = 64, seed: int = 4, beam: int = 4) -> Quantiser:
        cells = Cells(kmeans(x, n_cells, 8, seed))
        x = x[:BOOK_SAMPLE]  # the sample is in no order of content
        offset = x - cells.centres[cells.homes(x)]
        rest, books = offset.copy(), []
        for m in range(n_books):
            book = kmeans(rest, words, 5, seed + m)
            if len(book) < words:
                book = np.vstack([book, np.zeros((words - len(book), x.shape[1]), np.float32)])
            books.append(book)
            rest = rest - book[(rest @ book.T - 0.5 * np.einsum("ij,ij->i", book, book)).argmax(1)]
        out = cls(cells, np.stack(books).astype(np.float32))
        codes = out.encode(offset, beam)
        hot = np.zeros((len(x), n_books * words), np.float32)
        hot[np.arange(len(x))[:, None], codes.astype(np.int64) + np.arange(n_books) * words] = 1
        normal = (hot.T @ hot).astype(np.float64) + 1e-1 * np.eye(n_books * words)
        flat = out.books.reshape(n_books * words, -1).astype(np.float64)
        out.books = (flat + np.linalg.solve(normal, hot.T.astype(np.float64) @ (offset - hot @ out.books.reshape(n_books * words, -1)))).reshape(out.books.shape).astype(np.float32)
        return out

    def encode(self, offsets: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes (rows, books) of offsets from their cells' centres, by beam search."""
        m, k, d = self.books.shape
        out = np.empty((len(offsets), m), np.uint8)
        norms = np.einsum("mkd,mkd->mk", self.books, self.books)
        for s in range(0, len(offsets), 2048):
            rest = offsets[s : s + 2048][:, None, :].astype(np.float32)
            n = len(rest)
            cost = np.zeros((n, 1), np.float32)
            path = np.zeros((n, 1, 0), np.uint8)
            for b in range(m):
                width = rest.shape[1]
                total = cost[:, :, None] + norms[b] - 2 * (rest.reshape(-1, d) @ self.books[b].T).reshape(n, width, k)
                total = total.reshape(n, width * k)
                keep = 1 if b == m - 1 else min(beam, width * k)
                best = total.argmin(1)[:, None] if keep == 1 else np.argpartition(total, keep - 1, axis=1)[:, :keep]
                parent, word = best // k, best % k
                take = np.arange(n)[:, None]
                cost = total[take, best]
                path = np.concatenate([path[take, parent], word[:, :, None].astype(np.uint8)], 2)
                if b < m - 1:
                    rest = rest[take, parent] - self.books[b][word]
            out[s : s + 2048] = path[:, 0]
        return out

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.cells.centres[home].copy()
        for b in range(len(self.books)):
            out += self.books[b][codes[:, b]]
        return out
