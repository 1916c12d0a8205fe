"""Cutting documents above a token limit into overlapping pieces at natural boundaries.

Lexical cohesion. At every line end the ``BLOCK`` tokens before and after are compared by the cosine of their hashed term vectors; the
depth of a valley in that curve says how much the topic changes there. A piece ends at the deepest valley of its size window (the
second half of the room it has), where the end of a message or file, of a hunk, of a paragraph adds to the depth, in that order. In a
window without a line end the valleys at sentence ends count, without these those between words; a window without any is cut between
tokens.

Consecutive pieces share ``overlap`` tokens: each piece but the first begins that much before the cut. Texts are cut where they are
read; keys are counted first, and only texts of repeated keys are shuffled, to settle on one; work in a document grows in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.tokens import TOKENIZER, byte_lengths, directions, encoder
from prismara.storage import materialise

LIMIT, OVERLAP = 512, 64
BLOCK = 96
DIMS = 32
NEAR = 6
# What the end of a message or file, of a hunk, of a paragraph adds to the depth of a valley (0 to 2).
FILE, HUNK, PARAGRAPH = 0.9, 0.6, 0.3
#: Tokens by which a piece cut from a longer text may differ from its slice of that text's tokens: pieces this close are counted anew.
EDGE = 8
#: Most repeated keys sent to every task; beyond, a shuffled join.
SENT = 1_000_000
_SENTENCE = re.compile(rb"[.!?;](?=[ \t])|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")


class Cutter:
    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER):
        if not 0 <= overlap < limit // 2:
            raise ValueError("overlap must be at least 0 and less than half the limit")
        if limit < 16:
            raise ValueError("limit must be at least 16")
        self.limit, self.overlap = limit, overlap
        self.enc, self.lengths = encoder(tokenizer), byte_lengths(tokenizer)
        self.terms = np.sign(directions(tokenizer, DIMS, 8)).astype(np.float32)

    def pieces(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(start, new_from, end, n_tokens, text) of each piece, offsets in code points; text is new from new_from on, and the new
        parts of all pieces make up the text. Empty for a text within the limit."""
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) <= self.limit:
            return []
        ids = np.array(self.enc.encode_ordinary(text), np.int64)
        n = len(ids)
        if n <= self.limit:
            return []
        at = np.r_[0, np.cumsum(self.lengths[ids])]  # byte at which each token begins
        data = np.frombuffer(raw, np.uint8)
        whole = np.r_[(data[at[:-1]] & 0xC0) != 0x80, True]  # tokens that begin with a character
        sums = np.zeros((n + 1, DIMS), np.float32)
        np.cumsum(self.terms[ids], axis=0, out=sums[1:])
        places = [self._lines(raw, data, sums, at, whole), None, None]  # tokens and depths of lines, sentences, words, when they are needed

        def kinds(kind: int) -> tuple[np.ndarray, np.ndarray]:
            if places[kind] is None:
                if kind == 1:
                    token = self._tokens_at([m.end() for m in _SENTENCE.finditer(raw)], at, whole)
                else:
                    token = np.flatnonzero(whole[:-1] & ((data[at[:-1]] == 32) | (data[at[:-1]] == 10)))[1:]
                places[kind] = token, self._depths(token, sums, NEAR if kind == 1 else BLOCK)
            return places[kind]

        out, cut, cut_char, begin = [], 0, 0, 0
        while True:
            room = begin + self.limit  # beyond the last token that fits
            if n - begin <= self.limit and self._fits(raw, at, begin, n):
                end = n
            else:
                end = self._end(cut, min(room, n - 1), kinds, whole)
                while not self._fits(raw, at, begin, end):
                    end = self._end(cut, max(cut + 1, min(end - 1, room - EDGE)), kinds, whole)
            piece, new = raw[at[begin] : at[end]].decode("utf-8", "surrogatepass"), raw[at[cut] : at[end]].decode("utf-8", "surrogatepass")
            out.append((cut_char - (len(piece) - len(new)), cut_char, cut_char + len(new), int(end - begin), piece))
            if end == n:
                return out
            cut, cut_char = end, cut_char + len(new)
            begin = max(0, cut - self.overlap)
            while not whole[begin]:
                begin -= 1

    def _fits(self, raw: bytes, at: np.ndarray, begin: int, end: int) -> bool:
        if end - begin <= self.limit - EDGE:
            return True
        return len(self.enc.encode_ordinary(raw[at[begin] : at[end]].decode("utf-8", "surrogatepass"))) <= self.limit

    def _tokens_at(self, offsets: list[int], at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The tokens that begin at byte offsets, or hold them; each once, in order."""
        if not offsets:
            return np.zeros(0, np.int64)
        token = np.searchsorted(at, np.array(offsets, np.int64), "right") - 1
        token = np.unique(token)
        return token[(token > 0) & (token < len(at) - 1) & whole[token]]

    def _depths(self, token: np.ndarray, sums: np.ndarray, near: int) -> np.ndarray:
        """The depth of the cohesion valley at each of these tokens, below the highest of ``near`` places on either side."""
        if not len(token):
            return np.zeros(0)
        before = sums[token] - sums[np.maximum(token - BLOCK, 0)]
        after = sums[np.minimum(token + BLOCK, len(sums) - 1)] - sums[token]
        like = np.einsum("ij,ij->i", before, after) / np.maximum(np.linalg.norm(before, axis=1) * np.linalg.norm(after, axis=1), 1e-6)
        peaks = np.lib.stride_tricks.sliding_window_view(np.pad(like, near, mode="edge"), near + 1).max(1)
        return (peaks[: len(like)] - like) + (peaks[near : near + len(like)] - like)

    def _lines(self, raw: bytes, data: np.ndarray, sums: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that begin a line, and for each the depth of the cohesion valley there plus what its kind of boundary adds."""
        ends = np.flatnonzero(data == 10) + 1
        ends = ends[ends < len(data)]
        token = np.searchsorted(at, ends, "right") - 1
        first = np.r_[True, token[1:] != token[:-1]][: len(token)] & (token > 0) & whole[token]
        token, ends = token[first], ends[first]
        depth = self._depths(token, sums, NEAR)
        head = data[ends]
        for i in np.flatnonzero((head == ord("d")) | (head == ord("@"))):
            p = ends[i]
            if raw[p : p + 11] == b"diff --git ":
                depth[i] += FILE
            elif raw[p : p + 3] == b"@@ ":
                depth[i] += HUNK
        depth[(head == 10) | (data[np.maximum(ends - 2, 0)] == 10)] += PARAGRAPH
        return token, depth

    def _end(self, cut: int, room: int, kinds, whole) -> int:
        """The token before which a piece with new text from ``cut`` on and room up to ``room`` ends."""
        floor = cut + max(1, (room - cut) // 2)
        for kind in range(3):
            token, depth = kinds(kind)
            a, b = np.searchsorted(token, floor), np.searchsorted(token, room, "right")
            if b > a:
                return int(token[a + int(np.argmax(depth[a:b]))])
        end = room
        while end > cut + 1 and not whole[end]:
            end -= 1
        if not whole[end]:  # one character of many tokens
            end = cut + 1
            while not whole[end]:
                end += 1
        return end


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, doc_key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, start, new_from, end, n_tokens, text) of every document with more than ``limit`` tokens.

    start, new_from and end are code points of the document; a piece has at most ``limit`` tokens when tokenised by itself, and
    n_tokens is its share of the document's tokens. Documents within the limit, null and empty texts and null keys give no rows; a
    repeated key gives the pieces of its longest text once. Empty input, no rows.
    """
    Cutter(limit, overlap, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(limit, overlap, tokenizer)
        names = ["doc_id", "piece_no", "start", "new_from", "end", "n_tokens", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for no, piece in enumerate(cutter.pieces(value.as_py())):
                    rows.append((doc, no, *piece))
                    held += len(piece[4])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("t")).where(F.col("doc_id").isNotNull() & (F.octet_length("t") > limit))
    marks = rows.select("doc_id", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h")).groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.struct("n", "h")).alias("first"))
    repeated = materialise(marks.where("rows > 1").select("doc_id", "first"), "repeated")
    keys = F.broadcast(repeated) if repeated.count() <= SENT else repeated
    again = rows.join(keys, "doc_id").where(F.struct(F.octet_length("t").alias("n"), F.xxhash64("t").alias("h")) == F.col("first"))
    rows = rows.join(keys.select("doc_id"), "doc_id", "left_anti").unionByName(again.groupBy("doc_id").agg(F.min("t").alias("t")))
    return rows.mapInArrow(run, "doc_id long, piece_no long, start long, new_from long, `end` long, n_tokens long, text string")
