"""Baseline JPEG in numpy: a decoder for sequential files of 8 bits and an encoder. For libraries of any size a native codec belongs behind
the hook of prismara.sources.pixels; this one needs no dependency.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The standard's quantisation tables for brightness and colour, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99) + (99,) * 32
#: Places of a block in the order of the diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits by Huffman's rule; one code of the longest length stays free, as all ones is no code."""
    weights = {s: max(1, n) for s, n in counts.items()} | {-1: 0}  # -1 keeps the free code
    while True:
        heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
        heapq.heapify(heap)
        depth, n = dict.fromkeys(weights, 0), len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*x, *y):
                depth[s] += 1
            heapq.heappush(heap, (a + b, n, (*x, *y)))
            n += 1
        if max(depth.values()) <= 16:
            break
        weights = {s: (w + 1) // 2 if s >= 0 else 0 for s, w in weights.items()}  # flatter weights, shorter codes
    del depth[-1]  # the lightest, so among the longest, of which the last code stays free
    return depth


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes per length, symbols in order of code, symbol -> (code, length))."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, at, out = 0, 0, {}
    for s in order:
        code <<= lengths[s] - at
        at = lengths[s]
        out[s] = (code, at)
        code += 1
    return [sum(lengths[s] == n for s in order) for n in range(1, 17)], order, out


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, how many) of a quantised block in diagonal order; the first symbol is that of the mean."""

    def sized(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    n, bits = sized(block[0] - before)
    out, run = [(n, bits, n)], 0
    last = max((i for i in range(1, 64) if block[i]), default=0)
    for v in block[1 : last + 1]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append((0xF0, 0, 0))
            run -= 16
        n, bits = sized(v)
        out.append((run << 4 | n, bits, n))
        run = 0
    if last < 63:
        out.append((0, 0, 0))
    return out


def encode(pixels: np.ndarray, quality: int = 80) -> bytes:
    """A baseline JPEG of (height, width, 3) bytes, colour at full size, with Huffman codes fitted to the picture."""
    h, w = pixels.shape[:2]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (LUMA, CHROMA)]
    ycc = pixels.astype(np.float64) @ _TO_YCC.T
    ycc[:, :, 0] -= 128
    ycc = np.pad(ycc, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    bh, bw = ycc.shape[0] // 8, ycc.shape[1] // 8
    planes = []
    for c in range(3):
        blocks = ycc[:, :, c].reshape(bh, 8, bw, 8).transpose(0, 2, 1, 3)
        flat = np.rint((_DCT @ blocks @ _DCT.T).reshape(-1, 64) / tables[c > 0]).astype(np.int64)
        planes.append(flat[:, ZIGZAG].tolist())
    before, stream = [0, 0, 0], []
    counts: list[dict[int, int]] = [{}, {}, {}, {}]  # means and others, of brightness and of colour
    for i in range(bh * bw):
        for c in range(3):
            for k, (s, bits, n) in enumerate(_symbols(planes[c][i], before[c])):
                kind = 2 * (c > 0) + (k > 0)
                counts[kind][s] = counts[kind].get(s, 0) + 1
                stream.append((kind, s, bits, n))
            before[c] = planes[c][i][0]
    made = [_codes(_lengths(n)) for n in counts]
    parts = []
    for kind, s, bits, n in stream:
        code, length = made[kind][2][s]
        parts.append(format(code, f"0{length}b"))
        if n:
            parts.append(format(bits, f"0{n}b"))
    text = "".join(parts)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") if text else b""
    segment = lambda marker, data: struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i, t in enumerate(tables):
        out += segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for kind, (sizes, order, _) in enumerate(made):
        out += segment(0xC4, bytes([(kind % 2) << 4 | kind // 2]) + bytes(sizes) + bytes(order))
    return out + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


class _Bits:
    """The bits of picture data between restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self) -> int:
        """The next 16 bits, ones beyond the end."""
        while self.n < 16:
            more = self.data[self.at : self.at + 6]
            self.at += 6
            self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(more.ljust(6, b"\xff"), "big")
            self.n += 48
            if self.at > len(self.data) + 64:
                raise ValueError("cut off")
        return self.held >> (self.n - 16) & 0xFFFF

    def take(self, n: int) -> int:
        value = self.peek() >> (16 - n)
        self.n -= n
        return value

    def symbol(self, table: list[tuple[int, int] | None]) -> int:
        found = table[self.peek()]
        if found is None:
            raise ValueError("code")
        self.n -= found[0]
        return found[1]

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _table(sizes: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """(length, symbol) for every 16 bits that a code may begin."""
    out: list[tuple[int, int] | None] = []
    at = 0
    for length, n in enumerate(sizes, 1):
        for s in symbols[at : at + n]:
            out += [(length, s)] * (1 << (16 - length))
        at += n
    return (out + [None] * 65_536)[:65_536]


def decode(data: bytes, most: int = 512 * 1024 * 1024, edge: int = 16_384) -> np.ndarray:
    """(height, width, 3) bytes of a sequential JPEG of 8 bits with one or three components; ValueError for anything else and for sizes beyond
    ``edge`` or ``most`` bytes."""
    quant, huff, frame, restart, at = {}, {}, None, 0, 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("segment")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide == 128 else np.uint8).astype(np.float64)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, h, w, count = struct.unpack(">BHHB", body[:6])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            if depth != 8 or count not in (1, 3) or not 0 < h <= edge or not 0 < w <= edge or h * w * 3 > most:
                raise ValueError("frame")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not sequential")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("scan")
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    high, wide = max(f[2] for f in frame), max(f[1] for f in frame)
    if len(frame) == 1:
        frame, high, wide = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
    rows, cols = -(-h // (8 * high)), -(-w // (8 * wide))
    blocks = [np.zeros((rows * v, cols * u, 64), np.float64) for _, u, v, _ in frame]
    pieces = _pieces(data[at:])
    done, bits, before = 0, None, []
    for y in range(rows):
        for x in range(cols):
            if bits is None or (restart and done % restart == 0):
                bits, before = _Bits(next(pieces)), [0] * len(frame)
            done += 1
            for c, (name, u, v, _) in enumerate(frame):
                dc, ac = huff[used[name] >> 4], huff[0x10 | used[name] & 15]
                for dy in range(v):
                    for dx in range(u):
                        block = blocks[c][y * v + dy, x * u + dx]
                        before[c] += bits.value(bits.symbol(dc))
                        block[0] = before[c]
                        k = 1
                        while k < 64:
                            s = bits.symbol(ac)
                            if s & 15:
                                k += s >> 4
                                if k > 63:
                                    raise ValueError("block")
                                block[k] = bits.value(s & 15)
                                k += 1
                            elif s == 0xF0:
                                k += 16
                            else:
                                break
    back = np.argsort(ZIGZAG)
    planes = []
    for (_, u, v, q), b in zip(frame, blocks):
        flat = (b * quant[q])[:, :, back].reshape(*b.shape[:2], 8, 8)
        plane = (_DCT.T @ flat @ _DCT).transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(plane.repeat(high // v, 0).repeat(wide // u, 1)[:h, :w])
    if len(planes) == 1:
        return np.repeat(np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)[:, :, None], 3, 2)
    ycc = np.stack([planes[0] + 128, planes[1], planes[2]], -1)
    return np.clip(np.rint(ycc @ np.linalg.inv(_TO_YCC).T), 0, 255).astype(np.uint8)


def _pieces(data: bytes):
    """Picture data between restart markers, up to any other marker, without stuffed bytes."""
    begin, at = 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            yield data[begin:].replace(b"\xff\0", b"\xff")
            return
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            yield data[begin:at].replace(b"\xff\0", b"\xff")
            begin = at = at + 2
        else:
            yield data[begin:at].replace(b"\xff\0", b"\xff")
            return
