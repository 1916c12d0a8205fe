"""Pictures as arrays: a codec hook, thumbnails, model input, structural features. All of it runs in Arrow batches on executors.

The built-in codec needs no library: it reads baseline JPEG, 8-bit PNG and PPM and writes JPEG. WebP, HEIF and progressive JPEG are told by
their first bytes and refused unless ``Codecs`` has a codec for them: any object with ``decode(bytes) -> Picture``. A codec may decode
a smaller picture that the file carries (of ``THUMB_SIDE`` and more) and name the original's size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prismara.sources import exif, jpeg

# Fixed values of picture limits and of the model input.
EDGE_MOST = 16_384
BYTES_MOST = 512 * 1024 * 1024
THUMB_QUALITY = 80
THUMB_SIDE = 384
INPUT_SIDE = 224
MEAN = np.array([0.48145466, 0.4578275, 0.40821073])
STD = np.array([0.26862954, 0.26130258, 0.27577711])


@dataclass
class Picture:
    """Decoded pixels (height, width, 3), uint8, and the size of the original, which may be larger."""

    pixels: np.ndarray
    width: int
    height: int
    mime: str


class Codec(Protocol):
    def decode(self, data: bytes) -> Picture: ...

    def encode(self, pixels: np.ndarray) -> bytes: ...


def sniffed(data: bytes) -> str | None:
    """The type of a picture file by its first bytes."""
    if data[:3] == b"\xff\xd8\xff":
        return "image/jpeg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1", b"avif"):
        return "image/heic"
    return "image/x-portable-pixmap" if data[:2] == b"P6" else None


class PlainCodec:
    """Baseline JPEG, P6 and 8-bit grey, RGB or RGBA PNG without interlacing; encodes JPEG."""

    def decode(self, data: bytes) -> Picture:
        kind = sniffed(data)
        if kind == "image/x-portable-pixmap":
            fields = data.split(maxsplit=4)
            width, height, top = (int(x) for x in fields[1:4])
            if top != 255:
                raise ValueError("depth")
            return self._checked(np.frombuffer(data[len(data) - width * height * 3 :], np.uint8).reshape(height, width, 3), kind)
        if kind == "image/png":
            return self._checked(self._png(data), kind)
        if kind == "image/jpeg":
            return self._checked(jpeg.decode(data, BYTES_MOST, EDGE_MOST), kind)
        raise ValueError(f"no codec for {kind}")

    @staticmethod
    def _checked(pixels: np.ndarray, mime: str) -> Picture:
        if max(pixels.shape[:2]) > EDGE_MOST or min(pixels.shape[:2]) < 1:
            raise ValueError("size")
        return Picture(pixels, pixels.shape[1], pixels.shape[0], mime)

    @staticmethod
    def _png(data: bytes) -> np.ndarray:
        at, packed, head = 8, b"", None
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed += body
            at += size + 12
        if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 6) or max(head[:2]) > EDGE_MOST or head[0] * head[1] * 3 > BYTES_MOST:
            raise ValueError("png")
        channels = {0: 1, 2: 3, 6: 4}[head[3]]
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head[1], head[0] * channels + 1)
        out = np.zeros((head[1], head[0] * channels), np.uint8)
        above = np.zeros(head[0] * channels, np.int64)
        for y in range(head[1]):
            line = rows[y, 1:].astype(np.int64)
            kind = rows[y, 0]
            if kind == 1:
                line = (np.cumsum(line.reshape(-1, channels), axis=0) % 256).ravel()
            elif kind == 2:
                line = (line + above) % 256
            elif kind in (3, 4):
                for x in range(len(line)):
                    left = line[x - channels] if x >= channels else 0
                    corner = above[x - channels] if x >= channels else 0
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        p = left + above[x] - corner
                        guess = min((left, above[x], corner), key=lambda c: abs(p - c))
                    line[x] = (line[x] + guess) % 256
            out[y], above = line, line
        pixels = out.reshape(head[1], head[0], channels)
        return np.repeat(pixels, 3, axis=2) if channels == 1 else np.ascontiguousarray(pixels[:, :, :3])

    def encode(self, pixels: np.ndarray) -> bytes:
        return jpeg.encode(pixels, THUMB_QUALITY)


class Codecs:
    """Codecs by type, e.g. {"image/heic": ...}, before the built-in one."""

    def __init__(self, codecs: dict[str, Codec], rest: Codec | None = None):
        self.codecs, self.rest = codecs, rest or PlainCodec()

    def decode(self, data: bytes) -> Picture:
        return self.codecs.get(sniffed(data), self.rest).decode(data)

    def encode(self, pixels: np.ndarray) -> bytes:
        return self.rest.encode(pixels)


def ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def oriented(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels turned upright by an EXIF orientation from 1 to 8; other values change nothing."""
    turns = {3: (2, False), 6: (3, False), 8: (1, False), 2: (0, True), 4: (2, True), 5: (3, True), 7: (1, True)}
    quarter, mirror = turns.get(orientation or 1, (0, False))
    out = pixels[:, ::-1] if mirror and quarter != 3 and quarter != 1 else pixels
    if mirror and quarter in (1, 3):
        out = np.rot90(pixels, quarter)[:, ::-1]
        return np.ascontiguousarray(out)
    return np.ascontiguousarray(np.rot90(out, quarter))


def fitted_size(width: int, height: int, side: int = THUMB_SIDE) -> tuple[int, int]:
    longest = max(width, height)
    if longest <= side:
        return width, height
    return _rounded(width * (side / longest)), _rounded(height * (side / longest))


def _rounded(size: float) -> int:
    """Halves away from zero, at least one pixel."""
    return max(1, int(np.floor(size + 0.5)))


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _weights(source: int, target: int) -> np.ndarray:
    scale = source / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    w = _cubic((np.arange(source)[None, :] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Catmull-Rom resampling, with the kernel widened when the picture shrinks."""
    rows = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    both = np.einsum("wx,hxc->hwc", _weights(pixels.shape[1], width), rows)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def model_input(pixels: np.ndarray, side: int = INPUT_SIDE, crop: bool = True) -> np.ndarray:
    """(3, height, width) float32: shortest edge to ``side``, centre crop, scaled by mean and deviation per channel."""
    h, w = pixels.shape[:2]
    scale = side / min(h, w)
    nw, nh = (side, _rounded(h * scale)) if w <= h else (_rounded(w * scale), side)
    out = resized(pixels, nw, nh)
    if crop:
        top, left = (nh - side) // 2, (nw - side) // 2
        out = out[max(0, top) : max(0, top) + side, max(0, left) : max(0, left) + side]
    return ((out / 255.0 - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def crop(pixels: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray | None:
    """Pixels of a box (x0, y0, x1, y1); None if it holds none."""
    part = pixels[max(0, box[1]) : box[3], max(0, box[0]) : box[2]]
    return np.ascontiguousarray(part) if part.size else None


def _pooled(grey: np.ndarray, side: int) -> np.ndarray:
    rows = [c.mean(0) for c in np.array_split(grey, side, axis=0)] if grey.shape[0] >= side else list(grey[np.arange(side) * grey.shape[0] // side])
    stacked = np.stack(rows)
    cols = [c.mean(1) for c in np.array_split(stacked, side, axis=1)] if grey.shape[1] >= side else list(stacked[:, np.arange(side) * grey.shape[1] // side].T)
    return np.stack(cols, 1)


def structure(pixels: np.ndarray) -> np.ndarray:
    """86 numbers: low frequencies of the brightness (8 by 8, log magnitudes that sum to 8), its layout (4 by 4, half weight), mean and
    deviation of each colour."""
    grey = pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    small = _pooled(grey, 32)
    low = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(small))))[12:20, 12:20].ravel()
    flat = pixels.reshape(-1, 3) / 255.0
    return np.concatenate([low / (low.sum() + 1e-6) * 8, _pooled(small, 4).ravel() / 255 * 0.5, flat.mean(0), flat.std(0)])


def decoded(files: DataFrame, codec: Codec | None = None, thumb_side: int = THUMB_SIDE) -> DataFrame:
    """(sha256, width, height, mime, thumb, exif, exif_taken, error_code) of rows (sha256, content): one decode per distinct content, turned
    upright by its EXIF orientation, of which width and height speak, too; what does not decode is an error row."""
    used = codec or PlainCodec()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for sha, content in zip(pdf["sha256"], pdf["content"]):
                try:
                    data = bytes(content)
                    p = used.decode(data)
                    taken, orientation = exif.read(data)
                    upright = oriented(p.pixels, orientation)
                    width, height = (p.height, p.width) if orientation in (5, 6, 7, 8) else (p.width, p.height)
                    w, h = fitted_size(width, height, thumb_side)
                    small = upright if (w, h) == (upright.shape[1], upright.shape[0]) else resized(upright, w, h)
                    out.append((sha, width, height, p.mime, used.encode(small), exif.as_json(taken, orientation), taken, None))
                except Exception:  # noqa: BLE001  any broken file is a row, not a failed job
                    out.append((sha, None, None, None, None, None, None, "decode_failed"))
            frame = pd.DataFrame(out, columns=["sha256", "width", "height", "mime", "thumb", "exif", "exif_taken", "error_code"])
            yield frame.astype({"width": "Int32", "height": "Int32", "exif_taken": "Int64"})

    schema = "sha256 string, width int, height int, mime string, thumb binary, exif string, exif_taken long, error_code string"
    return files.dropDuplicates(["sha256"]).select("sha256", "content").mapInPandas(run, schema)
