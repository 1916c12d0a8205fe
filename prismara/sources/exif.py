"""EXIF of picture files: capture time and orientation, read from the bytes of JPEG, PNG, WebP and TIFF containers."""

from __future__ import annotations

import calendar
import json
import re
import struct
from collections.abc import Iterator

# The tags that are read.
ORIENTATION, EXIF_IFD, TAKEN = 0x0112, 0x8769, 0x9003
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_TIME = re.compile(rb"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)")


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG up to its picture data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def _chunks(data: bytes, at: int, order: str, padded: bool) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of the chunks of a PNG (size, kind, body, sum) or RIFF file (kind, size, body)."""
    while at + 8 <= len(data):
        if padded:
            kind, size = data[at : at + 4], struct.unpack(order + "I", data[at + 4 : at + 8])[0]
        else:
            size, kind = struct.unpack(order + "I", data[at : at + 4])[0], data[at + 4 : at + 8]
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (size % 2 if padded else 4)


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF block that holds a file's EXIF."""
    block = None
    if data[:2] == b"\xff\xd8":
        block = next((b for m, b in _segments(data) if m == 0xE1 and b[:4] == b"Exif"), None)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        block = next((b for k, b in _chunks(data, 8, ">", False) if k == b"eXIf"), None)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        block = next((b for k, b in _chunks(data, 12, "<", True) if k == b"EXIF"), None)
    elif data[:4] in (b"II*\0", b"MM\0*"):
        block = data
    return block[6:] if block and block[:6] == b"Exif\0\0" else block


def _entries(block: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag -> (type, count, bytes of the value) of a directory; what lies outside the block is left out."""
    out = {}
    if at + 2 > len(block):
        return out
    for i in range(struct.unpack_from(order + "H", block, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", block, p)
        size = _SIZES.get(kind, 0) * count
        start = p + 8 if size <= 4 else struct.unpack_from(order + "I", block, p + 8)[0]
        if size and start + size <= len(block):
            out.setdefault(tag, (kind, count, block[start : start + size]))
    return out


def _number(entry: tuple[int, int, bytes] | None, order: str) -> int | None:
    if entry is None or entry[0] not in (3, 4):
        return None
    return struct.unpack_from(order + ("H" if entry[0] == 3 else "I"), entry[2])[0]


def read(data: bytes) -> tuple[int | None, int | None]:
    """(capture time in epoch seconds, read as UTC; orientation from 1 to 8) of a file; None for what is not there, broken or no date."""
    block = tiff_block(data)
    if not block or block[:2] not in (b"II", b"MM") or len(block) < 8:
        return None, None
    order = "<" if block[:2] == b"II" else ">"
    first = _entries(block, order, struct.unpack_from(order + "I", block, 4)[0])
    orientation = _number(first.get(ORIENTATION), order)
    inner = _number(first.get(EXIF_IFD), order)
    taken = _entries(block, order, inner).get(TAKEN) if inner else None
    seconds = None
    if taken is not None and taken[0] == 2 and (m := _TIME.match(taken[2])):
        y, mo, d, h, mi, s = (int(x) for x in m.groups())
        if 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(max(y, 1), mo)[1] and h < 24 and mi < 60 and s < 60 and y:
            seconds = calendar.timegm((y, mo, d, h, mi, s))
    return seconds, orientation if orientation is not None and 1 <= orientation <= 8 else None


def as_json(taken: int | None, orientation: int | None) -> str | None:
    """JSON of the known fields, as scalars.exif_json writes it; None where neither is known."""
    known = {k: v for k, v in (("taken_at", taken), ("orientation", orientation)) if v is not None}
    return json.dumps(known, separators=(",", ":")) if known else None
