"""What the headers of picture files say, read from the first bytes of their content: width and height, and when they were taken."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of JPEG without a length; those that tell a frame's size; tags of dates and of the table that holds the original one.
STANDALONE = {0x00, 0xD8, *range(0xD0, 0xD8)}
FRAME_MARKERS = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
DATE_TIME, EXIF_TABLE, DATE_ORIGINAL = 0x0132, 0x8769, 0x9003
MOST_ENTRIES = 512


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments of a JPEG file; bytes between them are passed over."""
    at = 2
    while (at := data.find(b"\xff", at)) >= 0:
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data) or data[at] == 0xD9:
            return
        marker, at = data[at], at + 1
        if marker in STANDALONE:
            continue
        if at + 2 > len(data) or (length := int.from_bytes(data[at : at + 2], "big")) < 2:
            return
        yield marker, at + 2, at + length
        at += length


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG file; None for others and for sizes that are not positive."""
    found = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        found = struct.unpack(">ii", data[16:24])
    elif data[:3] == b"GIF" and len(data) >= 10:
        found = struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM" and len(data) >= 26:
        wide, high = struct.unpack("<ii", data[18:26])
        found = wide, abs(high)
    elif data[:2] == b"\xff\xd8":
        at = next((start for marker, start, _ in _segments(data) if marker in FRAME_MARKERS), None)
        if at is not None and at + 5 <= len(data):
            found = struct.unpack(">HH", data[at + 1 : at + 5])[::-1]
    return found if found and min(found) > 0 else None


def _chunks(data: bytes, at: int, order: str, name_first: bool, padding: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(data):
        name, length = (data[at : at + 4], data[at + 4 : at + 8]) if name_first else (data[at + 4 : at + 8], data[at : at + 4])
        n = int.from_bytes(length, order)
        yield name, data[at + 8 : at + 8 + n]
        at += 8 + n + (padding if not name_first else n & 1)


def _exif(data: bytes) -> bytes | None:
    """The EXIF block of a TIFF, JPEG, PNG or WebP file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        for marker, start, end in _segments(data):
            if marker == 0xDA:
                return None
            if marker == 0xE1 and data[start : start + 6] == b"Exif\0\0":
                return data[start + 6 : end]
    elif data[:4] == b"\x89PNG":
        for name, body in _chunks(data, 8, "big", False, 4):
            if name in (b"IDAT", b"IEND"):
                return None
            if name == b"eXIf":
                return body
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return next((body.removeprefix(b"Exif\0\0") for name, body in _chunks(data, 12, "little", True, 0) if name == b"EXIF"), None)
    return None


def date_text(data: bytes) -> str | None:
    """The date of the original, or else the date of change, as the file writes it ("2023:11:05 20:53:59")."""
    block = _exif(data)
    if block is None or block[:2] not in (b"II", b"MM"):
        return None
    mark = "<" if block[:2] == b"II" else ">"

    def entries(at: int) -> dict[int, tuple[int, int, bytes]]:
        if at + 2 > len(block):
            return {}
        (n,) = struct.unpack_from(mark + "H", block, at)
        # the first entry of a tag counts; a table of too many is broken
        places = [at + 2 + 12 * i for i in range(n if n <= MOST_ENTRIES else 0) if at + 14 + 12 * i <= len(block)]
        read = [struct.unpack_from(mark + "HHI", block, p) + (block[p + 8 : p + 12],) for p in places]
        return {tag: (kind, count, value) for tag, kind, count, value in reversed(read)}

    def text(entry: tuple[int, int, bytes] | None) -> str | None:
        if entry is None or entry[0] != 2 or not entry[1]:
            return None
        at = struct.unpack(mark + "I", entry[2])[0]
        raw = entry[2][: entry[1]] if entry[1] <= 4 else block[at : at + entry[1]]
        return raw.decode("ascii", "replace").strip("\0 ") if len(raw) == entry[1] else None

    if len(block) < 8 or struct.unpack_from(mark + "H", block, 2)[0] != 42:
        return None
    first = entries(struct.unpack_from(mark + "I", block, 4)[0])
    inner = first.get(EXIF_TABLE)
    original = text(entries(struct.unpack(mark + "I", inner[2])[0]).get(DATE_ORIGINAL)) if inner and inner[0] in (3, 4) else None
    return original if original is not None else text(first.get(DATE_TIME))


def _image_size(content: pd.Series) -> pd.DataFrame:
    found = [None if c is None else size_of(bytes(c)) for c in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def image_size(content: Column) -> Column:
    """(width, height) by a file's header, both null for what it does not tell. The content may be cut after the headers."""
    return F.pandas_udf(_image_size, "width int, height int")(content)


def _date_taken(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else date_text(bytes(c)) for c in content], dtype=object)


def date_taken(content: Column) -> Column:
    """When a picture was taken, by its EXIF block; null if it has none or none that is a date."""
    return F.try_to_timestamp(F.pandas_udf(_date_taken, "string")(content), F.lit("yyyy:MM:dd HH:mm:ss"))
