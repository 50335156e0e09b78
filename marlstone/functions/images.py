"""Facts about images from their first bytes, without an imaging library (PIP-06: width, height, format, alpha)."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are read; a JPEG whose frame header comes later has no known size.
HEAD = 1 << 18
FACTS = "format string, width int, height int, alpha boolean"


def _jpeg(b: bytes) -> tuple[int, int] | None:
    """Width and height in the first frame header among the segments."""
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without content
            at += 2
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _webp(b: bytes) -> tuple[int, int, bool] | None:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), bool(b[20] & 0x10)
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), bool(bits >> 28 & 1)
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF, False
    return None


def image_facts(b: bytes | None) -> dict | None:
    """format, width, height, alpha; None for anything but a PNG, JPEG, GIF, BMP or WebP with a readable header."""
    b = bytes(b or b"")
    made = lambda kind, width, height, alpha: {"format": kind, "width": width, "height": height, "alpha": alpha}
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 26:
        width, height = struct.unpack(">II", b[16:24])
        palette_alpha = b[25] in (0, 2, 3) and b"tRNS" in b.split(b"IDAT", 1)[0]
        return made("png", width, height, b[25] in (4, 6) or palette_alpha) if max(width, height) < 2**31 else None
    if b[:2] == b"\xff\xd8":
        size = _jpeg(b)
        return made("jpeg", *size, False) if size else None
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return made("gif", *struct.unpack("<HH", b[6:10]), False)
    if b[:2] == b"BM" and len(b) >= 30:
        width, height = struct.unpack("<ii", b[18:26])
        return made("bmp", width, abs(height), struct.unpack("<H", b[28:30])[0] == 32) if height > -(2**31) else None
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        size = _webp(b)
        return made("webp", *size) if size else None
    return None


def _facts(heads: pd.Series) -> pd.DataFrame:
    rows = [image_facts(b) or {} for b in heads]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=t) for c, t in (("format", object), ("width", "Int32"), ("height", "Int32"), ("alpha", "boolean"))})


def facts(content: Column) -> Column:
    """A struct of the image's facts. Only the first bytes of each content go to Python."""
    return F.pandas_udf(_facts, FACTS)(F.substring(content, 1, HEAD))
