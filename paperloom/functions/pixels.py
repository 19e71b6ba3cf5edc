"""Pixel statistics of images, decoded with the standard library on the executors.

PNG with 8 bits a channel, not interlaced: grey, RGB, palette, each with or without alpha.  Other
content has no statistics, and the rules that need them pass.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
#: Pixels a side at which colours are counted; larger images are thinned to it, and so many colours are counted at most.
THUMBNAIL, MOST_COLORS = 100, 256
#: Pixels of an image at most; larger ones count as not decoded.
MOST_PIXELS = 50_000_000


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(grey: list[list[int]], mode: str) -> bytes:
    """Rows of grey levels as a PNG in mode L, RGB or P."""
    kind, repeat = {"L": (0, 1), "RGB": (2, 3), "P": (3, 1)}[mode]
    rows = b"".join(b"\0" + bytes(v for v in row for _ in range(repeat)) for row in grey)
    palette = _chunk(b"PLTE", bytes(v for v in range(256) for _ in range(3))) if mode == "P" else b""
    head = struct.pack(">IIBBBBB", len(grey[0]), len(grey), 8, kind, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + palette + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def _unfilter(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Scan lines with their filters undone."""
    line = width * channels
    raw = np.frombuffer(data, dtype=np.uint8)[: height * (line + 1)].reshape(height, line + 1)
    out, above = np.zeros((height, line), dtype=np.uint8), np.zeros(line, dtype=np.int64)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 1:
            row = np.cumsum(row.reshape(width, channels), axis=0).ravel() & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            for x in range(line):
                left = row[x - channels] if x >= channels else 0
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - channels] if x >= channels else 0
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                row[x] = (row[x] + guess) & 255
        out[y], above = row, row
    return out.reshape(height, width, channels)


def decode_png(content: bytes) -> tuple[str, np.ndarray, np.ndarray | None] | None:
    """Mode, pixels and palette; None if it is no PNG of the kinds above."""
    if not content.startswith(_SIGNATURE):
        return None
    at, data, palette, head = len(_SIGNATURE), [], None, None
    while at + 8 <= len(content):
        (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in _MODES or head[6] or not 0 < head[0] * head[1] <= MOST_PIXELS:
        return None
    mode, channels = _MODES[head[3]]
    return mode, _unfilter(zlib.decompress(b"".join(data)), head[0], head[1], channels), palette


def statistics(content: bytes) -> dict | None:
    """px_width, px_height, mode, n_colors (null above 256), grey_min, grey_max."""
    try:
        decoded = decode_png(content)
    except (ValueError, zlib.error, struct.error):
        return None
    if decoded is None:
        return None
    mode, px, palette = decoded
    height, width = px.shape[:2]
    if mode == "P":
        if palette is None:
            return None
        rgb = palette[np.minimum(px[:, :, 0], len(palette) - 1)]
    else:
        rgb = px[:, :, :3] if px.shape[2] >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    step = max(1, -(-max(height, width) // THUMBNAIL))
    colors = len(np.unique(rgb[::step, ::step].reshape(-1, 3), axis=0))
    grey = (rgb.astype(np.int64) @ np.array([299, 587, 114])) // 1000
    return {"mode": mode, "px_width": width, "px_height": height, "n_colors": colors if colors <= MOST_COLORS else None, "grey_min": int(grey.min()), "grey_max": int(grey.max())}


_STATS = T.StructType([T.StructField("mode", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("px_width", "px_height", "n_colors", "grey_min", "grey_max")]])


@F.pandas_udf(_STATS)
def _pixel_stats(contents: pd.Series) -> pd.DataFrame:
    names = [f.name for f in _STATS.fields]
    rows = [statistics(bytes(c)) if c is not None else None for c in contents]
    return pd.DataFrame({n: pd.array([r[n] if r else None for r in rows], dtype="string" if n == "mode" else "Int32") for n in names})


def pixel_stats(content: Column) -> Column:
    """Statistics of an image's bytes as a struct; its fields are null where it can't be decoded."""
    return _pixel_stats(content)
