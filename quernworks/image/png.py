"""PNG in and out without an image library: 8-bit gray, RGB and RGBA, palette on reading."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """(H, W), (H, W, 3) or (H, W, 4) bytes; booleans as 0 and 255."""
    if pixels.dtype == bool:
        pixels = pixels.astype(np.uint8) * 255
    pixels = np.ascontiguousarray(pixels, np.uint8)
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + pixels.size // max(height, 1)), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Pixel bytes of filtered rows.

    A pixel needs those left, above and above left of it, so all pixels of one place + row can be done
    together: the work is a few numpy steps for each diagonal, whatever filters the rows have.
    """
    methods, body = raw[:, 0], raw[:, 1:]
    if (methods > 4).any():
        raise ValueError(f"no such row filter: {methods.max()}")
    if not methods.any():
        return body
    width = stride // step
    filtered = body.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)  # with a zero row above and a zero pixel left
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_above, to_corner = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.choose(methods[y][:, None], [0, left, above, (left + above) >> 1, nearest])
        out[y + 1, x + 1] = (filtered[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, stride).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(H, W) for gray, (H, W, 3 or 4) for color; a palette is expanded."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, kind, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNGs that are not interlaced")
    n = _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfilter(raw, height, width * n, n).reshape(height, width, n)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, 0] if n <= 2 else pixels
