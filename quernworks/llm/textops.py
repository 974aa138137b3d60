"""Vectorised work on the bytes of Arrow string columns: words, lines, hashes of both, windows.

Everything here looks at whole texts. Texts are laid end to end in one byte buffer, as Arrow keeps
them, and a chunk of texts is worked on with a fixed number of numpy passes, so the cost does not
depend on how many texts a chunk holds. Hashes are deterministic and the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_S31, _S27, _S32, _S3 = np.uint64(31), np.uint64(27), np.uint64(32), np.uint64(3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> _S32)) * _B
    x ^= x >> _S27
    x *= _C
    x ^= x >> _S31
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts; the order matters."""
    return mix(a * _A + (b ^ (b >> _S31)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def given_back() -> None:
    """Returns what a worker has freed to the system: the worker lives on beside the JVM, between its tasks too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes each, or one longer text."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def hash_slices(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of buf[starts:starts+lens], eight bytes of all slices at a time."""
    n = len(starts)
    h = mix(lens.astype(np.uint64) * _A + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    if not n:
        return h
    padded = np.empty(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    padded[len(buf) :] = 0
    view = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    at, rem = starts.astype(np.int64), lens.astype(np.int64)
    live = None
    while True:
        keep = rem > 0
        if not keep.all():
            live = np.flatnonzero(keep) if live is None else live[keep]
            at, rem = at[keep], rem[keep]
        if not len(at):
            return h
        block = view[at]
        short = rem < 8
        if short.any():
            drop = (np.uint64(8) - rem[short].astype(np.uint64)) << _S3
            block[short] = (block[short] << drop) >> drop
        if live is None:
            h = mix(h ^ (block * _A))
        else:
            h[live] = mix(h[live] ^ (block * _A))
        at, rem = at + 8, rem - 8


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a chunk of texts.

    starts, ends: byte positions in buf; bounds: the words of text i are bounds[i]:bounds[i+1];
    doc: each word's text.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> None:
        self.buf = LOWER[buf] if lower else buf
        self.offs = offs
        n, n_docs = len(buf), len(offs) - 1
        full = ~SPACE[buf]
        first, last = full.copy(), full.copy()
        if n:
            first[1:] &= ~full[:-1]
            last[:-1] &= ~full[1:]
            heads = offs[:-1][offs[:-1] < offs[1:]]
            first[heads] = full[heads]
            tails = offs[1:][offs[:-1] < offs[1:]] - 1
            last[tails] = full[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(n_docs), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_slices(self.buf, self.starts, self.ends - self.starts, seed)

    def left(self) -> np.ndarray:
        """Words of its text from each word on, itself included."""
        return self.bounds[1:][self.doc] - np.arange(len(self.doc))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items of h, made by doubling: len(h)-k+1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, length, power, at = None, 0, h, 1
    while at <= k:
        if k & at:
            part = power[length : length + n]
            out = part.copy() if out is None else join2(out, part)
            length += at
        if 2 * at <= k:
            power = join2(power[: len(power) - at], power[at:])
        at *= 2
    return mix(out ^ np.uint64(k))


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minima of all runs of k items of h."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    at = 1
    while 2 * at <= k:
        h = np.minimum(h[:-at], h[at:])
        at *= 2
    return np.minimum(h[:n], h[k - at : k - at + n])


def char_counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each slice of valid UTF-8."""
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    return heads[ends] - heads[starts]


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all texts, and how many each text has; an empty text has one."""
    n = len(offs) - 1
    breaks = np.flatnonzero(buf == 0x0A)
    count = np.diff(np.searchsorted(breaks, offs)) + 1
    last = np.cumsum(count) - 1
    starts = np.empty(count.sum(), np.int64)
    ends = np.empty_like(starts)
    inner = np.ones(len(starts), bool)
    inner[last] = False
    ends[inner], ends[last] = breaks, offs[1:]
    first = last - count + 1
    inner[:] = True
    inner[first] = False
    starts[inner], starts[first] = breaks + 1, offs[:-1]
    assert len(count) == n
    return starts, ends, count
