"""Content-defined cuts by a gear rolling hash, for all bytes of a block of texts at once.

The gear hash is h = (h << 1) + G[byte]; the lowest w bits of it depend on the last w bytes only, and are the sum of G shifted by the
distance of each of those bytes. That sum is built by doubling (1, 2, 4, ... bytes), so no byte waits for the one before it.
"""

from __future__ import annotations

import numpy as np

from verdictframe.llm.common import _random_values

#: Bytes of the rolling window; a power of two.
WINDOW = 16
GEAR = (_random_values(256, 23) >> np.uint64(31)).astype(np.uint32)


def gear_hashes(buf: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each byte, the low bits of the gear hash of the `window` bytes that end there (fewer at the start of the buffer)."""
    h = GEAR[buf]
    w = 1
    with np.errstate(over="ignore"):
        while w < window:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))
            w *= 2
    return h


def cuts(buf: np.ndarray, off: np.ndarray, bits: int, longest: int, window: int = WINDOW) -> np.ndarray:
    """Ends of the chunks of all rows, ascending, with the end of every row that is not empty among them.

    A chunk ends where `bits` bits of the hash, the highest of those that the window decides, are zero, after the next whole UTF-8
    character; or, where that does not happen for `longest` bytes, after that many. A window that began before its row does not count,
    so rows are cut alike wherever they stand.
    """
    if not len(buf):
        return np.empty(0, np.int64)
    mask = np.uint32(((1 << bits) - 1) << (window - bits))
    at = np.flatnonzero((gear_hashes(buf, window) & mask) == 0) + 1
    begins = off[:-1][off[:-1] < off[1:]]
    row = np.searchsorted(begins, at - 1, side="right") - 1
    at = at[at - begins[row] >= window]
    for _ in range(3):  # not inside a character
        inside = at < len(buf)
        inside[inside] = (buf[at[inside]] & 0xC0) == 0x80
        at = at + inside
    at = np.union1d(at, off[1:][off[:-1] < off[1:]])
    begin = np.concatenate([[0], at[:-1]])
    length = at - begin
    long = np.flatnonzero(length > longest)
    if len(long):
        more = (length[long] - 1) // longest
        extra = np.repeat(begin[long], more) + longest * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
        for _ in range(3):
            inside = (buf[extra] & 0xC0) == 0x80
            extra = extra + inside * (extra + 1 < len(buf))
        at = np.union1d(at, extra)
    return at
