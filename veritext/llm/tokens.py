"""Hashes of words and word windows, vectorised over many texts.

Words are maximal runs of bytes other than space and 0x09-0x0D (the UTF-8
bytes of ``[^\\x20\\x09-\\x0D]+``).  A word is hashed eight bytes at a time,
each step mixed through all 64 bits, so no arrangement of a few letters makes
two words agree as it does for a polynomial modulo 2**64; ``seed`` gives
independent hashes.  A window's hash is rolled up from those of its halves, in
the same non-linear way."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20  # bytes of text hashed at a time: bounds the temporaries

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


# odd multipliers and the starts of the seeds: any fixed random numbers
ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F], np.uint64)
STARTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def lanes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number (zeros behind the end)."""
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    return np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))


def cut_lane(lane: np.ndarray, left: np.ndarray | int) -> np.ndarray:
    """``lane`` with only its first ``left`` bytes, where that is under eight."""
    keep = np.minimum(left, 8)
    mask = np.where(keep < 8, (np.uint64(1) << np.uint64(8) * np.minimum(keep, 7).astype(np.uint64)) - np.uint64(1),
                    np.uint64(2 ** 64 - 1))
    return lane & mask


def hash_bytes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``buffer[start:end]`` of every range."""
    view = lanes(buffer)
    left = end - start
    out = mix(left.astype(np.uint64) * ODD[1] + STARTS[seed])
    live, at = np.arange(len(start)), start
    while len(live):
        out[live] = mix(out[live] ^ cut_lane(view[at], left) * ODD[0])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def grams(buffer: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``buffer[i:i + width]`` for each i: a cheap one, for routing (the
    eight-byte parts are added before they are mixed)."""
    view, n = lanes(buffer), max(len(buffer) - width + 1, 0)
    out = np.full(n, STARTS[2])
    for i, offset in enumerate(range(0, width, 8)):
        part = view[offset:offset + n] if width - offset >= 8 else cut_lane(view[offset:offset + n], np.int64(width - offset))
        out += part * np.uint64(int(ODD[0]) * (2 * i + 1) % 2 ** 64)
    return mix(out)


def chunks(texts: Sequence[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of the texts of one chunk: byte buffer, bounds, text of each
    word, first word of each text (``first`` has one entry more)."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buffer = LOWER[self.buffer]
        white = WHITE[self.buffer]
        change = np.flatnonzero(np.diff(np.concatenate(([True], white)).view(np.int8)))
        self.start, self.end = change[::2], change[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_bytes(self.buffer, self.start, self.end, seed)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i (as if all were one text): windows
    of 1, 2, 4 ... words are mixed from two halves, and those that add up to
    the width are mixed in turn."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, size, level = np.full(n, STARTS[0]), 0, 1, words
    while size <= width:
        if width & size:
            out = mix(out * ODD[1] + level[done:done + n])
            done += size
        size *= 2
        if size <= width:
            level = mix(level[:-(size // 2)] * ODD[2] + level[size // 2:])
    return out
