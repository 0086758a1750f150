"""Golomb-Rice coding of sorted fingerprints, vectorised with numpy.

Differences of neighbours are split into a quotient (unary) and ``k`` low
bits, ``k`` taken from the mean difference.  The unary stream and the low
bits are kept apart, so both sides are array operations."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QIBI")


def encode(values: np.ndarray, low: int = 0) -> bytes:
    """Bytes of the ascending uint64 array ``values`` (all >= ``low``;
    repeats allowed; empty is legal)."""
    n = len(values)
    if n == 0:
        return HEAD.pack(low, 0, 0, 0)
    gaps = np.empty(n, np.uint64)
    gaps[0] = values[0] - np.uint64(low)
    np.subtract(values[1:], values[:-1], out=gaps[1:])
    span = int(values[-1]) - low
    k = max(0, min(63, (max(1, int(span / n * 0.69))).bit_length() - 1))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    unary = np.packbits(unary).tobytes()
    whole, rest = divmod(k, 8)
    octets = gaps.astype("<u8").view(np.uint8).reshape(n, 8)
    parts = [HEAD.pack(low, n, k, len(unary)), unary, octets[:, :whole].tobytes()]
    if rest:
        bits = np.unpackbits(octets[:, whole:whole + 1], axis=1, bitorder="little")[:, :rest]
        parts.append(np.packbits(bits).tobytes())
    return b"".join(parts)


def decode(blob: bytes) -> np.ndarray:
    low, n, k, size = HEAD.unpack_from(blob)
    if n == 0:
        return np.empty(0, np.uint64)
    at = HEAD.size
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at)))[:n]
    at += size
    quotient = np.diff(ones, prepend=-1) - 1
    whole, rest = divmod(k, 8)
    octets = np.zeros((n, 8), np.uint8)
    octets[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    if rest:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n * rest).reshape(n, rest)
        octets[:, whole] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    gaps = octets.view("<u8").reshape(n).astype(np.uint64) + (quotient.astype(np.uint64) << np.uint64(k))
    values = np.cumsum(gaps, dtype=np.uint64)
    return values + np.uint64(low)
