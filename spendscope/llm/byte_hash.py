"""Polynomial hashes of byte strings, by prefix sums in numpy.

Byte b at position i of a buffer counts value(b) * K**i modulo 2**64, so the hash of any stretch is a difference of
two prefix sums times K**-start, wherever it starts.
"""

from __future__ import annotations

import numpy as np

K = np.uint64(0x9E3779B97F4A7C15)
K_INVERSE = np.uint64(pow(int(K), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * K)
OTHER_VALUES = mix(np.arange(257, 513, dtype=np.uint64) * K)  # for a second hash that knows nothing of the first


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1)."""
    low = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK - 1, base, np.uint64)]), dtype=np.uint64)
    step = np.uint64(pow(int(base), BLOCK, 1 << 64))
    high = np.cumprod(
        np.concatenate([np.ones(1, np.uint64), np.full(n // BLOCK, step, np.uint64)]), dtype=np.uint64
    )
    return (high[:, None] * low[None, :]).ravel()[:n]


class Hashes:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(K, n), out=self.sums[1:])
        self.inverse = powers(K_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the stretches [start, end); not mixed."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        """Of every stretch of ``length``, by start; not mixed."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def of_bytes(buffer: bytes | np.ndarray, values: np.ndarray = VALUES) -> Hashes:
    return Hashes(values[np.frombuffer(buffer, np.uint8)])


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than space and U+0009 to U+000D."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[np.frombuffer(buffer, np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(buffer: bytes, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A mixed hash of each word's bytes; its length counts too."""
    return mix(of_bytes(buffer, values).of(start, end) + (end - start).astype(np.uint64) * MIX_B) if len(start) else np.zeros(0, np.uint64)


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, each followed by ``gap``; where each starts (and where the next would)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return gap.join(texts) + gap * bool(texts), starts


def pack_hashes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_hashes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()
