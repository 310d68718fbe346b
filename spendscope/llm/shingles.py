"""Word shingles of texts as sets of 64-bit hashes, and MinHash signatures of such sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from spendscope.llm.byte_hash import MIX_A, Hashes, joined, mix, word_hashes, words_of

WORDS = 5
BATCH_BYTES = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; A-Z in lower case, other letters as they are.

    With fewer words than a shingle has, the whole sequence is one; without words the set is empty.
    """
    batch: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().translate(_LOWER)
        if batch and size + len(raw) > BATCH_BYTES:
            yield from _sets(batch, words)
            batch, size = [], 0
        batch.append(raw)
        size += len(raw)
    yield from _sets(batch, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    buffer, offsets = joined(texts)
    start, end = words_of(buffer)
    first = np.searchsorted(start, offsets)
    hashes = Hashes(word_hashes(buffer, start, end))
    full = mix(hashes.windows(words))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            whole = hashes.of(np.array([a]), np.array([b])) + np.array([b - a], np.uint64) * MIX_A
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)


class MinHash:
    """Signatures of ``size`` hash functions: odd multiples of a set's hashes plus a shift, modulo 2**32."""

    def __init__(self, size: int):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
        self.factor = (seeds[:size] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shift = (seeds[size:] >> np.uint64(32)).astype(np.uint32)

    def of(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), block):
            values = self.factor[:, None] * x[None, at : at + block] + self.shift[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        return least
