"""Substring deduplication by Rabin-Karp hashes of every fixed-length window of words.

Every window of 35 consecutive words of every document is hashed, the hashes are counted in Spark, and windows whose
hash stands more than once merge into maximal intervals of words that are removed. Hashes have 64 bits less the few
that messages between tasks leave out (one in range and chunk order, see ``repeats``), and different windows do share
one in a large corpus. So windows whose hash stands elsewhere are hashed anew, from other values of every byte, and
counted once more: a window goes only if both hashes stand elsewhere. Two different windows among n agree on both with a
chance of about n * n / 2**125.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.byte_hash import OTHER_VALUES, Hashes, joined, mix, word_hashes, words_of
from spendscope.llm.common import table
from spendscope.llm.repeats import (
    SENT,
    Layout,
    answered,
    counted_between_chunks,
    in_chunks,
    messages,
    ordered,
    shared_flags,
    text_bytes,
    texts_of,
)

WINDOW = 35


class ChunkWords:
    """The words of a chunk's texts and the hashes of their windows."""

    def __init__(self, texts: list[str], window: int):
        self.texts = [t.encode() for t in texts]
        self.buffer, offsets = joined(self.texts)
        start, end = self.start, self.end = words_of(self.buffer)
        self.first = np.searchsorted(start, offsets)  # of each text, its first word
        self.window = window
        hashes = mix(Hashes(word_hashes(self.buffer, start, end)).windows(window))
        self.at = np.arange(len(hashes))
        last = np.repeat(self.first[1:], np.diff(self.first))[: len(hashes)]
        self.at = self.at[self.at + window <= last]
        self.hashes = hashes[self.at]

    def distinct(self) -> np.ndarray:
        return np.unique(self.hashes)

    def second(self) -> np.ndarray:
        """Other hashes of the windows."""
        return mix(Hashes(word_hashes(self.buffer, self.start, self.end, OTHER_VALUES)).windows(self.window))[self.at]

    def shared(self, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """A flag for each window: its hash is a flagged one of the sorted ``keys``."""
        return flags[np.searchsorted(keys, self.hashes)] if len(keys) else np.zeros(len(self.hashes), bool)

    def repeated(self, shared: np.ndarray, second: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """A flag for each word: in a window that both hashes found elsewhere, or that agrees with one here in both."""
        bad = np.zeros(len(self.hashes), bool)
        asked = np.flatnonzero(shared)
        if len(asked):
            bad[asked] = flags[np.searchsorted(keys, second[asked])]
        order = np.lexsort((second, self.hashes))
        same = (self.hashes[order][1:] == self.hashes[order][:-1]) & (second[order][1:] == second[order][:-1])
        bad[order[1:][same]] = bad[order[:-1][same]] = True
        return covered(self.at[bad], self.window, int(self.first[-1]))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the n positions that lie in one of the stretches of ``length``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of set flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def remove_repeated_windows(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, texts: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (or its digest), and the removed word intervals.

    Null and empty texts have no words; texts shorter than the window lose none. Repeated rows repeat each other's
    windows and are judged like other copies. Other columns of ``df`` are ignored.
    """
    layout = Layout(text_bytes(df, text), 0.2)
    chunked = in_chunks(df, layout.chunks, doc_id, text)
    bits = layout.range_bits

    def keys_of(texts_in: list[str]) -> np.ndarray:
        return ChunkWords(texts_in, window).distinct()

    def again(chunk: pa.Table, first: pa.Table) -> pa.Table:
        """The second hashes of the windows whose first hash stands in another chunk."""
        if not chunk.num_rows:
            return messages(0, np.zeros(0, np.uint64), bits)
        words = ChunkWords(texts_of(ordered(chunk)), window)
        keys = words.distinct()
        shared = words.shared(keys, shared_flags(keys, first, bits))
        return messages(chunk["chunk"][0].as_py(), np.unique(words.second()[shared]) if shared.any() else np.zeros(0, np.uint64), bits)

    def judge(chunk: pa.Table, both: pa.Table) -> pa.Table:
        chunk = ordered(chunk)
        words = ChunkWords(texts_of(chunk), window)
        keys, second = words.distinct(), words.second()
        shared = words.shared(keys, shared_flags(keys, both.filter(pc.equal(both["turn"], 1)), bits))
        others = np.unique(second[shared])
        removed = words.repeated(shared, second, others, shared_flags(others, both.filter(pc.equal(both["turn"], 2)), bits))
        n_words, n_removed, kept, intervals = [], [], [], []
        for i, raw in enumerate(words.texts):
            gone = removed[words.first[i] : words.first[i + 1]]
            pieces = raw.split()
            if gone.any():
                pieces = [w for w, g in zip(pieces, gone.tolist(), strict=True) if not g]
            left = b" ".join(pieces)
            n_words.append(len(gone))
            n_removed.append(int(gone.sum()))
            kept.append(left.decode() if texts else hashlib.sha256(left).hexdigest())
            intervals.append(np.stack(runs(gone), 1).ravel())
        return pa.table({
            "doc_id": chunk["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()), "intervals": pa.array(intervals, pa.list_(pa.int32())),
        })

    first = counted_between_chunks(chunked, keys_of, bits)
    second = answered(chunked.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(again, SENT))
    both = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))
    kind = df.schema[doc_id].dataType.simpleString()
    out = chunked.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(
        judge, f"doc_id {kind}, n_words long, n_removed long, kept string, intervals array<int>"
    )
    return out.toDF(doc_id, "n_words", "n_removed", "kept" if texts else "kept_sha256", "intervals")


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), texts=False)
