"""Which keys occur in more than one chunk of a corpus: counting in Spark with packed, pre-aggregated messages.

Documents are dealt to chunks of about a thousand. Each chunk sends each of its distinct 64-bit keys once, as a
sorted packed array for each range of key values, so that a key that stands a million times travels once per chunk.
A range is counted in a task of its own, which answers every chunk with the ordinals of the keys that other chunks
sent as well. Keys repeated within a chunk are the chunk's own business.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.byte_hash import pack_hashes, unpack_hashes
from spendscope.llm.common import shuffle_partitions

WIDTH = 7  # bytes of a key that travel; the range's number holds the top bits
CHUNK_BYTES = 2_000_000
RANGE_KEYS = 2_000_000


class Layout:
    """How many chunks and ranges: in proportion to the corpus, so that no task grows with it."""

    def __init__(self, n_bytes: int, keys_per_byte: float, chunk_bytes: int = CHUNK_BYTES):
        self.chunks = max(1, -(-n_bytes // chunk_bytes))
        keys = n_bytes * keys_per_byte
        self.range_bits = max(4, int(np.ceil(np.log2(max(1.0, keys / RANGE_KEYS)))))


def text_bytes(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def in_chunks(df: DataFrame, chunks: int, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, doc_id, text, k0 ...), rows of a chunk in one partition. Equal texts may be in different chunks.

    The chunk follows from id and text, so the same rows come together wherever the plan is used; repeated rows
    are told apart by their order there, and as equals it does not matter which is which.
    """
    keyed = df.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(text), F.lit(17)), F.lit(chunks)).alias("chunk"),
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
    )
    return keyed.repartition(shuffle_partitions(df.sparkSession), "chunk")


def ordered(chunk: pa.Table) -> pa.Table:
    """A chunk's rows in the one order that every use agrees on."""
    return chunk.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def texts_of(chunk: pa.Table) -> list[str]:
    """The texts in that order; null ones empty."""
    return [t or "" for t in chunk["text"].to_pylist()]


def messages(chunk: int, keys: np.ndarray, range_bits: int) -> pa.Table:
    """A chunk's sorted distinct keys, one row per range of values."""
    bounds = np.searchsorted(keys, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
    parts = [(i, part) for i, part in enumerate(np.split(keys, bounds)) if len(part)]
    return pa.table({
        "range": pa.array([i for i, _ in parts], pa.int32()),
        "chunk": pa.array([chunk] * len(parts), pa.int64()),
        "keys": pa.array([pack_hashes(_rotated(part, range_bits), WIDTH) for _, part in parts], pa.binary()),
    })


def _rotated(keys: np.ndarray, range_bits: int) -> np.ndarray:
    """Drops the bits that the range's number holds; of the rest, the high ones stay."""
    return (keys << np.uint64(range_bits)) >> np.uint64(8 * (8 - WIDTH))


def answers(sent: pa.Table, many: int) -> pa.Table:
    """For one range: each chunk's ordinals (among its keys of the range) of keys that another chunk sent too.

    ``many`` has the ordinals of those that more than that number of chunks sent.
    """
    packed = sent["keys"].to_pylist()
    keys = unpack_hashes(b"".join(packed), WIDTH)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    times = np.empty(len(keys), np.int32)
    times[order] = np.repeat(size, size)
    chunks, found, frequent, at = [], [], [], 0
    for chunk, n in zip(sent["chunk"].to_pylist(), (len(x) // WIDTH for x in packed), strict=True):
        hits = np.flatnonzero(times[at : at + n] > 1)
        if len(hits):
            chunks.append(chunk)
            found.append(hits.astype("<u4").tobytes())
            frequent.append(np.flatnonzero(times[at : at + n] > many).astype("<u4").tobytes())
        at += n
    number = sent["range"][0].as_py()
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "range": pa.array([number] * len(chunks), pa.int32()),
        "hits": pa.array(found, pa.binary()), "many": pa.array(frequent, pa.binary()),
    })


def counted_between_chunks(
    chunked: DataFrame, keys_of: Callable[[list[str]], np.ndarray], range_bits: int, many: int = 1 << 30
) -> DataFrame:
    """(chunk, range, hits, many), see ``answers``, over the sorted distinct keys that ``keys_of`` finds in a chunk's ordered texts."""

    def send(chunk: pa.Table) -> pa.Table:
        return messages(chunk["chunk"][0].as_py(), keys_of(texts_of(ordered(chunk))), range_bits)

    return answered(chunked.groupBy("chunk").applyInArrow(send, SENT), many)


SENT = "range int, chunk long, keys binary"


def answered(sent: DataFrame, many: int = 1 << 30) -> DataFrame:
    return sent.groupBy("range").applyInArrow(lambda t: answers(t, many), "chunk long, range int, hits binary, many binary")


def shared_flags(keys: np.ndarray, answered: pa.Table, range_bits: int, column: str = "hits") -> np.ndarray:
    """The answers for a chunk as flags of its sorted distinct keys."""
    flags = np.zeros(len(keys), bool)
    starts = np.searchsorted(keys, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
    for number, hits in zip(answered["range"].to_pylist(), answered[column].to_pylist(), strict=True):
        flags[starts[number] + np.frombuffer(hits, "<u4").astype(np.int64)] = True
    return flags
