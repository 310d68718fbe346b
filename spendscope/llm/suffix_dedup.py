"""Suffix-array deduplication: bytes of 400-byte strings that start more than once in the corpus are removed.

Not every suffix is sorted. Each 400-byte string has an anchor, the least 100-byte gram in it by hash (the leftmost,
if several): equal strings have it at the same offset. So it is enough to compare, for each gram, the anchors where
it stands. Grams that stand once are known from counting them (see ``repeats``); for the others the anchors travel
with as much text on both sides as their strings reach. There the suffixes from the anchors are sorted by
hash-compared mergesort (see ``suffix_sort``). Strings at offset d before an anchor are equal if the suffixes have
400 - d bytes in common, a run of the suffix array, and the d bytes before agree. What hashes call equal is compared
byte by byte; should one comparison fail, the whole batch is matched by its bytes.

Grams in more than ``MANY_CHUNKS`` chunks, as passages in a third of all documents have, are not brought together:
the hashes of their strings are counted instead, once per chunk, which spreads one gram over all tasks. Two of them
may collide at 64 bits, as in ``window_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spendscope.llm.byte_hash import joined, mix, of_bytes
from spendscope.llm.common import table
from spendscope.llm.repeats import Layout, counted_between_chunks, in_chunks, ordered, shared_flags, text_bytes, texts_of
from spendscope.llm.suffix_sort import Suffixes
from spendscope.llm.window_dedup import runs

LENGTH = 400
GRAM = 100
MANY_CHUNKS = 64
CHUNK_BYTES = 1_000_000  # a task holds some hundred bytes for each byte of a chunk
_LOW = np.uint64(0xFFFFFFFF)
CONTEXT_BITS = 6  # contexts of one range of grams are matched in one task; see Layout for how many ranges


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class ChunkAnchors:
    """The anchors of all strings of ``length`` bytes in a chunk's texts.

    at: position in the joined buffer; first, last: the strings it is the anchor of start there; key: its gram.
    """

    def __init__(self, texts: list[str], length: int, gram: int):
        self.texts = [t.encode() for t in texts]
        self.buffer, self.offsets = joined(self.texts)
        self.length, self.gram = length, gram
        self.hashes = of_bytes(self.buffer)
        n = len(self.buffer) - length + 1
        if n <= 0:
            self.at = self.first = self.last = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = mix(self.hashes.windows(gram))
        places = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~_LOW) | places, length - gram + 1)[:n] & _LOW
        ends = np.repeat(self.offsets[1:] - 1, np.diff(self.offsets))  # of the text that a position belongs to
        starts = np.flatnonzero(np.arange(n) + length <= ends[:n])
        anchor = least[starts].astype(np.int64)
        change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        self.at = anchor[change]
        self.first = starts[change]
        self.last = starts[np.concatenate([change[1:], [len(starts)]]) - 1] if len(change) else self.first
        self.key = mix(grams[self.at] + np.uint64(1))  # anew, as anchors have the least values


def _cut(anchors: ChunkAnchors, i: int) -> bytes:
    return anchors.buffer[anchors.first[i] : anchors.last[i] + anchors.length]


def contexts(anchors: ChunkAnchors, chosen: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One anchor for each distinct surrounding text, and the anchors of those that stand more than once."""
    first, last = anchors.first[chosen], anchors.last[chosen] + anchors.length
    shape = ((anchors.at[chosen] - first) << 20 | (last - first)).astype(np.uint64)
    hashes = mix(mix(anchors.hashes.of(first, last)) ^ shape)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    one, several = [], []
    for members in np.split(chosen[order], cuts) if len(order) else []:
        if len(members) == 1:
            one.append(members[0])
            continue
        by_text: dict[bytes, list[int]] = {}
        for m in members:
            by_text.setdefault(_cut(anchors, m), []).append(m)
        for same in by_text.values():
            one.append(same[0])
            if len(same) > 1:
                several.append(np.array(same))
    return np.array(one, np.int64), several


def match(key: np.ndarray, buffer: bytes, start: np.ndarray, back: np.ndarray, size: np.ndarray, length: int):
    """Strings that stand in more than one context: (context, offset before its anchor) of each.

    Context i is buffer[start:start+size] with its anchor ``back`` bytes in; its strings start at most ``back``
    bytes before the anchor and fill the context.
    """
    anchor, right = start + back, size - back
    suffixes = Suffixes(buffer, anchor, np.minimum(right, length))
    order = suffixes.sort(key)
    lcp = suffixes.neighbours(order, key)
    low = back + length - size  # offsets of its strings: low ... back
    count = back - low + 1
    which = np.repeat(np.arange(len(order)), count[order])  # place in the suffix array
    i = order[which]
    d = np.arange(len(which)) - np.repeat(np.cumsum(count[order]) - count[order], count[order]) + low[i]
    # Places p < p' agree on length - d bytes if no lcp between them is smaller: the run for d starts at the last
    # place whose lcp is smaller. Sorted by (d, place), that is a running maximum.
    by = np.lexsort((which, d))
    which, i, d = which[by], i[by], d[by]
    grid = np.unique(d)
    run = np.empty(len(d), np.int64)
    edge = np.searchsorted(d, grid)
    for n, (depth, at) in enumerate(zip(grid.tolist(), edge.tolist(), strict=True)):
        stop = edge[n + 1] if n + 1 < len(edge) else len(d)
        heads = np.where(lcp < length - depth, np.arange(len(lcp)), 0)
        run[at:stop] = np.maximum.accumulate(heads)[which[at:stop]]
    before = suffixes.hashes.of(anchor[i] - d, anchor[i])
    label = mix(before + mix(run.astype(np.uint64) << np.uint64(16) | d.astype(np.uint64)))
    rank = np.argsort(label, kind="stable")
    same = label[rank][1:] == label[rank][:-1]
    one, two = rank[1:][same], rank[:-1][same]
    if not _verified(buffer, anchor, i[one], i[two], d[one], d[two], length):
        return _by_bytes(buffer, anchor, i, d, length)
    found = np.zeros(len(i), bool)
    found[one] = found[two] = True
    return i[found], d[found]


def _verified(buffer: bytes, anchor, i, j, d, e, length: int) -> bool:
    """Whether all strings that hashes call equal are; those of one pair of contexts are compared at once."""
    if (d != e).any():
        return False
    if not len(i):
        return True
    pair = np.lexsort((d, j, i))
    i, j, d = i[pair], j[pair], d[pair]
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (d[1:] != d[:-1] + 1)]))
    end = np.concatenate([new[1:], [len(i)]]) - 1
    for a, b, least, most in zip(anchor[i[new]].tolist(), anchor[j[new]].tolist(), d[new].tolist(), d[end].tolist(), strict=True):
        if buffer[a - most : a - least + length] != buffer[b - most : b - least + length]:
            return False
    return True


def _by_bytes(buffer: bytes, anchor, i, d, length: int):
    places: dict[bytes, list[int]] = {}
    for k, at in enumerate((anchor[i] - d).tolist()):
        places.setdefault(buffer[at : at + length], []).append(k)
    found = np.array(sorted(k for same in places.values() if len(same) > 1 for k in same), np.int64)
    return i[found], d[found]


def _intervals(at: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
    """Maximal stretches that the strings starting d bytes before ``at`` cover, as flat pairs."""
    starts = np.unique(at - d)
    if not len(starts):
        return starts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    end = np.concatenate([new[1:], [len(starts)]]) - 1
    return np.stack([starts[new], starts[end] + length], 1).ravel()


_HEAD = np.dtype([("key", "<u8"), ("at", "<i4"), ("back", "<i4"), ("size", "<i4")])
_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("chunk", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])
CONTEXT, WINDOWS, DONE = 0, 1, 2


def _by_range(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """The indices of ``keys`` by their top bits."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return [(n, part) for n, part in enumerate(np.split(order, bounds)) if len(part)]


def chunk_messages(chunk: int, anchors: ChunkAnchors, shared: np.ndarray, many: np.ndarray, bits: int) -> pa.Table:
    """What a chunk sends: contexts of anchors whose gram stands elsewhere, string hashes of very frequent grams,
    and the stretches it can judge alone."""
    keys, back, times = np.unique(anchors.key, return_inverse=True, return_counts=True)
    wanted = (times > 1) | shared
    rows, done = [], [np.zeros(0, np.int64)]
    plain = np.flatnonzero((wanted & ~many)[back])
    one, several = contexts(anchors, plain)
    for same in several:  # all strings of a repeated context are repeated
        done.append(np.stack([anchors.first[same], anchors.last[same] + anchors.length], 1).ravel())
    for n, part in _by_range(anchors.key[one], bits):
        own = one[part]
        head = np.zeros(len(own), _HEAD)
        head["key"], head["at"] = anchors.key[own], anchors.at[own]
        head["back"] = anchors.at[own] - anchors.first[own]
        head["size"] = anchors.last[own] + anchors.length - anchors.first[own]
        rows.append((n, CONTEXT, chunk, head.tobytes(), b"".join(_cut(anchors, k) for k in own)))
    frequent = np.flatnonzero((wanted & many)[back])
    if len(frequent):
        count = anchors.last[frequent] - anchors.first[frequent] + 1
        starts = np.repeat(anchors.first[frequent] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        hashes = mix(anchors.hashes.of(starts, starts + anchors.length))
        found, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        done.append(_intervals(starts[times[which] > 1], np.int64(0), anchors.length))
        for n, part in _by_range(found, bits):
            rows.append((n, WINDOWS, chunk, found[part].astype("<u8").tobytes(), starts[first[part]].astype("<i4").tobytes()))
    stretches = np.concatenate(done).astype("<i4")
    if len(stretches):
        rows.append((chunk % (1 << bits), DONE, chunk, b"", stretches.tobytes()))
    return pa.table({name: pa.array([r[k] for r in rows], _ROW.types[k]) for k, name in enumerate(_ROW.names)}, schema=_ROW)


def answer(sent: pa.Table, length: int) -> pa.Table:
    """For one range of grams: the repeated stretches of each chunk, in its own positions."""
    kinds = sent["kind"].to_numpy()
    chunks = sent["chunk"].to_numpy()
    heads, bodies = sent["head"].to_pylist(), sent["body"].to_pylist()
    out: list[tuple[int, bytes]] = [(chunks[k], bodies[k]) for k in np.flatnonzero(kinds == DONE)]

    def reply(of: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        order = np.argsort(of, kind="stable")
        of, at, d = of[order], at[order], d[order]
        for part in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1):
            if len(part):
                out.append((of[part[0]], _intervals(at[part], d[part], length).astype("<i4").tobytes()))

    rows = np.flatnonzero(kinds == CONTEXT)
    if len(rows):
        head = np.frombuffer(b"".join(heads[k] for k in rows), _HEAD)
        of = np.repeat(chunks[rows], [len(heads[k]) // _HEAD.itemsize for k in rows])
        size = head["size"].astype(np.int64)
        i, d = match(head["key"], b"".join(bodies[k] for k in rows), np.cumsum(size) - size, head["back"].astype(np.int64), size, length)
        reply(of[i], head["at"][i].astype(np.int64), d)
    rows = np.flatnonzero(kinds == WINDOWS)
    if len(rows):
        hashes = np.frombuffer(b"".join(heads[k] for k in rows), "<u8")
        starts = np.frombuffer(b"".join(bodies[k] for k in rows), "<i4").astype(np.int64)
        of = np.repeat(chunks[rows], [len(heads[k]) // 8 for k in rows])
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = times[which] > 1
        reply(of[hit], starts[hit], np.zeros(int(hit.sum()), np.int64))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "stretches": pa.array([s for _, s in out], pa.binary())})


def repeated_bytes(texts: list[bytes], offsets: np.ndarray, stretches: pa.Table) -> list[np.ndarray]:
    """For each text, a flag per byte."""
    steps = np.zeros(offsets[-1] + 1, np.int32)
    pairs = np.frombuffer(b"".join(stretches["stretches"].to_pylist()), "<i4").reshape(-1, 2)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1], -1)
    gone = np.cumsum(steps) > 0
    return [gone[o : o + len(t)] for t, o in zip(texts, offsets, strict=False)]


def whole_characters(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of characters of which some byte stays."""
    data = np.frombuffer(raw, np.uint8)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(head):
        return gone
    return np.repeat(np.minimum.reduceat(gone, head), np.diff(np.concatenate([head, [len(data)]])))


def remove_repeated_strings(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, output: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns, n_bytes, n_removed, n_spans, kept, stretches.

    ``output`` "text" returns the kept text, where characters of which only some bytes repeat stay whole; "digest"
    the SHA-256 of the exact remaining bytes. ``stretches`` are starts and ends of the removed runs. Null and empty
    texts have no bytes; texts shorter than ``length`` stay whole. Repeated rows repeat each other. Other columns
    of ``df`` are ignored.
    """
    layout = Layout(text_bytes(df, text), 1.0, CHUNK_BYTES)
    chunked = in_chunks(df, layout.chunks, doc_id, text, keep)
    gram_bits, bits = max(4, layout.range_bits - 6), max(CONTEXT_BITS, layout.range_bits)

    def keys_of(texts: list[str]) -> np.ndarray:
        return np.unique(ChunkAnchors(texts, length, gram).key)

    def send(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        anchors = ChunkAnchors(texts_of(ordered(chunk)), length, gram)
        keys = np.unique(anchors.key)
        shared, many = (shared_flags(keys, answered, gram_bits, c) for c in ("hits", "many"))
        return chunk_messages(chunk["chunk"][0].as_py(), anchors, shared, many, bits)

    def judge(chunk: pa.Table, stretches: pa.Table) -> pa.Table:
        chunk = ordered(chunk)
        texts = [t.encode() for t in texts_of(chunk)]
        _, offsets = joined(texts)
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for raw, gone in zip(texts, repeated_bytes(texts, offsets, stretches), strict=True):
            if output == "text" and gone.any():
                gone = whole_characters(raw, gone)
            start, end = runs(gone)
            left = raw if not len(start) else b"".join(
                raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True)
            )
            n_bytes.append(len(raw))
            n_removed.append(int(gone.sum()))
            n_spans.append(len(start))
            kept.append(left.decode() if output == "text" else hashlib.sha256(left).hexdigest())
            spans.append(np.stack([start, end], 1).ravel())
        return pa.table({
            "doc_id": chunk["doc_id"], **{f"k{i}": chunk[f"k{i}"] for i in range(len(keep))}, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.int32())),
        })

    shared = counted_between_chunks(chunked, keys_of, gram_bits, MANY_CHUNKS)
    sent = chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        send, "bucket int, kind byte, chunk long, head binary, body binary"
    )
    stretches = sent.groupBy("bucket").applyInArrow(lambda t: answer(t, length), "chunk long, stretches binary")
    kinds = [df.schema[c].dataType.simpleString() for c in (doc_id, *keep)]
    kind = ", ".join([kinds[0], *(f"k{i} {t}" for i, t in enumerate(kinds[1:]))])
    out = chunked.groupBy("chunk").cogroup(stretches.groupBy("chunk")).applyInArrow(
        judge, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept string, spans array<int>"
    )
    return out.toDF(doc_id, *keep, "n_bytes", "n_removed", "n_spans", "kept" if output == "text" else "kept_sha256", "stretches")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"), output="digest")
