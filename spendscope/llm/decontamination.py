"""Benchmark decontamination: the suffixes of all test texts are looked up in suffix arrays over shards of the corpus.

A shard is some megabytes of whole documents, read and searched where it lies, so the corpus is never shuffled. Its words
become numbers in the alphabetical order of the words of the tests; words that no test has end every match, and
suffixes that reach one too soon are left out of the array. The array is sorted as deep as a window is long. Every
test suffix is binary-searched there: the suffixes that share its window are a range of the array, which holds all the
window's places. Within the ranges found the array is then sorted to full depth together with the test suffixes
(hash-compared mergesort, see ``suffix_sort``), where the longest match of a test suffix is one of its neighbours.

Words are numbered by a 64-bit hash, but no result rests on it: the words of all matches are compared, and a false one
is struck out of the shard, which is searched anew.

The tests are collected and broadcast in blocks of a bounded size. Block beyond ``BLOCKS`` of them take one more pass over
the corpus for each further group, so neither driver nor executors hold more at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm import byte_hash
from spendscope.llm.byte_hash import Hashes, joined, mix
from spendscope.llm.common import cut, table
from spendscope.llm.suffix_sort import Suffixes
from spendscope.llm.window_dedup import runs

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_BYTES = 8_000_000
HASH_BYTES = 1_000_000
PIECE_WORDS = 4096  # longer tests are searched in pieces that overlap by a window less one word
BLOCK_BYTES = 4_000_000
BLOCKS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOUND = "spans array<int>, items array<string>, matches array<struct<item_id: string, item_word: int, doc_word: int, n_words: int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))


class Block:
    """A block of test texts, ready to be looked up: vocabulary, distinct windows with their items, and suffixes."""

    def __init__(self, pieces: list[tuple[str | None, int, list[str]]], window: int):
        self.window = window
        raw = [[w.encode() for w in words] for _, _, words in pieces]
        self.words = sorted({w for words in raw for w in words})
        self.number = {w: i + 1 for i, w in enumerate(self.words)}
        self.bits = (len(self.words) + 1).bit_length()
        self.per = 64 // self.bits  # words of one key
        self.keys = -(-window // self.per)
        buffer, offsets = joined(self.words)
        hashes = byte_hash.word_hashes(buffer, offsets[:-1], offsets[1:] - 1)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], (order + 1).astype(np.int32)
        self.clashes = np.unique(self.hashes[1:][self.hashes[1:] == self.hashes[:-1]])
        self.items = [item for item, _, _ in pieces]
        self.starts = [start for _, start, _ in pieces]
        #: all pieces as numbers, each followed by a zero
        self.text = np.array([n for words in raw for n in [*(self.number[w] for w in words), 0]], np.int32)
        sizes = np.array([len(words) for words in raw], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        self.piece = np.repeat(np.arange(len(raw)), sizes)
        self.at = np.arange(len(self.piece)) + self.piece
        self.offset = self.at - first[self.piece]
        self.length = sizes[self.piece] - self.offset
        whole = (self.offset == 0) & (np.array(self.starts, np.int64)[self.piece] == 0)
        depth = np.where(self.length >= window, window, np.where(whole & (self.length == sizes[self.piece]), self.length, 0))
        keep = depth > 0
        self.piece, self.at, self.offset, self.length, depth = (x[keep] for x in (self.piece, self.at, self.offset, self.length, depth))
        low, high = self._bounds(depth)
        shape, self.of_window = np.unique(np.column_stack([*low, depth.astype(np.uint64)]), axis=0, return_inverse=True)
        self.of_window = self.of_window.ravel()
        some = np.zeros(len(shape), np.int64)
        some[self.of_window] = np.arange(len(self.at))
        self.low, self.high, self.depth = [k[some] for k in low], [k[some] for k in high], depth[some]
        listed: list[set[str]] = [set() for _ in range(len(shape))]
        for w, p in zip(self.of_window.tolist(), self.piece.tolist(), strict=True):
            if self.items[p] is not None:
                listed[w].add(self.items[p])
        self.items_of = [frozenset(x) for x in listed]

    def _bounds(self, depth: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest keys of what begins with the first ``depth`` words of each suffix."""
        text = np.concatenate([self.text, np.zeros(self.keys * self.per, np.int32)])
        low = [np.zeros(len(depth), np.uint64) for _ in range(self.keys)]
        high = [np.zeros(len(depth), np.uint64) for _ in range(self.keys)]
        for k in range(self.keys * self.per):
            shift = np.uint64(self.bits * (self.per - 1 - k % self.per))
            word = text[self.at + k].astype(np.uint64)
            low[k // self.per] |= np.where(k < depth, word, np.uint64(0)) << shift
            high[k // self.per] |= np.where(k < depth, word, np.uint64((1 << self.bits) - 1)) << shift
        return low, high

    def numbered(self, buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of words; the number after the last for those that no test has."""
        other = len(self.words) + 1
        out = np.full(len(start), other, np.int32)
        if not self.words:
            return out
        cuts = np.searchsorted(start, np.arange(0, len(buffer) + HASH_BYTES, HASH_BYTES))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            base = start[a]
            hashes = byte_hash.word_hashes(buffer[base : end[b - 1]], start[a:b] - base, end[a:b] - base)
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out[a:b] = np.where(self.hashes[place] == hashes, self.numbers[place], other)
            if len(self.clashes):  # hashes that several words of the tests have
                for i in np.flatnonzero(np.isin(hashes, self.clashes)) + a:
                    out[i] = self.number.get(buffer[start[i] : end[i]], other)
        return out


class Shard:
    """The words of some documents, as numbers with a zero after each document."""

    def __init__(self, texts: list[bytes]):
        self.buffer, offsets = joined([t.translate(_LOWER) for t in texts])
        inside = np.zeros(len(self.buffer) + 2, np.int8)
        inside[1:-1] = _IN_WORD[np.frombuffer(self.buffer, np.uint8)]
        edges = np.diff(inside)
        self.start, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        first = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.place = np.arange(len(self.start)) + self.doc
        self.first = first[:-1] + np.arange(len(texts))  # where each document begins among the numbers
        self.size = len(self.start) + len(texts)

    def search(self, tests: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows of the tests: (numbers, place, window)."""
        numbers = tests.numbered(self.buffer, self.start, self.end)
        while True:
            text = np.zeros(self.size + tests.keys * tests.per, np.int32)
            text[self.place] = numbers
            place, window = places_of_windows(text, tests)
            false = self._false_words(tests, numbers, place, tests.depth[window])
            if not len(false):
                return text[: self.size], place, window
            numbers[false] = len(tests.words) + 1

    def _false_words(self, tests: Block, numbers: np.ndarray, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Matched words that only have the hash of the test's word."""
        steps = np.zeros(self.size + 1, np.int32)
        np.add.at(steps, place, 1)
        np.add.at(steps, place + depth, -1)
        hit = np.flatnonzero((np.cumsum(steps) > 0)[self.place])
        words, buffer = tests.words, self.buffer
        return np.array([
            i for i, a, b, n in zip(hit.tolist(), self.start[hit].tolist(), self.end[hit].tolist(), numbers[hit].tolist(), strict=True)
            if buffer[a:b] != words[n - 1]
        ], np.int64)


def suffix_array(text: np.ndarray, packed: np.ndarray, at: np.ndarray, tests: Block) -> np.ndarray:
    """The places ``at`` in the order of what follows there, as deep as the keys reach."""
    order = at[np.argsort(packed[at])]
    same = packed[order][1:] == packed[order][:-1]
    for k in range(1, tests.keys):
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        group = np.cumsum(~np.concatenate([[False], same]))[tied]
        key = packed[order[tied] + k * tests.per]
        order[tied] = order[tied][np.lexsort((key, group))]
        key = packed[order[tied] + k * tests.per]
        equal = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same = np.zeros(len(order) - 1, bool)
        same[tied[1:][equal] - 1] = True  # members of a group lie side by side
    return order


def bound(order: np.ndarray, packed: np.ndarray, per: int, keys: list[np.ndarray], or_equal: bool) -> np.ndarray:
    """Binary search of many suffixes at once: how many in ``order`` are less (or equal)."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, key in enumerate(keys):
            there, mine = packed[order[middle] + k * per], key[open_]
            less |= equal & (there < mine)
            equal &= there == mine
        ahead = less | equal if or_equal else less
        low[open_] = np.where(ahead, middle + 1, low[open_])
        high[open_] = np.where(ahead, high[open_], middle)
    return low


def places_of_windows(text: np.ndarray, tests: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every place where a window of the tests stands in ``text``."""
    nothing = np.zeros(0, np.int64)
    if not len(tests.depth):
        return nothing, nothing
    n = len(text) - tests.per + 1
    packed = np.zeros(n, np.uint64)
    for k in range(tests.per):
        packed |= text[k : k + n].astype(np.uint64) << np.uint64(tests.bits * (tests.per - 1 - k))
    known = (text > 0) & (text <= len(tests.words))
    stop = np.minimum.accumulate(np.where(known, len(text), np.arange(len(text)))[::-1])[::-1]
    at = np.flatnonzero(known & (stop - np.arange(len(text)) >= tests.depth.min()))
    order = suffix_array(text, packed, at, tests)
    low = bound(order, packed, tests.per, tests.low, False)
    high = bound(order, packed, tests.per, tests.high, True)
    size = high - low
    window = np.repeat(np.arange(len(size)), size)
    return order[np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + low[window]], window


class _Words(Suffixes):
    """Suffixes of a sequence of word numbers."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.bytes = text
        self.hashes = Hashes(mix(text.astype(np.uint64) + np.uint64(1)))
        self.start, self.length = start, length


def longest_matches(text: np.ndarray, place: np.ndarray, window: np.ndarray, room: np.ndarray, tests: Block):
    """(test suffix, place, words) of a longest match of each test suffix whose window stands in ``text``."""
    nothing = np.zeros(0, np.int64)
    asked = np.flatnonzero(np.isin(tests.of_window, window))
    if not len(asked):
        return nothing, nothing, nothing
    both = np.concatenate([text, tests.text])
    suffixes = _Words(both, np.concatenate([place, tests.at[asked] + len(text)]), np.concatenate([room, tests.length[asked]]))
    group = np.concatenate([window, tests.of_window[asked]])
    order = suffixes.sort(group)
    n = len(place)
    here = np.arange(len(order))
    is_place = order < n
    before = np.maximum.accumulate(np.where(is_place, here, -1))
    after = np.minimum.accumulate(np.where(is_place, here, len(order))[::-1])[::-1]
    test = np.flatnonzero(~is_place)
    best, of = np.zeros(len(test), np.int64), np.full(len(test), -1)
    for side in (before[test], after[test]):
        inside = np.flatnonzero((side >= 0) & (side < len(order)))
        inside = inside[group[order[side[inside]]] == group[order[test[inside]]]]
        common = suffixes.extension(order[test[inside]], order[side[inside]])
        longer = common > best[inside]
        best[inside[longer]], of[inside[longer]] = common[longer], order[side[inside[longer]]]
    found = of >= 0
    suffix, at, words = order[test[found]] - n, place[of[found]], best[found]
    starts = tests.at[asked[suffix]]
    for i, (a, b, w) in enumerate(zip(at.tolist(), starts.tolist(), words.tolist(), strict=True)):
        differ = np.flatnonzero(text[a : a + w] != tests.text[b : b + w])  # should hashes have erred
        words[i] = differ[0] if len(differ) else w
    return asked[suffix], at, words


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows, with some ``SHARD_BYTES`` of text or one row at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + SHARD_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _examine(batch: pa.RecordBatch, blocks: list[Block]) -> dict[str, pa.Array]:
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    shard = Shard(texts)
    spans = batch.column("spans").to_pylist()
    items = [set(x) for x in batch.column("items").to_pylist()]
    matches = batch.column("matches").to_pylist()
    at, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d, flat in enumerate(spans):
        if flat:
            pairs = np.array(flat, np.int64).reshape(-1, 2) + shard.first[d]
            at.append(pairs[:, 0])
            length.append(pairs[:, 1] - pairs[:, 0])
    room = np.repeat(shard.n_words, shard.n_words + 1) - (np.arange(shard.size) - np.repeat(shard.first, shard.n_words + 1))
    doc_of = np.repeat(np.arange(len(texts)), shard.n_words + 1)
    for tests in blocks:
        text, place, window = shard.search(tests)
        at.append(place)
        length.append(tests.depth[window])
        pairs = np.unique(doc_of[place] * max(1, len(tests.depth)) + window)
        docs, windows = pairs // max(1, len(tests.depth)), pairs % max(1, len(tests.depth))
        for d, w in zip(docs.tolist(), windows.tolist(), strict=True):
            items[d] |= tests.items_of[w]
        for s, p, n in zip(*(x.tolist() for x in longest_matches(text, place, window, room[place], tests)), strict=True):
            d, piece = int(doc_of[p]), int(tests.piece[s])
            matches[d].append({"item_id": tests.items[piece], "item_word": tests.starts[piece] + int(tests.offset[s]), "doc_word": p - int(shard.first[d]), "n_words": n})
    steps = np.zeros(shard.size + 1, np.int32)
    np.add.at(steps, np.concatenate(at), 1)
    np.add.at(steps, np.concatenate(at) + np.concatenate(length), -1)
    hit = np.cumsum(steps) > 0
    for d in np.unique(doc_of[np.flatnonzero(hit[: shard.size])]).tolist():
        spans[d] = np.stack(runs(hit[shard.first[d] : shard.first[d] + shard.n_words[d]]), 1).ravel().tolist()
    return {
        "n_words": pa.array(shard.n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32())),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "matches": pa.array(matches, _MATCH),
    }


def pieces_of(tests: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, start, words): the distinct tests as word lists, long ones in pieces that share all windows between them."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    step = PIECE_WORDS - window + 1
    last = F.greatest(F.lit(0), F.floor((F.size("words") - window) / F.lit(step)) * step).cast("int")
    return (
        tests.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
        .select("item", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"), "words")
        .select("item", "start", F.slice("words", F.col("start") + 1, F.lit(PIECE_WORDS)).alias("words"))
    )


def find_tests(
    docs: DataFrame, tests: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), item_id: str = "item_id",
    test_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS,
) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns, n_words, spans, items, matches.

    ``spans`` are starts and ends of the runs of words inside windows of the tests, ``items`` the sorted distinct ids of
    the tests whose windows stand in the document. ``matches`` hold, for each shard of the corpus and each test suffix
    with a window there, the longest verbatim match with its place in test and document (the first in text order, if
    several); see ``longest_of_corpus``. A test shorter than the window is one window. A-Z count as a-z.

    Null texts have no words. Block without an id mark words, but are not listed; repeated tests are as one. Repeated
    rows are judged each. Without tests nothing is marked. Other columns of both frames are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(tests, item_id, test_text, window))
    n_bytes = pieces.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 1)).first()[0] or 0
    parts = max(1, -(-n_bytes // block_bytes))
    part = F.pmod(F.xxhash64("item", "start", "words"), F.lit(parts))
    rest = ["doc_id", *(f"k{i}" for i in range(len(keep)))]
    out = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    for kind, name in zip(("array<int>", "array<string>", FOUND.split("matches ")[1]), ("spans", "items", "matches"), strict=True):
        out = out.withColumn(name, F.array().cast(kind))
    for begin in range(0, parts, blocks):
        group = [
            spark.sparkContext.broadcast(Block([tuple(r) for r in pieces.where(part == p).collect()], window))
            for p in range(begin, min(begin + blocks, parts))
        ]
        last = begin + blocks >= parts
        if begin:
            out = cut(out)
        out = _search_all(out, rest if last else [*rest, "text"], group)
    return out.select(F.col("doc_id").alias(doc_id), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "spans", "items", "matches")


def _search_all(docs: DataFrame, rest: list[str], group: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in group]
        for batch in _sliced(batches):
            found = _examine(batch, blocks)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *found.values()], [*rest, *found])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{kinds}, n_words long, {FOUND}")


def longest_of_corpus(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Over the rows of ``find_tests``: for each test suffix found, (item_id, item_word, n_words, doc_id, doc_word) of its
    longest match, ties to the smallest document and place."""
    each = found.select(F.col(doc_id).alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct(F.col("n_words"), -F.col("doc_id"), -F.col("doc_word")))
    return each.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of ``tests`` stands; takes the options of ``find_tests``."""
    found = find_tests(docs, tests, keep=tuple(docs.columns), **options)
    names = [f"c{i}" for i in range(len(docs.columns))]  # the result's own columns may have the same names
    return found.toDF("id", *names, "n_words", "spans", "items", "matches").where(F.size("spans") == 0).select(
        *(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))
    )


def op11_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_tests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS words FROM documents),
t AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') AS words FROM benchmark),
v AS (
  SELECT item, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM t WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT n FROM v),
p AS (SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN sizes ON i + n - 1 <= len(words)),
h AS (SELECT r, i, n, item FROM p JOIN v USING (n, win)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r)
""".replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{word}", WORD)
