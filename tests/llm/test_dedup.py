"""Near, window and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from spendscope.llm import suffix_dedup, window_dedup
from spendscope.llm.graph import components
from spendscope.llm.near_dedup import least_agreements, near_duplicates, similar, survivors
from spendscope.llm.repeats import answers, messages, shared_flags
from spendscope.llm.suffix_dedup import match, remove_repeated_strings, whole_characters
from spendscope.llm.suffix_sort import Suffixes
from spendscope.llm.window_dedup import remove_repeated_windows
from tests.llm.conftest import ODD

SPACE = "[^\x20\x09-\x0d]+"


def corpus(seed=4, n=60):
    """Documents with copies, edited copies, chains of edits, shared passages and periodic text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(120)]
    out = []
    for i in range(n):
        kind = i % 6
        words = [word() for _ in range(rng.randint(1, 150))]
        if kind == 1 and out:
            out.append(rng.choice(out)[:])
            continue
        if kind == 2 and out:
            words = rng.choice(out)[:]
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = word()
        if kind == 3:
            at = rng.randint(0, 60)
            words[5:5] = passage[at : at + rng.randint(30, 60)]
        if kind == 4 and out:
            words = out[-1] + [word()] * rng.randint(1, 60)
        out.append(words)
    return [(i, rng.choice([" ", "\n", " \t"]).join(w).title() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(out)]


def rows_with_odd():
    return corpus() + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]


def test_windows_against_brute_force(spark, docs_of):
    rows, window = rows_with_odd(), 35
    words = [re.findall(SPACE, t or "") for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    found = {r["doc_id"]: r for r in remove_repeated_windows(docs_of(rows), texts=False).collect()}
    removed = 0
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        row = found[doc_id]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        spans = row["intervals"]
        assert [any(a <= i < b for a, b in zip(spans[::2], spans[1::2], strict=True)) for i in range(len(w))] == gone
        removed += sum(gone)
    assert removed > 500 and len(found) == len(rows)
    assert remove_repeated_windows(docs_of([])).count() == 0
    assert {r["n_removed"] for r in remove_repeated_windows(docs_of([(1, "a b " * 40), (1, "a b " * 40), (None, "c")])).collect()} == {80, 0}


@pytest.mark.parametrize("many", [64, 1])
def test_strings_against_brute_force(spark, docs_of, monkeypatch, many):
    """With very frequent grams counted by string hashes, too."""
    monkeypatch.setattr(suffix_dedup, "MANY_CHUNKS", many)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 8000)
    rows, length = rows_with_odd(), 90
    raw = [(t or "").encode() for _, t in rows]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    found = {r["doc_id"]: r for r in remove_repeated_strings(docs_of(rows), length=length, gram=25, output="digest").collect()}
    removed = 0
    for (doc_id, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        row = found[doc_id]
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(r), gone.sum(), spans)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        removed += gone.sum()
    assert removed > 5000 and len(found) == len(rows)


def test_strings_of_odd_tables(spark, docs_of):
    assert remove_repeated_strings(docs_of([])).count() == 0
    text = "é" * 150 + "".join(chr(0x4E00 + i) for i in range(150))
    found = {(r["doc_id"], r["n_removed"], r["kept"]) for r in remove_repeated_strings(docs_of([(1, text), (1, text), (None, "c")])).collect()}
    assert found == {(1, len(text.encode()), ""), (None, 0, "c")}


@pytest.mark.parametrize("texts", [["hi"], [None, ""], ["x" * 399, "x" * 399], ["x" * 400], ["x" * 401], ["y" * 400, "y" * 400, "z"]])
def test_strings_of_short_tables(spark, docs_of, texts):
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in remove_repeated_strings(docs_of(rows)).collect()}
    twice = [t for t in texts if t and len(t) >= 400 and (texts.count(t) > 1 or t == "x" * 401)]
    assert found == {i: (len(t or ""), len(t) if t in twice else 0) for i, t in rows}


def test_short_text_alone_among_chunks(spark, docs_of):
    """Texts larger than a chunk, so that the short ones have chunks of their own."""
    rng = random.Random(8)
    long = ["".join(rng.choices("abcdefghijklmnop ", k=1_100_000)) for _ in range(3)]
    rows = [(1, long[0]), (2, long[1] + long[0][:500]), (3, long[2]), (4, "short"), (5, None), (6, "also short")]
    found = {r["doc_id"]: r["n_removed"] for r in remove_repeated_strings(docs_of(rows)).collect()}
    assert found == {1: 500, 2: 500, 3: 0, 4: 0, 5: 0, 6: 0}


def test_whole_characters_stay():
    raw = "aéb".encode()
    assert whole_characters(raw, np.array([1, 0, 1, 1], bool)).tolist() == [True, False, False, True]


def test_suffixes_are_sorted():
    rng = random.Random(2)
    for _ in range(40):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 80)))
        start = np.array([rng.randrange(len(text)) for _ in range(rng.randint(1, 60))])
        length = np.array([rng.randint(0, min(12, len(text) - s)) for s in start])
        group = np.array([rng.randint(0, 2) for _ in start], np.uint64)
        suffixes = Suffixes(text, start, length)
        cut = [text[s : s + n] for s, n in zip(start, length, strict=True)]
        order = suffixes.sort(group)
        assert order.tolist() == sorted(range(len(start)), key=lambda i: (group[i], cut[i]))
        for place, lcp in list(enumerate(suffixes.neighbours(order, group)))[1:]:
            a, b = cut[order[place - 1]], cut[order[place]]
            same = group[order[place]] == group[order[place - 1]]
            assert lcp == (next((k for k in range(min(len(a), len(b)) + 1) if k == min(len(a), len(b)) or a[k] != b[k])) if same else -1)


def test_false_hash_matches_fall_back_to_bytes(monkeypatch):
    """Where hashes call different strings equal, the bytes decide."""
    buffer = b"xxGRAMyyzzGRAMyyxxGRAMyy"
    start, back, size = np.array([0, 8, 16]), np.array([2, 2, 2]), np.array([8, 8, 8])
    key = np.zeros(3, np.uint64)
    expected = match(key, buffer, start, back, size, 8)
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: np.zeros_like(x))
    assert [sorted(x.tolist()) for x in match(key, buffer, start, back, size, 8)] == [sorted(x.tolist()) for x in expected] == [[0, 2], [2, 2]]


def shingles(text):
    w = re.findall(SPACE, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return {rows[k][0]: (len(sets[k]), least[find(k)]) for k in range(len(rows))}


def test_near_duplicates_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    chain = [[f"w{rng.randrange(10**6)}" for _ in range(80)]]
    for _ in range(12):  # each like the one before, the ends unlike each other
        chain.append(chain[-1][2:] + [f"w{rng.randrange(10**6)}" for _ in range(2)])
    rng.shuffle(chain)
    rows = [r for r in rows_with_odd() if r[0] != 1004] + [(2000 + i, " ".join(w)) for i, w in enumerate(chain)]
    expected = expected_components(rows)
    found = near_duplicates(docs_of(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["component_id"] for r in found if 2000 <= r["doc_id"]} == {2000}


def test_near_duplicates_of_odd_tables(spark, docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    text = "one two three four five six"
    found = near_duplicates(docs_of([(5, text), (5, text), (3, text.upper()), (None, text), (9, None), (8, "a b")])).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=str) == sorted(
        [(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (9, 0, 9, True), (8, 1, 8, True)], key=str
    )


def test_sequential_bounds():
    assert least_agreements(50, 25, 0.75, 1e-7) == tuple(sorted(least_agreements(50, 25, 0.75, 1e-7)))
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    for share, stays in ((0.9, True), (0.75, True), (0.2, False)):
        others = np.where(rng.random((50, 200)) < share, one, one + 1)
        assert (len(survivors(one, others, 0.75, 1e-7)) == 50) is stays
    assert similar(np.arange(4, dtype=np.uint64), np.arange(3, dtype=np.uint64))
    assert not similar(np.arange(4, dtype=np.uint64), np.arange(1, 4, dtype=np.uint64)[:2])


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert found == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_with_equal_short_sums_stay_two(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from spendscope.llm.near_dedup import open_once

    n = 4000
    h = np.array([r[0] for r in spark.range(n).coalesce(1).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).collect()])
    a, b = np.triu_indices(n, 1)
    sums = h[a] + h[b]
    order = np.argsort(sums)
    same = order[np.flatnonzero(np.diff(sums[order]) == 0)[0] :][:2]
    pairs = [(int(a[i]), int(b[i])) for i in same]
    rows = [(k, d, d) for k, pair in enumerate([*pairs, pairs[0]]) for d in pair]
    found = open_once(spark.createDataFrame(rows, "key long, doc_id long, component long")).collect()
    assert sorted(r["key"] for r in found) == [0, 1]


def test_windows_stay_exact_when_first_hashes_collide(monkeypatch):
    """The rounds of the query, by hand over three chunks, with a first hash that has sixteen values."""
    plain = window_dedup.Hashes.windows
    calls = {"n": 0}
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(3, 40))) for _ in range(30)]
    texts += [texts[0], "pre " + texts[1] + " post", texts[2][: len(texts[2]) // 2]]
    size, bits, chunks = 6, 4, []

    def few(self, length):
        calls["n"] += 1
        return plain(self, length) & np.uint64(15) if calls["n"] % 2 == 1 else plain(self, length)

    for c in range(3):
        monkeypatch.setattr(window_dedup.Hashes, "windows", few)
        calls["n"] = 0
        words = window_dedup.ChunkWords(texts[c::3], size)
        chunks.append((words, words.distinct(), words.second()))
        monkeypatch.undo()

    def rounds(keys):
        sent = [messages(c, k, bits) for c, k in enumerate(keys)]
        by_range = pa.concat_tables(sent)
        replies = [answers(by_range.filter(pc.equal(by_range["range"], r)), 1 << 30) for r in sorted(set(by_range["range"].to_pylist()))]
        both = pa.concat_tables(replies)
        return [shared_flags(k, both.filter(pc.equal(both["chunk"], c)), bits) for c, k in enumerate(keys)]

    first = rounds([k for _, k, _ in chunks])
    shared = [w.shared(k, f) for (w, k, _), f in zip(chunks, first, strict=True)]
    others = [np.unique(s[f]) for (_, _, s), f in zip(chunks, shared, strict=True)]
    second = rounds(others)
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    for c, (words, _, other) in enumerate(chunks):
        gone, at = words.repeated(shared[c], other, others[c], second[c]), 0
        for t in texts[c::3]:
            w = t.split()
            want = [any(seen[tuple(w[i : i + size])] > 1 for i in range(max(0, j - size + 1), min(j, len(w) - size) + 1)) for j in range(len(w))]
            assert gone[at : at + len(w)].tolist() == want
            at += len(w)
    assert sum(f.mean() for f in shared) > 2.5  # the first hash alone would have taken nearly everything
