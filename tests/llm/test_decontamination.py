"""Test passages in documents, against every window compared in plain Python."""

import random
import re

import numpy as np
import pytest

from spendscope.llm import byte_hash, decontamination
from spendscope.llm.decontamination import Block, Shard, decontaminate, find_tests, longest_of_corpus, places_of_windows
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id string, items string"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(items, window=10):
    out = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(tuple(words[i : i + window]), set()).update([] if item is None else [str(item)])
    return out


def expected(text, windows):
    words = words_of(text)
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if (w := tuple(words[i : i + n])) in windows:
                hit |= set(range(i, i + n))
                items |= windows[w]
    return len(words), hit, sorted(items)


def rows_of(found):
    return sorted((str(r["doc_id"]), r["n_words"], tuple(x for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True) for x in range(a, b)), r["items"]) for r in found.collect())


def plain_rows(docs, items, window=10):
    windows = windows_of(items, window)
    return sorted((str(i), n, tuple(sorted(hit)), found) for i, t in docs for n, hit, found in [expected(t, windows)])


def corpus(seed, docs=60, vocabulary=6):
    """Few words, so that matches of all lengths abound."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "B2"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 5, 6, 9, 10, 11, 30]))) for i in range(25)] + [(3, text(12)), (None, text(6)), (90, None), (91, "?!"), (92, "")]
    out = [(i, text(rng.randrange(80))) for i in range(docs)]
    out += [(1000 + (i or 77), f"{text(5)} {t} {text(5)}".upper() if t else t) for i, t in items]
    return out, items


@pytest.mark.parametrize(("block_bytes", "blocks"), [(4_000_000, 4), (200, 2)])
def test_windows_and_items_of_documents(spark, docs_of, block_bytes, blocks):
    docs, items = corpus(1)
    docs += ODD
    tests = spark.createDataFrame([(*r, "d", "i") for r in [*items, *items[:3], (7, "abc " * 300)]], ITEM)
    found = find_tests(docs_of(docs), tests, block_bytes=block_bytes, blocks=blocks, keep=("keys",))
    assert rows_of(found) == plain_rows(docs, [*items, (7, "abc " * 300)])
    assert found.columns == ["doc_id", "keys", "n_words", "spans", "items", "matches"]


def test_other_windows_and_pieces(spark, docs_of, monkeypatch):
    docs, items = corpus(2, vocabulary=3)
    tests = spark.createDataFrame([(*r, "d", "i") for r in items], ITEM)
    assert rows_of(find_tests(docs_of(docs), tests, window=4)) == plain_rows(docs, items, 4)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 15)
    assert rows_of(find_tests(docs_of(docs), tests)) == plain_rows(docs, items)


def test_equal_hashes_of_different_words(monkeypatch):
    docs, items = corpus(3)
    plain = byte_hash.word_hashes
    monkeypatch.setattr(byte_hash, "word_hashes", lambda *a: plain(*a) & np.uint64(3))
    pieces = [(str(i), 0, words_of(t)) for i, t in items if words_of(t)]
    block, shard = Block(pieces, 10), Shard([t.encode() for _, t in docs if t])
    _, place, window = shard.search(block)
    found = {(int(p), " ".join(block.words[n - 1] .decode() for n in block.text[block.at[np.flatnonzero(block.of_window == w)[0]]:][: block.depth[w]])) for p, w in zip(place, window, strict=True)}
    windows, want, at = windows_of([(i, t) for i, t in items]), set(), 0
    for _, t in docs:
        if t:
            words = words_of(t)
            want |= {(at + i, " ".join(words[i : i + n])) for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows}
            at += len(words) + 1
    assert found == want and len(block.clashes)


def test_longest_matches(spark, docs_of):
    docs, items = corpus(4)
    tests = spark.createDataFrame([(*r, "d", "i") for r in items if r[0] is not None and r[0] != 3], ITEM)
    best = {(r["item_id"], r["item_word"]): r for r in longest_of_corpus(find_tests(docs_of(docs), tests)).collect()}
    texts = {i: words_of(t) for i, t in docs}
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    wanted = {}
    for item, t in items:
        if item is None or item == 3:
            continue
        words = words_of(t)
        least = min(10, len(words))
        for j in range(len(words) - least + 1 if least == 10 else bool(words)):
            longest = max(common(words[j:], d[p:]) for d in texts.values() for p in range(len(d)))
            if longest >= least:
                wanted[str(item), j] = longest
    assert {k: r["n_words"] for k, r in best.items()} == wanted
    for (item, j), r in best.items():
        words = words_of(dict(items)[int(item)])
        assert texts[r["doc_id"]][r["doc_word"] :][: r["n_words"]] == words[j : j + r["n_words"]]


def test_affected_documents_leave(spark, docs_of):
    docs, items = corpus(5)
    windows = windows_of(items)
    tests = spark.createDataFrame([(*r, "d", "i") for r in items], ITEM)
    left = decontaminate(docs_of(docs + ODD), tests)
    assert left.columns == docs_of([]).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, t in docs + ODD if not expected(t, windows)[1])


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEM)
    docs, items = corpus(6)
    assert all(r["spans"] == [] and r["items"] == [] for r in find_tests(docs_of(docs), none).collect())
    assert find_tests(docs_of([]), spark.createDataFrame([(*r, "d", "i") for r in items], ITEM)).count() == 0


def test_places_need_room_for_a_window():
    block = Block([("1", 0, list("abcdefghijkl"))], 10)
    numbers = np.array([block.number[c.encode()] for c in "abcdefghijkl"] + [0] + [block.number[c.encode()] for c in "abcdefghi"] + [0], np.int32)
    place, _ = places_of_windows(np.concatenate([numbers, np.zeros(block.keys * block.per, np.int32)]), block)
    assert sorted(place.tolist()) == [0, 1, 2]
