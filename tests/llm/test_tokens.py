"""BPE automaton and packing, held against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendscope.llm.bpe_automaton import WORD_BPE, MergeAutomaton, encode_decode, word_bpe
from spendscope.llm.packing import BYTE_BPE, binary_lengths, pack
from tests.llm.conftest import ODD

TEXTS = [
    "", "aaaaaaaaaaaaaaa hahahahaha", "It's ÉTÉ, foo_bar 12 ½!", "x<|startoftext|>y<|endoftext|>", "​hi\x1cyou\x85z",
    "İstanbul ΣΑΣ ﬁ ẞ", "🙂🙂 नमस्ते 日本語", "\u0000\u0001 tab\tnew\nline", "é combined",
]


def by_ranks(word, merges):
    parts = list(word)
    while True:
        ranked = [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        _, k = min(ranked)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(20))
def test_automaton_equals_merging_by_rank(seed):
    rng = random.Random(seed)
    tokens, merges = ["a", "b", "c"], {}
    while len(merges) < 15:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair not in merges and pair[0] + pair[1] not in tokens:
            merges[pair] = len(merges)
            tokens.append(pair[0] + pair[1])
    machine = MergeAutomaton("abc", merges)
    made = set(machine.made)
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        walk = machine.encode(word)
        assert "".join(walk) == word and set(walk) <= made
        assert walk == by_ranks(word, merges)


def test_automaton_knows_what_it_cannot_spell():
    assert MergeAutomaton("ab", [("a", "b")]).encode("abx") is None


@pytest.mark.parametrize("text", TEXTS)
def test_word_bpe_equals_library(text):
    bpe = word_bpe(public_tokenizers.path(WORD_BPE))
    expected = bpe.library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == expected
    assert bpe.decode(expected) == bpe.library.decode(expected, skip_special_tokens=False)


def test_every_latin_code_point_inside_a_word_equals_library():
    bpe = word_bpe(public_tokenizers.path(WORD_BPE))
    for c in map(chr, range(0x250)):
        for text in (f"x{c}liyev", f"{c}liyev", f"ab{c}", f"AB{c} {c}{c} 1{c}2"):
            assert bpe.encode(text) == bpe.library.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)
    assert bpe.encode("Əliyev") == [133, 247, 554, 39855]


def test_encode_decode_on_odd_rows(spark, docs_of):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    found = encode_decode(docs_of(ODD), texts=False).collect()
    expected = []
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert encode_decode(docs_of([])).count() == 0
    assert encode_decode(docs_of([(1, "a cat")])).first()["ids"] == library.encode("a cat", add_special_tokens=False).ids


def test_binary_lengths():
    assert binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert binary_lengths(1) == [1] and binary_lengths(2048) == [2048]
    for n in range(1, 5000, 7):
        assert sum(binary_lengths(n)) == n and binary_lengths(n) == sorted(binary_lengths(n), reverse=True)


def test_pieces_give_back_every_document(spark, docs_of):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    pieces = pack(docs_of(rows)).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    for doc_id, text in rows:
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        ids = [i for p in own for i in p["ids"]]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for p in own:
            assert p["length"] == 1 << p["bucket"] <= 2048 and p["offset"] == 0 and p["doc_tokens"] == len(ids)
            assert ids[p["start"] : p["start"] + p["length"]] == p["ids"]
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    assert pack(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        pack(docs_of([]), longest=1000)
