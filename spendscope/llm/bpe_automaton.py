"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens that accepts, among all ways to cut a word
into tokens, exactly the one BPE yields. It starts as one state with an arc for each base symbol. Each merge
(u, v) -> uv, in order of priority, adds a gadget: the state entered by u is split off as a copy without the arc v,
and every state with an arc u gains an arc uv that enters the state entered by v. All arcs with the same label
enter the same state, so the automaton has one state per token, and it differs from the one it was split off from
by a few arcs. States are kept that way (origin, removed arcs); an arc of the finished automaton is looked up along
that chain once and then stands in the transition table.

A word is encoded by walking the table: from the current state the longest token that starts here and has an arc
is taken; a dead end steps back. A full walk is the only one there is, hence the BPE result. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendscope.llm.common import map_arrow, table

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 300_000  # words a Python worker remembers; beyond it starts anew
TABLE_ARCS = 1_000_000  # arcs the table holds; beyond it starts anew
_END = "\0"  # stands for the word-end mark inside this module


class MergeAutomaton:
    """The automaton of a merge list over base symbols; tokens are strings, and name the state they enter."""

    def __init__(self, base: Iterable[str], merges: Iterable[tuple[str, str]]):
        self.made: dict[str, int] = dict.fromkeys(base, -1)  # token -> number of its merge
        self.parts: dict[str, tuple[str, str]] = {}
        self.removed: dict[str, dict[str, int]] = {s: {} for s in self.made}  # state -> arc -> merge that removed it
        self.table: dict[tuple[str, str], bool] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)
        self.longest = max(map(len, self.made), default=0)

    def _gadget(self, k: int, u: str, v: str) -> None:
        """Split the state of u off without the arc v; the arc uv enters the state of v as it was before."""
        if u in self.made and v in self.made and u + v not in self.made and self._arc(u, v, k):
            self.removed[u][v] = k
            self.made[u + v], self.parts[u + v], self.removed[u + v] = k, (u, v), {}

    def _arc(self, state: str, token: str, now: int) -> bool:
        """Whether ``state`` had an arc ``token`` when the gadgets of all merges before ``now`` were in place.

        The state of a merged token began as the state of its right part at that time, so what was made or removed
        earlier is looked up there. An arc made by a merge was added to the states that had the arc of its left
        part right after the split.
        """
        while True:
            made = self.made[token]
            while True:
                if self.removed[state].get(token, now) < now:
                    return False
                born = self.made[state]
                if born <= made or born < 0:
                    break
                now, state = min(now, born), self.parts[state][1]
            if made < 0:
                return True
            now, token = made + 1, self.parts[token][0]

    def arc(self, state: str, token: str) -> bool:
        """The same in the finished automaton. The start state ("") keeps all arcs."""
        if not state:
            return True
        key = state, token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            known = self.table[key] = self._arc(state, token, sys.maxsize)
        return known

    def encode(self, word: str) -> list[str] | None:
        """The arc labels of the accepted walk over ``word``; None where the base symbols cannot spell it."""
        made, arc, n = self.made, self.arc, len(word)
        path: list[str] = []
        at, state, length, dead = 0, "", min(self.longest, n), set()
        while at < n:
            while length:
                piece = word[at : at + length]
                if piece in made and at + length not in dead and arc(state, piece):
                    break
                length -= 1
            if length:
                path.append(piece)
                at += length
                state = piece
                length = min(self.longest, n - at)
            else:
                if not path:
                    return None
                dead.add(at)
                piece = path.pop()
                at -= len(piece)
                state = path[-1] if path else ""
                length = len(piece) - 1
        return path


def _byte_letters() -> list[str]:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _class(kind: str) -> str:
    """A character class of the Latin code points (below U+0250) whose category starts with ``kind``."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind))


# How this vocabulary splits a text before merging, and what it removes from it.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
_LATIN_WORDS = re.compile(
    f"{_SUFFIXES}|[{_class('L')}]+|[{_class('N')}]|[^{_SPACES}{_class('L')}{_class('N')}]+"
)
_BEYOND_LATIN = re.compile("[^\0-ɏ]")


class WordBpe:
    """Encoder and decoder for a tokenizers file of a BPE with word ends over byte letters.

    Text whose lower case has Latin code points only is split here; other text is normalized and split by the
    tokenizers library, which then stops before any merge. Merging is the automaton's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end_mark = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.ids = {self._inside(t): i for t, i in model["vocab"].items()}
        self.label_of = {i: t for t, i in model["vocab"].items()}
        letters = _byte_letters()
        self.to_letters = letters
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label_of |= {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = MergeAutomaton(
            [*letters, *(x + _END for x in letters)], ((self._inside(a), self._inside(b)) for a, b in pairs)
        )
        self.words = _Words(self)

    def _inside(self, token: str) -> str:
        return token[: -len(self.end_mark)] + _END if token.endswith(self.end_mark) else token

    def word_ids(self, word: str, lettered: bool = False) -> list[int]:
        if not lettered:
            word = "".join([self.to_letters[b] for b in word.encode()])
        return [self.ids[t] for t in self.automaton.encode(word + _END) or ()]

    def split(self, text: str) -> Iterable[tuple[str, int | None]]:
        """Stretches of ordinary text (with None) and special tokens (with their id), in order."""
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part:
                yield part, self.special.get(part)

    def encode_parts(self, text: str) -> tuple[list[str], list[str]]:
        """Ids, and labels, of the text: one string for each word, joined by spaces within."""
        known, out = self.words, []
        for part, special in self.split(text):
            if special is not None:
                out.append((str(special), part))
                continue
            lowered = part.lower()
            if _BEYOND_LATIN.search(lowered):
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out.extend(map(self._render, (self.word_ids(w, lettered=True) for w, _ in pieces)))
            else:
                out.extend(map(known.__getitem__, _LATIN_WORDS.findall(lowered)))
        return [ids for ids, _ in out], [labels for _, labels in out]

    def _render(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join([self.label_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in " ".join(self.encode_parts(text)[0]).split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The arc labels, joined by spaces (the file names no decoder)."""
        return " ".join([self.label_of[i] for i in ids])


class _Words(dict):
    """What words were encoded to; bounded."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.bpe._render(self.bpe.word_ids(word))
        if len(word) < 40:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The encoder of a file, built once in each Python worker."""
    return WordBpe(path)


def encode_decode(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, texts: bool = True
) -> DataFrame:
    """``keep`` columns, the token ids of ``text`` and their decoded text, one row for each row of ``df``.

    Null and empty texts have no tokens and decode to the empty string. Repeated rows stay. Other columns of
    ``df`` are ignored. With ``texts`` False, digests stand in for the ids and the decoded text.
    """
    path = path or public_tokenizers.path(WORD_BPE)
    kept = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = word_bpe(path)
        counts, first, second = [], [], []
        for value in batch.column("t").to_pylist():
            ids, labels = bpe.encode_parts(value or "")
            ids, labels = " ".join(filter(None, ids)), " ".join(filter(None, labels))
            counts.append(ids.count(" ") + 1 if ids else 0)
            first.append([int(i) for i in ids.split()] if texts else hashlib.sha256(ids.encode()).hexdigest())
            second.append(labels if texts else hashlib.sha256(labels.encode()).hexdigest())
        columns = [batch.column(i) for i in range(len(keep))]
        names = [f"k{i}" for i in range(len(keep))]
        kind = pa.list_(pa.int32()) if texts else pa.string()
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())],
            names=[*names, "n", "a", "b"],
        )

    schema = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = map_arrow(kept, make, f"{schema}, n bigint, a {'array<int>' if texts else 'string'}, b string")
    named = ("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256")
    return out.toDF(*keep, "n_tokens", *named)


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), texts=False)
