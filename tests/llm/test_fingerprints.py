"""Order MinHash against a plain Python version of its definition, and its properties."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spendscope.llm.order_minhash import KMER, SKETCHES, SLOTS, WORDS, kmers, likeness, order_minhash
from tests.llm.conftest import ODD


def texts(n=40, seed=6):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "internationally", "x", "the", "the"]
    return [" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def expected_edits(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("step", [1, 1000, -7])
def test_edits_and_neighbours(spark, docs_of, step):
    rows = [(i * step, t) for i, t in enumerate(texts())]
    found = order_minhash(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected_edits(rows)
    by_id = {r["doc_id"]: r for r in found}
    ids = sorted(by_id)
    for k, i in enumerate(ids):
        a, b = by_id[i], by_id[ids[(k + 1) % len(ids)]]
        assert a["near_next"] == pytest.approx(plain_likeness(a["fingerprint"], b["fingerprint"]))
        assert a["near_edited"] == pytest.approx(plain_likeness(a["fingerprint"], a["edited_fingerprint"]))
    assert sum(r["near_edited"] for r in found) > 3 * sum(r["near_next"] for r in found)


def plain_likeness(a, b):
    a, b = ({int(f[i : i + 16], 16) for i in range(0, len(f), 16)} for f in (a, b))
    filled = {x % SKETCHES for x in a | b}
    return len(a & b) / len(filled) if filled else 1.0


def test_fingerprints_by_definition(spark, docs_of):
    """The same elements, numbered, placed and put in order by a plain loop; hashes come from Spark."""
    rows = [(i, t) for i, t in enumerate(texts(12))]
    found = {r["doc_id"]: r["fingerprint"] for r in order_minhash(docs_of(rows)).collect()}
    xx = lambda values, kinds: [r[0] for r in spark.createDataFrame(values, kinds).select(F.xxhash64(*[c.split()[0] for c in kinds.split(", ")])).collect()]
    for doc_id, text in rows:
        tokens = re.findall(r"\S{1,8}\s*", text + " \1" * (KMER - 1))
        runs = ["".join(tokens[i : i + KMER]) for i in range(len(tokens) - KMER + 1)]
        if not runs:
            assert found[doc_id] == ""
            continue
        seen, numbered = {}, []
        for run, h in zip(runs, xx([(r,) for r in runs], "v string"), strict=True):
            seen[run] = seen.get(run, 0) + 1
            numbered.append((h, seen[run]))
        best = {}
        for pos, g in enumerate(xx(numbered, "h long, n long")):
            place = g % SKETCHES, ((g % 2**64) >> 32) % SLOTS
            best[place] = min(best.get(place, (g, pos)), (g, pos))
        tuples = []
        for sketch in {s for s, _ in best}:
            picked = sorted((pos, g) for (s, _), (g, pos) in best.items() if s == sketch)
            h = spark.range(1).select(F.xxhash64(F.array(*[F.lit(g) for _, g in picked]))).first()[0]
            tuples.append((h & ~(SKETCHES - 1)) | sketch)
        assert found[doc_id] == "".join(f"{t % 2**64:016x}" for t in sorted(tuples))


def test_order_matters_and_copies_agree(spark, docs_of):
    words = [f"word{i}" for i in range(60)]
    moved = words[30:] + words[:30]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(moved)), (4, "else " * 9)]
    found = {r["doc_id"]: r for r in order_minhash(docs_of(rows)).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[1]["near_next"] == 1.0
    assert 0.3 < found[2]["near_next"] < 0.95  # the same words, half of them elsewhere


@pytest.mark.parametrize("sketches, slots", [(SKETCHES, SLOTS), (70, 3)])
def test_every_sketch_selects_from_all_elements(spark, docs_of, sketches, slots):
    """The least of all elements by a plain loop, on texts short and long; words of hash bits come from Spark."""
    long = " ".join(f"{i * i % 1013}" for i in range(700))
    rows = [(i, t) for i, t in enumerate([*texts(6), "one two", long])]
    found = {r["doc_id"]: r["fingerprint"] for r in order_minhash(docs_of(rows), sketches=sketches, slots=slots, every=True).collect()}
    low = (1 << (sketches - 1).bit_length()) - 1

    def xx(values, kinds):
        df = spark.createDataFrame(values, kinds)
        return [r[0] % 2**64 for r in df.select(F.xxhash64(*df.columns)).collect()]

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for doc_id, text in rows:
        tokens = re.findall(r"\S{1,8}\s*", text + " \1" * (KMER - 1))
        runs = ["".join(tokens[i : i + KMER]) for i in range(len(tokens) - KMER + 1)]
        if not runs:
            assert found[doc_id] == ""
            continue
        seen, numbered = {}, []
        for run, h in zip(runs, xx([(r,) for r in runs], "v string"), strict=True):
            seen[run] = seen.get(run, 0) + 1
            numbered.append((signed(h), seen[run]))
        elements = [signed(g) for g in xx(numbered, "h long, n long")]
        jw = [(j, w) for j in range(1, WORDS + 1) for w in range(-(-sketches // 64))]
        word = dict(zip([(g, *x) for g in elements for x in jw], xx([(g, *x) for g in elements for x in jw], "g long, j int, w int"), strict=True))
        gs = [(g, -1, s) for g in elements for s in range(sketches)]
        rest = dict(zip(gs, xx(gs, "g long, j int, s long"), strict=True))
        lists = []
        for s in range(sketches):
            def rank(pos, s=s):
                g = elements[pos]
                bits = [word[g, j, s // 64] >> s % 64 & 1 for j in range(1, WORDS + 1)]
                zeros = bits.index(1) if 1 in bits else WORDS
                return WORDS - zeros, rest[g, -1, s] % 2**56, g
            lists.append(([elements[p] for p in sorted(sorted(range(len(elements)), key=rank)[:slots])],))
        tuples = [signed((h & ~low) | s) for s, h in enumerate(xx(lists, "a array<long>"))]
        assert found[doc_id] == "".join(f"{t % 2**64:016x}" for t in sorted(tuples)), doc_id


def test_moved_halves_count_at_every_length(spark, docs_of):
    rng, rows, n = random.Random(4), [], 0
    for length in (10, 20, 40, 80, 160):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
            rows += [(n, " ".join(words)), (n + 1, " ".join(words[length // 2 :] + words[: length // 2]))]
            n += 2
    found = {r["doc_id"]: r["near_next"] for r in order_minhash(docs_of(rows), every=True).collect()}
    for at, length in enumerate((10, 20, 40, 80, 160)):
        mean = sum(found[24 * at + 2 * i] for i in range(12)) / 12
        assert 0.1 < mean < 0.6, (length, mean)  # ten pieces keep some seven of thirteen k-mers


def test_plan_of_every_stays_native(spark, docs_of):
    plan = order_minhash(docs_of([(1, "a b")]), every=True)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, docs_of):
    found = order_minhash(docs_of(ODD)).collect()
    assert len(found) == len(ODD)
    alone = next(r for r in found if r["doc_id"] is None)
    assert alone["near_next"] == 1.0
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found if r["doc_id"] is not None) == expected_edits(ODD)
    assert {r["fingerprint"] for r in found if r["doc_id"] in (7, 8, 9)} == {""}
    assert order_minhash(docs_of([])).count() == 0
    single = order_minhash(docs_of([(5, "a single document of words")])).first()
    assert single["near_next"] == 1.0


def test_plans_stay_native(spark, docs_of):
    plan = order_minhash(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_kmers_overlap(spark):
    row = spark.range(1).select(kmers(F.lit("aa  bb\ncc"), 2), kmers(F.lit(""), 2)).first()
    assert list(row[0]) == ["aa  bb\n", "bb\ncc ", "cc \1"] and list(row[1]) == []
    assert spark.range(1).select(likeness(F.array(F.lit(64), F.lit(65)), F.array(F.lit(64)), 64)).first()[0] == 0.5
