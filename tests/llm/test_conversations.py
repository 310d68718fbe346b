"""Repair of conversations against a plain search over all edits, whole and in pieces."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from spendscope.llm.conversations import _repaired, damaged, op12_rank_viterbi, repair_conversations
from spendscope.llm.viterbi import CLASS, KEEP_NONE, Costs

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
TO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, lines) by a search in order of cost, then audit."""
    faults = faults_of(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, [f"{r}:{t}" for r, t in lines]
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in TO:
                heapq.heappush(queue, (cost + 2, audit + "I", i, TO[state, role[0]], (*lines, (role, ""))))
                if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                    fee = 2 + (faults[i] == "truncated")
                    heapq.heappush(queue, (cost + fee, audit + "R", i + 1, TO[state, role[0]], (*lines, (role, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, lines))
            role, text = rows[i]
            if faults[i] not in ("blank", "duplicate") and (state, role[:1]) in TO:
                heapq.heappush(queue, (cost + (faults[i] == "truncated"), audit + "K", i + 1, TO[state, role[:1]], (*lines, rows[i])))
    raise AssertionError


def summary(rows):
    faults = faults_of(rows)
    cost, audit, lines = plain_repair(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", " "]), rng.choice(["Yes.", "no", "Why?", "", " \n", "é!", f"t{rng.randrange(9)}."])) for _ in range(n)]


def test_costs_of_chunks_are_those_of_one_run():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 700):
        kind = rng.choice([*CLASS.values(), KEEP_NONE], n)
        must_go, fee = rng.random(n) < 0.1, rng.random(n) < 0.2
        last = rng.random(n) < 0.02
        last[-1] = True
        costs = Costs(kind, must_go, fee, last)
        after = np.array([[0, 4, 2, 0]])
        from spendscope.llm.viterbi import END, step

        for i in range(n - 1, -1, -1):
            after = END[None] if last[i] else after
            after = step(after, kind[i : i + 1], must_go[i : i + 1], fee[i : i + 1].astype(int))
            assert (costs.costs[i] == after[0]).all(), (n, i)


@pytest.mark.parametrize(("piece_rows", "partitions"), [(16_384, 1), (5, 1), (16_384, 7), (3, 4)])
def test_repair_equals_a_plain_search(spark, piece_rows, partitions):
    rng = random.Random(piece_rows * 31 + partitions)
    convs = {i: random_rows(rng, rng.choice([1, 2, 3, 8, 20])) for i in range(12)} | {None: random_rows(rng, 5), 99: random_rows(rng, 150)}
    rows = [(c, t, role, text, "x") for c, messages in convs.items() for t, (role, text) in enumerate(messages)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    found = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(df, piece_rows=piece_rows, partitions=partitions).collect()}
    assert found == {c: summary(messages) for c, messages in convs.items()}
    lines = repair_conversations(df, whole=True, piece_rows=piece_rows, partitions=partitions).collect()
    for c, messages in convs.items():
        mine = sorted((r for r in lines if r["conv_id"] == c), key=lambda r: (r["piece"], r["place"]))
        assert [f"{r['role']}:{r['text']}" for r in mine] == plain_repair(messages)[2]


def damaged_plainly(rows):
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        kept = out.setdefault(c, [])
        text = "" if code == 1 else text.translate({ord(x): None for x in ".!?"}) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)) for c, kept in out.items()}


def expected(rows):
    out = {}
    for c, kept in damaged_plainly(rows).items():
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *summary([(r, t) for _, r, t in kept]))
    return out


def test_query_equals_a_plain_search(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = op12_rank_viterbi(spark, SF)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.collect()} == expected(rows)
    odd = [
        *rows[:40], (None, None, None, None), (None, 1, "user", None), (5000, None, "user", "First."), (5000, 3, "assistant", "Last."),
        (5001, 1, "user", "word " * 50000), (5001, 2, "assistant", "Same."), (5001, 2, "assistant", "Same."), (5002, 1, "", ""),
    ]
    schema = "conv_id long, turn long, role string, text string, key string, lines int"
    spark.createDataFrame([(*r, "k", 1) for r in odd], schema).coalesce(1).write.parquet(f"{tmp_path}/odd/conversations.parquet")
    assert {r["conv_id"]: tuple(r)[1:] for r in op12_rank_viterbi(spark, f"{tmp_path}/odd").collect()} == expected(odd)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_rank_viterbi(spark, f"{tmp_path}/none").count() == 0


def test_one_conversation_in_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t // 3, role, text) for t, (role, text) in enumerate(random_rows(rng, 900))]
    df = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))
    found = _repaired(df, False, 50, 6).collect()
    kept = damaged_plainly(rows)[1]
    assert [tuple(r)[1:] for r in found] == [summary([(r, t) for _, r, t in kept])]
