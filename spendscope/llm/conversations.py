"""Conversation structure repair: faults of messages, and the cheapest edits that make a dialogue of them.

Messages are range-partitioned and sorted by conversation and turn, so that a conversation with a third of all rows is spread
over many tasks. A conversation that lies inside one partition is repaired there (see ``viterbi``). The first and the last
one of each partition, and those longer than a piece, are open: they leave the task as pieces, which are written once. For
them

* duplicates are found by the first piece of each digest of role and text, an aggregate with map-side combining;
* every piece runs backward from a speculative cost vector, the vectors (four numbers a piece) are compared in text order, and pieces whose assumed vector differs from the true one by more than a constant run again;
* each piece says where it would end from each of four states, so that all pieces know the state they begin in;
* all pieces are repaired at once. Only the SHA-256 of a conversation, which is sequential by its nature, is taken over
  its pieces in their order, one piece in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.common import cut, table
from spendscope.llm.viterbi import CLASS, END, KEEP_NONE, LETTERS, ROLE_OF_STATE, Costs, R, exits

PIECE_ROWS = 16_384
PIECE_BYTES = 4_000_000
PARTITION_BYTES = 16_000_000
SPACE = " \t\n\v\f\r"
FAULTS = ("blank", "duplicate", "truncated")
_GOOD = {"su", "ua", "au"}
_LINES = "array<struct<role: string, text: string, edit: string>>"
_LINES_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


class Messages:
    """Consecutive messages of one or more conversations, and their faults within these."""

    def __init__(self, keys: list, roles: list[str], texts: list[str], seen: frozenset[bytes] = frozenset()):
        """``seen``: digests of messages that stand before these in the (then only) conversation."""
        self.keys, self.roles, self.texts = keys, roles, texts
        n = len(keys)
        self.blank, self.duplicate, self.truncated = (np.zeros(n, bool) for _ in FAULTS)
        self.begins = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(n)], bool)
        before: set[tuple[str, str]] = set()
        for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
            if self.begins[i]:
                before = set()
            bare = text.rstrip(SPACE)
            if not bare:
                self.blank[i] = True
            elif (role, text) in before or (seen and digest(role, text) in seen):
                self.duplicate[i] = True
            elif bare[-1] not in ".!?":
                self.truncated[i] = True
            before.add((role, text))
        self.initials = [r[:1] for r in roles]
        pairs = [a + b not in _GOOD for a, b in zip(self.initials, self.initials[1:], strict=False)]
        self.illegal = np.array([False, *pairs], bool)[:n] & ~self.begins
        self.kind = np.array([CLASS.get(x, KEEP_NONE) for x in self.initials], np.int64)

    def costs(self, closed: bool, end=(0, 0, 0, 0)) -> Costs:
        last = np.append(self.begins[1:], closed)[: len(self.keys)]
        return Costs(self.kind, self.blank | self.duplicate, self.truncated, last, end)

    def repaired(self, costs: Costs, start: int = 0) -> Iterator[tuple[str, list[tuple[str, str, str]]]]:
        """For each conversation its audit and the messages that stay or are new, each with its edit."""
        inserted, what, to = costs.moves()
        begins = self.begins.copy()
        begins[:1] = False  # the first row is in the state given
        state = costs.states(to, begins, start)
        row = np.arange(costs.n)
        n_new, letter = inserted[row, state[:-1]].tolist(), what[row, state[:-1]].tolist()
        after, state = to[row, state[:-1]].tolist(), state.tolist()
        audit: list[str] = []
        lines: list[tuple[str, str, str]] = []
        begins, last = begins.tolist(), costs.last.tolist()
        for i, (new, how) in enumerate(zip(n_new, letter, strict=True)):
            if begins[i]:
                yield "".join(audit), lines
                audit, lines = [], []
            x = state[i]
            for _ in range(new):
                x = 3 if x == 2 else 2
                audit.append("I")
                lines.append((ROLE_OF_STATE[x], "", "I"))
            audit.append(LETTERS[how])
            if how == R:
                lines.append((ROLE_OF_STATE[3 if x == 2 else 2], self.texts[i], "R"))
            elif LETTERS[how] == "K":
                lines.append((self.roles[i], self.texts[i], "K"))
            if last[i]:  # complete what is begun
                x = after[i]
                while END[x]:
                    x = 3 if x == 2 else 2
                    audit.append("I")
                    lines.append((ROLE_OF_STATE[x], "", "I"))
        if self.keys:
            yield "".join(audit), lines


def digest(role: str, text: str) -> bytes:
    head = role.encode()
    return hashlib.blake2b(len(head).to_bytes(4, "little") + head + text.encode(), digest_size=16).digest()


def joined_lines(lines: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text, _ in lines).encode()


_COUNTS = ", ".join(f"{c} long" for c in (*FAULTS, "illegal"))
FIRST = f"key string, piece long, {_COUNTS}, cost long, audit string, sha string, lines {_LINES}, roles array<string>, texts array<string>, digests array<binary>"
_FIRST = pa.schema([
    ("key", pa.string()), ("piece", pa.int64()), *((c, pa.int64()) for c in (*FAULTS, "illegal", "cost")), ("audit", pa.string()), ("sha", pa.string()),
    ("lines", _LINES_TYPE), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())),
])


def _line_structs(lines):
    return [{"role": r, "text": t, "edit": e} for r, t, e in lines]


def _closed(m: Messages, whole: bool) -> Iterator[dict]:
    """Results of conversations that ``m`` holds from first to last message."""
    costs = m.costs(closed=True)
    first = np.flatnonzero(m.begins)
    sums = {c: np.add.reduceat(getattr(m, c).astype(np.int64), first).tolist() for c in (*FAULTS, "illegal")} if len(first) else {}
    for k, (audit, lines) in enumerate(m.repaired(costs)):
        yield {
            "key": m.keys[first[k]], **{c: s[k] for c, s in sums.items()}, "cost": int(costs.costs[first[k], 0]), "audit": audit,
            "sha": hashlib.sha256(joined_lines(lines)).hexdigest(), "lines": _line_structs(lines) if whole else None,
        }


def _open(m: Messages, piece: int) -> dict:
    digests = list(dict.fromkeys(digest(r, t) for r, t in zip(m.roles, m.texts, strict=True)))
    return {"key": m.keys[0], "piece": piece, "roles": m.roles, "texts": m.texts, "digests": digests}


def _first_pass(batches: Iterator[pa.RecordBatch], whole: bool, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that lie inside this partition; open ones leave as pieces."""
    partition, number = TaskContext.get().partitionId(), 0
    keys: list[str] = []
    roles: list[str] = []
    texts: list[str] = []
    size, given = 0, None  # of the held texts; the last conversation that left as a piece

    def out(upto: int, open_: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        m = Messages(keys[:upto], roles[:upto], texts[:upto])
        rows = [_open(m, (partition << 32) + number)] if open_ else list(_closed(m, whole))
        number += open_
        del keys[:upto], roles[:upto], texts[:upto]
        size = sum(map(len, texts))
        yield pa.RecordBatch.from_pylist(rows, _FIRST)

    def full() -> bool:
        return len(keys) >= piece_rows or size >= PIECE_BYTES

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal given
        begins = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
        if begins and (given is None or keys[0] == given):  # may go on from the partition before
            if len(begins) > 1 or final or full():
                given = keys[0]
                yield from out(begins[1] if len(begins) > 1 else len(keys), True)
                begins = [b - begins[1] for b in begins[1:]]
        if len(begins) > 1:
            yield from out(begins[-1], False)
            begins = [0]
        if begins and (final or full()):  # may go on in the next partition, or is longer than a piece
            given = keys[0]
            yield from out(len(keys), True)

    for batch in batches:
        for at in range(0, batch.num_rows, min(1024, piece_rows)):
            part = batch.slice(at, min(1024, piece_rows))
            keys += part.column("key").to_pylist()
            roles += part.column("role").to_pylist()
            new = part.column("text").to_pylist()
            texts += new
            size += sum(map(len, new))
            if full():
                yield from flush(False)
    yield from flush(True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Messages]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, Messages([row["key"]] * len(row["roles"]), row["roles"], row["texts"], frozenset(row["seen"] or ()))


VECTORS = "key string, piece long, assumed array<long>, costs array<long>, exits array<int>, settled boolean"
_VECTORS = pa.schema([("key", pa.string()), ("piece", pa.int64()), ("assumed", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("exits", pa.list_(pa.int32())), ("settled", pa.bool_())])
STITCHED = VECTORS + ", true array<long>, start int, cost long, last boolean"
_STITCHED = pa.schema([*_VECTORS, ("true", pa.list_(pa.int64())), ("start", pa.int32()), ("cost", pa.int64()), ("last", pa.bool_())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs before each piece, from the vector assumed behind it; settled ones keep theirs."""
    for row, m in _pieces(batches):
        if not row["settled"]:
            costs = m.costs(False, row["true"] or END)  # at first as if the conversation ended here
            row |= {"assumed": costs.end.tolist(), "costs": costs.costs[0].tolist(), "exits": exits(costs)}
        yield pa.RecordBatch.from_pylist([{c: row[c] for c in _VECTORS.names}], _VECTORS)


def _stitch(pieces: pa.Table) -> pa.Table:
    """One conversation's pieces in order: the vectors behind them, whether they differ by constants, first states, cost."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["piece"])
    behind = [*(r["costs"] for r in rows[1:]), END.tolist()]
    offset = 0
    for r, true in zip(reversed(rows), reversed(behind), strict=True):
        shift = np.array(true) - np.array(r["assumed"])
        offset += int(shift[0])
        r |= {"true": true, "settled": bool((shift == shift[0]).all())}
    state = 0
    for r in rows:
        r |= {"start": state, "cost": rows[0]["costs"][0] + offset, "last": r is rows[-1]}
        state = r["exits"][state]
    return pa.Table.from_pylist(rows, _STITCHED)


REPAIRED = f"key string, piece long, {_COUNTS}, initials array<string>, cost long, audit string, lines {_LINES}"
_REPAIRED = pa.schema([
    ("key", pa.string()), ("piece", pa.int64()), *((c, pa.int64()) for c in (*FAULTS, "illegal")), ("initials", pa.list_(pa.string())),
    ("cost", pa.int64()), ("audit", pa.string()), ("lines", _LINES_TYPE),
])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, m in _pieces(batches):
        costs = m.costs(row["last"], row["true"])
        audit, lines = next(m.repaired(costs, row["start"]))
        yield pa.RecordBatch.from_pylist([{
            "key": row["key"], "piece": row["piece"], **{c: int(getattr(m, c).sum()) for c in (*FAULTS, "illegal")},
            "initials": [m.initials[0], m.initials[-1]], "cost": row["cost"], "audit": audit, "lines": _line_structs(lines),
        }], _REPAIRED)


SUMMARY = f"key string, {_COUNTS}, cost long, audit string, sha string"
_SUMMARY = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in (*FAULTS, "illegal", "cost")), ("audit", pa.string()), ("sha", pa.string())])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over pieces that come sorted by conversation and place; of a conversation one piece is held at a time."""
    now, sha, audit = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**now, "audit": "".join(audit), "sha": sha.hexdigest()}], _SUMMARY)

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            lines = joined_lines([(x["role"], x["text"], x["edit"]) for x in row["lines"]])
            if now is None or now["key"] != row["key"]:
                if now is not None:
                    yield out()
                now = {c: row[c] for c in ("key", *FAULTS, "illegal", "cost")}
                sha, audit, empty = hashlib.sha256(), [], True
            else:
                for c in (*FAULTS, "illegal"):
                    now[c] += row[c]
                now["illegal"] += before + row["initials"][0] not in _GOOD
            if lines:
                sha.update(lines if empty else b"\n" + lines)
                empty = False
            audit.append(row["audit"])
            before = row["initials"][1]
    if now is not None:
        yield out()


def damage(conv_id: str = "conv_id", turn: str = "turn") -> Column:
    blank = F.lit(" ")
    return F.crc32(F.concat(F.coalesce(F.col(conv_id).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))) % 20


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, place, copy, role, text): what ``damage`` leaves of the rows. 0 drops a row, 1 empties its text,
    2 takes the ends of its sentences, 3 repeats it, 4 gives it to the user. Null roles and texts are one space."""
    blank = F.lit(" ")
    rows = df.select(
        "conv_id", "turn", F.monotonically_increasing_id().alias("place"), F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"), damage().alias("damage"),
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("damage <> 0").select(
        "conv_id", "turn", "place", F.explode(copies).alias("copy"), F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
    )


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair_conversations(df: DataFrame, whole: bool = False, piece_rows: int = PIECE_ROWS, partitions: int | None = None) -> DataFrame:
    """One row per conversation: conv_id, blank, duplicate, truncated, illegal, cost, audit, sha.

    ``df`` has conv_id, turn, role, text and may have place and copy, which order rows of one turn; else the order of
    reading does. Null turns come first, null roles and texts count as one space, rows without conv_id are one
    conversation. A role whose first letter is none of s, u, a, or that is empty, can't be kept. Repeated rows are
    duplicates. ``whole`` returns the repaired messages instead: conv_id, piece, place in it, role, text, edit;
    deleted ones are missing. Other columns are ignored. ``partitions``: by the bytes of the texts, unless given.
    """
    conv = df.select("conv_id", _key(F.col("conv_id")).alias("key")).distinct()
    return conv.join(_repaired(df, whole, piece_rows, partitions), "key").drop("key")


def _repaired(df: DataFrame, whole: bool, piece_rows: int, partitions: int | None) -> DataFrame:
    """As ``repair_conversations``, by key."""
    blank = F.lit(" ")
    for c, make in (("place", F.monotonically_increasing_id()), ("copy", F.lit(0))):
        if c not in df.columns:
            df = df.withColumn(c, make)
    rows = df.select(_key(F.col("conv_id")).alias("key"), "turn", "place", "copy", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    if not partitions:
        n_bytes = int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // PARTITION_BYTES))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("place"), F.col("copy")]
    placed = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    first = cut(placed.select("key", "role", "text").mapInArrow(lambda b: _first_pass(b, whole, piece_rows), FIRST))
    closed, pieces = first.where("roles IS NULL"), first.where("roles IS NOT NULL")

    told = pieces.select("key", "piece", F.explode("digests").alias("digest"))
    seen = told.groupBy("key", "digest").agg(F.min("piece").alias("first"))
    earlier = told.join(seen, ["key", "digest"]).where("piece > first").groupBy("key", "piece").agg(F.collect_list("digest").alias("seen"))
    pieces = cut(pieces.select("key", "piece", "roles", "texts").join(earlier, ["key", "piece"], "left"))

    nothing = {"true": "array<long>", "settled": "boolean", "assumed": "array<long>", "costs": "array<long>", "exits": "array<int>"}
    given = pieces.select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    while True:
        stitched = cut(given.mapInArrow(_run, VECTORS).groupBy("key").applyInArrow(_stitch, STITCHED))
        if stitched.where("NOT settled").isEmpty():
            break
        given = pieces.join(stitched, ["key", "piece"])
    repaired = pieces.join(stitched, ["key", "piece"]).mapInArrow(_repair, REPAIRED)
    if whole:
        both = closed.select("key", F.lit(0).cast("long").alias("piece"), "lines").unionByName(repaired.select("key", "piece", "lines"))
        return both.select("key", "piece", F.posexplode("lines").alias("place", "line")).select("key", "piece", "place", "line.*")
    summed = repaired.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_join_pieces, SUMMARY)
    return closed.select(*summed.columns).unionByName(summed)


def op12_rank_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    turn = F.when(damage() != 0, F.col("turn"))
    conv = given.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    found = _repaired(damaged(given), False, PIECE_ROWS, None)
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost"))
    return conv.withColumn("key", _key(F.col("conv_id"))).join(found, "key", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
