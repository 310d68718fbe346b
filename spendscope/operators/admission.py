"""Which requests a rate limiter lets through: one state machine per client over its requests in order.

A request of a banned client is refused and not counted. One with a forbidden agent, one over the burst limit and one over
the limit per minute of its tier are refused and are violations; only what passes fills the windows. Denied requests
(403) are failures. Enough violations or failures within their windows ban the client for a while, and their count starts
anew.

Requests are range-partitioned by client and time, so a client with a third of the log is spread over many tasks, each
with a stretch of its time, packed into pieces of bounded size. The state between two stretches is bounded by the limits.
Every stretch is first run from an empty state; where the one before ends in another state it is run again from that
one, until all states meet. As windows and bans pass, states agree again long before the end of a stretch, so two or
three rounds settle a log; each round settles at least one more stretch of every client, whatever the log.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("accepted", "denied", "blocked", "burst", "rate", "banned")
PIECE_ROWS = 50_000
SECOND = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Limits by tier: requests per window and per burst window. Times in seconds."""

    limits: Mapping[str, tuple[int, int]]
    window: int = 60
    burst_window: int = 5
    failures: int = 10
    failure_window: int = 600
    violations: int = 5
    violation_window: int = 300
    ban: int = 300


@dataclass
class Gate:
    """The state of one client. Windows hold times in microseconds."""

    rules: Rules
    banned_until: int = 0
    bursts: dict[str, deque] = field(default_factory=dict)
    passed: dict[str, deque] = field(default_factory=dict)
    broken: deque = field(default_factory=deque)
    failed: deque = field(default_factory=deque)

    @staticmethod
    def _fits(times: deque, now: int, seconds: int, limit: int) -> bool:
        _forget(times, now, seconds)
        if len(times) >= limit:
            return False
        times.append(now)
        return True

    def _mark(self, times: deque, now: int, seconds: int, limit: int) -> tuple[int, bool]:
        """Counts a failure or violation; how many there are now, and whether that bans."""
        _forget(times, now, seconds)
        times.append(now)
        n = len(times)
        if n >= limit:
            times.clear()
            self.banned_until = now + self.rules.ban * SECOND
        return n, n >= limit

    def admit(self, now: int, tier: str, denied: bool, blocked: bool) -> tuple[str, int, int, bool]:
        """(outcome, violations now, failures now, whether a ban begins)"""
        r = self.rules
        if now < self.banned_until:
            return "banned", 0, 0, False
        limit, burst = r.limits[tier]
        if blocked:
            outcome = "blocked"
        elif not self._fits(self.bursts.setdefault(tier, deque()), now, r.burst_window, burst):
            outcome = "burst"
        elif not self._fits(self.passed.setdefault(tier, deque()), now, r.window, limit):
            outcome = "rate"
        elif denied:
            n, ban = self._mark(self.failed, now, r.failure_window, r.failures)
            return "denied", 0, n, ban
        else:
            return "accepted", 0, 0, False
        n, ban = self._mark(self.broken, now, r.violation_window, r.violations)
        return outcome, n, 0, ban

    def dump(self, now: int) -> str | None:
        """What still matters at ``now``, as text; None if nothing does."""
        r = self.rules
        for windows, seconds in ((self.bursts, r.burst_window), (self.passed, r.window)):
            for times in windows.values():
                _forget(times, now, seconds)
        _forget(self.broken, now, r.violation_window)
        _forget(self.failed, now, r.failure_window)
        lists = [{t: list(w) for t, w in sorted(x.items()) if w} for x in (self.bursts, self.passed)]
        ban = self.banned_until if now < self.banned_until else 0
        state = [ban, *lists, list(self.broken), list(self.failed)]
        return json.dumps(state) if any(state) else None

    @classmethod
    def load(cls, rules: Rules, state: str | None) -> Gate:
        if state is None:
            return cls(rules)
        ban, bursts, passed, broken, failed = json.loads(state)
        return cls(rules, ban, *({t: deque(w) for t, w in x.items()} for x in (bursts, passed)), deque(broken), deque(failed))


def _forget(times: deque, now: int, seconds: int) -> None:
    while times and now - times[0] >= seconds * SECOND:
        times.popleft()


PACKED = "client string, stretch long, piece long, times binary, kinds binary"
_COUNTS = ", ".join(f"{o} long" for o in OUTCOMES)
RUN = f"client string, stretch long, state_in string, state_out string, {_COUNTS}, bans long, first_ban long, last_ban long, peak_failures long, peak_violations long"
_PEAKS = ("peak_failures", "peak_violations")


def _pack(rules: Rules, piece_rows: int):
    tiers = {t: i for i, t in enumerate(rules.limits)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, number = TaskContext.get().partitionId(), 0
        held: list[tuple[str, np.ndarray, np.ndarray]] = []  # stretches of one client

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if held:
                times, kinds = (np.concatenate([h[k] for h in held]) for k in (1, 2))
                number += 1
                yield pa.RecordBatch.from_pylist([{
                    "client": held[0][0], "stretch": stretch, "piece": number, "times": times.astype("<i8").tobytes(), "kinds": kinds.tobytes()
                }])
                held.clear()

        for batch in batches:
            clients = batch.column("client").to_pylist()
            times = batch.column("us").to_numpy()
            kinds = np.array([tiers[t] for t in batch.column("tier").to_pylist()], np.uint8)
            kinds |= (batch.column("denied").to_numpy(zero_copy_only=False).astype(np.uint8) << 6) | (batch.column("blocked").to_numpy(zero_copy_only=False).astype(np.uint8) << 7)
            at = 0
            while at < len(clients):
                room = piece_rows - sum(len(h[1]) for h in held)
                to = at
                while to < len(clients) and clients[to] == clients[at] and to - at < piece_rows:
                    to += 1
                if held and (held[0][0] != clients[at] or room <= 0):
                    yield from flush()
                    continue
                to = min(to, at + room)
                held.append((clients[at], times[at:to], kinds[at:to]))
                at = to
        yield from flush()

    return run


def _execute(rules: Rules):
    """Runs stretches whose pieces come in order; one row for each."""
    tiers = list(rules.limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, out, now = Gate(rules), None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([out | {"state_out": gate.dump(now)}], _arrow(RUN))

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if out is None or (out["client"], out["stretch"]) != (row["client"], row["stretch"]):
                    if out:
                        yield done()
                    gate = Gate.load(rules, row["state_in"])
                    out = {k: row[k] for k in ("client", "stretch", "state_in")} | dict.fromkeys((*OUTCOMES, "bans", *_PEAKS), 0) | {"first_ban": None, "last_ban": None}
                for now, kind in zip(np.frombuffer(row["times"], "<i8").tolist(), row["kinds"], strict=True):
                    outcome, violations, failures, ban = gate.admit(now, tiers[kind & 63], bool(kind & 64), bool(kind & 128))
                    out[outcome] += 1
                    out["peak_violations"] = max(out["peak_violations"], violations)
                    out["peak_failures"] = max(out["peak_failures"], failures)
                    if ban:
                        out["bans"] += 1
                        out["first_ban"] = now if out["first_ban"] is None else out["first_ban"]
                        out["last_ban"] = now
        if out:
            yield done()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def admissions(requests: DataFrame, rules: Rules, folder: str, piece_rows: int = PIECE_ROWS, partitions: int | None = None) -> DataFrame:
    """Per client: how many requests had which outcome, bans, their first and last begin, and the peaks that led there.

    ``requests``: client, event_time, request_id (orders requests of one moment), tier (one of the rules'), denied,
    blocked. Intermediate tables are written below ``folder``.
    """
    spark = requests.sparkSession
    keyed = requests.select(F.coalesce("client", F.lit("")).alias("client"), F.unix_micros("event_time").alias("us"), "request_id", "tier", "denied", "blocked")
    order = ["client", "us", "request_id"]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(count, *order).sortWithinPartitions(*order).select("client", "us", "tier", "denied", "blocked")
    placed.mapInArrow(_pack(rules, piece_rows), PACKED).write.parquet(f"{folder}/pieces")
    pieces, number, keys = spark.read.parquet(f"{folder}/pieces"), 0, ["client", "stretch"]

    def run(given: DataFrame) -> DataFrame:
        together = given.select("client", "stretch", "piece", "times", "kinds", "state_in").repartition(*keys)
        return together.sortWithinPartitions(*keys, "piece").mapInArrow(_execute(rules), RUN)

    run(pieces.withColumn("state_in", F.lit(None).cast("string"))).write.parquet(f"{folder}/round=0")
    before = F.lag("state_out").over(Window.partitionBy("client").orderBy("stretch"))
    while True:
        done = spark.read.parquet(f"{folder}/round={number}")
        open_ = done.select(*keys, "state_in", before.alias("true")).where(~F.col("state_in").eqNullSafe(F.col("true"))).select(*keys, F.col("true").alias("state_in"))
        if open_.isEmpty():
            break
        number += 1
        again = run(pieces.join(open_, keys))
        done.join(open_, keys, "left_anti").select(*again.columns).unionByName(again).write.parquet(f"{folder}/round={number}")
    when = lambda c: F.timestamp_micros(c)
    return done.groupBy("client").agg(
        *(F.sum(o).alias(o) for o in OUTCOMES), F.sum("bans").alias("bans"), when(F.min("first_ban")).alias("first_ban"), when(F.max("last_ban")).alias("last_ban"),
        *(F.max(p).alias(p) for p in _PEAKS),
    )
