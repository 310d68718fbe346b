"""Exact top-k search by inner product with a pivot-distance index.

Vectors are lifted to one length (one more component takes up what each lacks of the longest), so that a larger inner
product with a query means a smaller distance to it. Each vector is keyed by its nearest pivot and its distance from
it, and stored in blocks that belong to one pivot and are sorted by distance. A query at distance d from a pivot with
a k-th best distance D so far needs, by the triangle inequality, only the annulus between d - D and d + D of a block.
It starts in a block of its own pivot, going outwards from d until D stops it, and takes the D it found to all blocks.

Pivots are drawn from the rows least by a hash of their id, at most ``PIVOTS`` of them; all rows are indexed and the
result is exact whatever the pivots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.llm.common import cut, map_arrow, shuffle_partitions, table

PIVOTS = 64
BLOCK = 2048  # vectors of a block
SHARE = 16  # blocks a group of the last search holds on average
QUERIES = 4096  # queries that meet a block at once
RING = 256  # vectors by which the first search widens
SLICE = 512  # queries of one matrix product
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def quantized(vectors: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component; missing ones of shorter vectors are zero."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class Space:
    """The pivots and the length that all vectors are lifted to."""

    pivots: np.ndarray
    longest2: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest2 - (x * x).sum(axis=1), 0))

    def data_distances(self, x: np.ndarray) -> np.ndarray:
        inner = x @ self.pivots.T + self.lift(x)[:, None] * self.lift(self.pivots)[None, :]
        return np.sqrt(np.maximum(2 * self.longest2 - 2 * inner, 0))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.longest2 - 2 * q @ self.pivots.T, 0))

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that belongs to an inner product; infinite where there is none yet. Rounded up."""
        inside = (q * q).sum(axis=1) + self.longest2 - 2 * np.where(np.isfinite(score), score, 0)
        return np.where(np.isfinite(score), np.sqrt(np.maximum(inside, 0)) * (1 + 1e-9) + 1e-6 * (1 + self.longest2**0.5), np.inf)


def products(q: np.ndarray, x: np.ndarray, space: Space) -> np.ndarray:
    """Inner products; in integers where doubles might round."""
    if space.longest2 < EXACT / 4:
        return q @ x.T
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best (score, vec_id) so far of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.of = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor, self.floor_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def wanted(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (queries x ids) enter a list."""
        floor, floor_id = self.floor[queries][:, None], self.floor_id[queries][:, None]
        return (scores > floor) | ((scores == floor) & (ids[None, :] < floor_id))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        of = np.concatenate([self.of, of])
        score = np.concatenate([self.score, score.astype(np.int64)])
        ids = np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.concatenate([first, [len(of)]])))
        keep = place < self.k
        last = place == self.k - 1
        self.floor[of[last]], self.floor_id[of[last]] = score[last], ids[last]
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]


@dataclass
class Block:
    """Vectors of one pivot, sorted by distance."""

    pivot: int
    ids: np.ndarray
    rows: np.ndarray
    distance: np.ndarray
    vectors: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        n = len(row["ids"]) // 8
        kind = {2: "<i2", 4: "<i4", 8: "<i8"}[row["width"]]
        return cls(
            row["pivot"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8"),
            np.frombuffer(row["distances"], "<f8"), np.frombuffer(row["vectors"], kind).reshape(n, -1).astype(np.float64),
        )


def packed(x: np.ndarray) -> tuple[int, bytes]:
    most = float(np.abs(x).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, x.astype(f"<i{width}").tobytes()


def scan(block: Block, low: np.ndarray, high: np.ndarray, queries: np.ndarray, q: np.ndarray, rows: np.ndarray, best: Best, space: Space) -> None:
    """Scores the places low ... high of the block for each of ``queries``."""
    for at in range(0, len(queries), SLICE):
        part = queries[at : at + SLICE]
        lo, hi = low[at : at + SLICE], high[at : at + SLICE]
        a, b = int(lo.min()), int(hi.max())
        if a >= b:
            continue
        scores = products(q[part], block.vectors[a:b], space)
        places = np.arange(a, b)[None, :]
        ok = (places >= lo[:, None]) & (places < hi[:, None]) & (block.rows[None, a:b] != rows[part][:, None])
        i, j = np.nonzero(ok & best.wanted(part, scores, block.ids[a:b]))
        best.add(part[i], scores[i, j], block.ids[a:b][j])


def start_search(block: Block, q: np.ndarray, rows: np.ndarray, best: Best, space: Space) -> None:
    """Widens each query's annulus from its own distance until the triangle inequality rules out the rest."""
    d = space.query_distances(q)[:, block.pivot]
    low = high = np.searchsorted(block.distance, d)
    queries, n = np.arange(len(q)), len(block.ids)
    while len(queries):
        new_low, new_high = np.maximum(low - RING, 0), np.minimum(high + RING, n)
        scan(block, new_low, low, queries, q, rows, best, space)
        scan(block, high, new_high, queries, q, rows, best, space)
        radius = space.radius(q[queries], best.floor[queries])
        down = (new_low > 0) & (block.distance[np.maximum(new_low - 1, 0)] >= d[queries] - radius)
        up = (new_high < n) & (block.distance[np.minimum(new_high, n - 1)] <= d[queries] + radius)
        go = down | up
        queries, low, high = queries[go], new_low[go], new_high[go]


def search(block: Block, q: np.ndarray, rows: np.ndarray, best: Best, space: Space) -> None:
    """All of the block that the radius known so far leaves."""
    d = space.query_distances(q)[:, block.pivot]
    radius = space.radius(q, best.floor)
    low = np.searchsorted(block.distance, d - radius, "left")
    high = np.searchsorted(block.distance, d + radius, "right")
    open_ = np.flatnonzero(low < high)
    order = open_[np.argsort(low[open_], kind="stable")]  # neighbours share a matrix product
    scan(block, low[order], high[order], order, q, rows, best, space)


_BLOCK = "pivot int, part int, ids binary, rows binary, distances binary, width int, vectors binary"
_FOUND = "row long, query_id long, vec_id long, score long"


def build_index(vectors: DataFrame, vec_id: str, vector: str, scale: float, pivots: int) -> tuple[DataFrame, Space, int]:
    """The keyed rows (row, vec_id, pivot, distance, width, vector), from checkpoint files, the space, and the dimension."""
    rows = vectors.where(finite(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("vector")
    )
    norm = F.aggregate(F.transform("vector", lambda x: F.floor(x * scale).cast("double")), F.lit(0.0), lambda t, x: t + x * x)
    most = rows.agg(F.max(F.size("vector")).alias("width"), F.max(norm).alias("longest2")).first()
    width, longest2 = most["width"] or 1, most["longest2"] or 0.0
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(pivots).select("vector").toArrow()
    points = np.unique(quantized(drawn["vector"].combine_chunks(), scale, width), axis=0) if drawn.num_rows else np.zeros((1, width))
    space = Space(points, longest2)

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = quantized(batch.column("vector"), scale, width)
        distance = space.data_distances(x)
        nearest = distance.argmin(axis=1)
        kinds = [packed(v) for v in x]
        return pa.RecordBatch.from_arrays([
            batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(x)), nearest]),
            pa.array([w for w, _ in kinds], pa.int32()), pa.array([v for _, v in kinds], pa.binary()),
        ], names=["vec_id", "pivot", "distance", "width", "vector"])

    keyed = map_arrow(rows, key, "vec_id long, pivot int, distance double, width int, vector binary")
    return cut(keyed.select(F.monotonically_increasing_id().alias("row"), "*")), space, width


def _vectors(table_: pa.Table) -> np.ndarray:
    parts = zip(table_["vector"].to_pylist(), table_["width"].to_pylist(), strict=True)
    return np.stack([np.frombuffer(v, f"<i{w}").astype(np.float64) for v, w in parts])


def blocks_of(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` vectors of one pivot; a crowded pivot has many."""

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by([("distance", "ascending"), ("vec_id", "ascending")])
        width, vectors = packed(_vectors(group))
        raw = {n: group[n].to_numpy().tobytes() for n in ("vec_id", "row", "distance")}
        return pa.table({
            "pivot": pa.array([group["pivot"][0].as_py()], pa.int32()), "part": pa.array([group["part"][0].as_py()], pa.int32()),
            "ids": pa.array([raw["vec_id"]], pa.binary()), "rows": pa.array([raw["row"]], pa.binary()),
            "distances": pa.array([raw["distance"]], pa.binary()), "width": pa.array([width], pa.int32()), "vectors": pa.array([vectors], pa.binary()),
        })

    return keyed.join(parts, "pivot").withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    ).drop("parts").groupBy("pivot", "part").applyInArrow(make, _BLOCK)


def shares_of(blocks: int, partitions: int) -> int:
    """Into how many groups the blocks are dealt: their number grows with the table, not their size."""
    return max(1, partitions, -(-blocks // SHARE))


def top_k(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row with all other rows.

    ``is_query`` is a condition on the column vec_id. Ties go to the smaller vec_id. Null vectors, empty ones and
    those with null or non-finite components take no part, nor do rows without vec_id; of vectors of several
    dimensions the missing components are zero. Repeated rows find each other, and a repeated query is answered
    once for each row, with ranks of its own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    keyed, space, _ = build_index(vectors, vec_id, vector, scale, pivots)
    parts = keyed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    blocks = cut(blocks_of(keyed, parts))
    queries = keyed.where(is_query)

    def begin(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.select(["row", "vec_id", "width", "vector"]).append_column("floor", pa.array([], pa.float64()))
        q, rows = _vectors(asked), asked["row"].to_numpy()
        best = Best(len(q), k)
        for row in block.to_pylist():
            start_search(Block.read(row), q, rows, best, space)
        return asked.append_column("floor", pa.array(best.floor)).select(
            ["row", "vec_id", "width", "vector", "floor"]
        )

    placed = queries.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int"))
    asked = cut(placed.drop("parts").groupBy("pivot", "part").cogroup(blocks.groupBy("pivot", "part")).applyInArrow(
        begin, "row long, vec_id long, width int, vector binary, floor double"
    ))
    n_sets = max(1, -(-asked.count() // QUERIES))
    shares = shares_of(blocks.count(), shuffle_partitions(spark))

    def answer(asked_: pa.Table, block: pa.Table) -> pa.Table:
        if not asked_.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "query_id", "vec_id", "score")})
        q, rows = _vectors(asked_), asked_["row"].to_numpy()
        best = Best(len(q), k)
        # What the first search found is found again here, so its k-th entry itself may enter.
        best.floor = asked_["floor"].to_numpy().copy()
        for row in block.to_pylist():
            search(Block.read(row), q, rows, best, space)
        return pa.table({
            "row": pa.array(rows[best.of]), "query_id": pa.array(asked_["vec_id"].to_numpy()[best.of]),
            "vec_id": pa.array(best.id), "score": pa.array(best.score),
        })

    spread = asked.select(F.pmod(F.xxhash64("row"), F.lit(n_sets)).cast("long").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
                          "row", "vec_id", "width", "vector", "floor")
    dealt = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))).alias("set"),
                          F.pmod(F.xxhash64("pivot", "part"), F.lit(shares)).cast("int").alias("share"), "*")
    found = spread.groupBy("set", "share").cogroup(dealt.groupBy("set", "share")).applyInArrow(answer, _FOUND)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
