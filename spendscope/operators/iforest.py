"""Isolation forest: trees grown in parallel from small samples, scoring in Arrow batches.

Growing: a hash of row and tree decides which rows a tree draws, about four times its sample, of which the
least draws are kept; ``applyInPandas`` grows one tree per group. A model thus has at most
``trees * (2 * sample - 1)`` nodes whatever the number of training rows, which bounds what is collected and
broadcast. Scoring maps over partitions without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.operators.quantiles import exact_percentiles

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, depth int, size int"


def path_length(n):
    """Mean depth of an unsuccessful search among ``n`` values, the normaliser of tree depths."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    many = n > 2
    out[many] = 2.0 * (np.log(n[many] - 1.0) + np.euler_gamma) - 2.0 * (n[many] - 1.0) / n[many]
    return out


def grow_tree(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random axis-parallel splits until single rows, equal rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or len(usable) == 0:
            nodes.append([tree, me, -1, 0.0, -1, -1, depth, len(rows)])
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(low[f], high[f]))
        at = at if at < high[f] else float(low[f])  # rounding must not leave the right side empty
        nodes.append([tree, me, f, at, -1, -1, depth, len(rows)])
        goes_left = x[rows, f] <= at
        todo += [(rows[~goes_left], depth + 1, me, True), (rows[goes_left], depth + 1, me, False)]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def _picked(hashed: Column, wanted: int, of: int) -> Column:
    """True for about ``wanted`` out of ``of`` hashes; for all when there are fewer."""
    spaces = 1_000_000_000_000
    return F.pmod(hashed, F.lit(spaces)) < math.ceil(wanted * spaces / max(of, wanted))


@dataclass(frozen=True)
class IsolationForest:
    features: Sequence[str]
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    seed: int = 42
    min_rows: int = 30

    def nodes(self, rows: DataFrame, id_cols: Sequence[str], row_count: int) -> DataFrame:
        """The grown trees as rows; a row's identity is the hash of ``id_cols``."""
        features, seed = list(self.features), self.seed
        key = F.xxhash64(F.lit(seed), *[F.col(c) for c in id_cols])
        # Each row decides by hashes which trees look at it, so no pool is gathered first. A tree sees about four
        # times its sample and keeps the least draws.
        draw = F.transform(
            F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("_key", t).alias("_draw"))
        )
        drawn = rows.select(*features, key.alias("_key")).select(
            *features, "_key", F.explode(F.filter(draw, lambda d: _picked(d["_draw"], 4 * self.sample, row_count))).alias("_d")
        ).select(*features, "_key", "_d.*")
        order = Window.partitionBy("tree").orderBy("_draw", "_key", *features)
        chosen = (
            drawn.repartition(max(1, self.trees // 4), "tree").withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= self.sample)
        )

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rn")
            return grow_tree(int(pdf["tree"].iloc[0]), pdf[features].to_numpy(dtype=float), seed)

        return chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)

    def fit(self, rows: DataFrame, id_cols: Sequence[str]) -> IsolationForestModel | None:
        """None when there are too few rows. Collects the model's bounded node table and one quantile."""
        rows = rows.select(*self.features, *[c for c in id_cols if c not in self.features]).persist()
        try:
            row_count = rows.count()
            if row_count < self.min_rows:
                return None
            nodes = self.nodes(rows, id_cols, row_count).toPandas()
            model = IsolationForestModel(tuple(self.features), nodes, 0.0)
            scored = model.normality(rows.select(*self.features)).select("normality").persist()  # read more than once
            try:
                mark = exact_percentiles(scored, [], "normality", {"mark": self.contamination}).first()["mark"]
            finally:
                scored.unpersist()
            return IsolationForestModel(tuple(self.features), nodes, float(mark))
        finally:
            rows.unpersist()


@dataclass(frozen=True)
class IsolationForestModel:
    features: Sequence[str]
    node_table: pd.DataFrame
    offset: float

    def normality(self, rows: DataFrame) -> DataFrame:
        """Rows with minus the anomaly score of the isolation forest paper: near 0 normal, near -1 not."""
        features = list(self.features)
        table = rows.sparkSession.sparkContext.broadcast(self.node_table)
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", normality double"

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            per_tree = [t.sort_values("node") for _, t in table.value.groupby("tree")]
            arrays = [[t[c].to_numpy() for c in ("feature", "split", "left", "right", "depth", "size")] for t in per_tree]
            sample = max((int(a[5][0]) for a in arrays), default=2)
            norm = float(path_length([max(sample, 2)])[0])
            for pdf in batches:
                x = pdf[features].to_numpy(dtype=float)
                depth_sum, at_row = np.zeros(len(x)), np.arange(len(x))
                for feature, split, left, right, depth, size in arrays:
                    node = np.zeros(len(x), dtype=int)
                    while True:
                        inner = feature[node] >= 0
                        if not inner.any():
                            break
                        at = node[inner]
                        goes_left = x[at_row[inner], feature[at]] <= split[at]
                        node[inner] = np.where(goes_left, left[at], right[at])
                    depth_sum += depth[node] + path_length(size[node])
                yield pdf.assign(normality=-np.power(2.0, -(depth_sum / max(len(arrays), 1)) / norm))

        return rows.mapInPandas(score, schema)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``if_score`` in [0, 1], 1 the most anomalous."""
        decision = F.col("normality") - F.lit(self.offset)
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(0.3) - decision) / 0.6))
        return self.normality(rows).withColumn("if_score", clipped).drop("normality")
