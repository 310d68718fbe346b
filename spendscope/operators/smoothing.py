"""Exponential smoothing with trend and season, and bounds for what it predicts; many series at once.

The additive form by its errors: with e the error of the one-step forecast, the level moves by alpha * e, the trend by beta *
e, the season's term by gamma * e. Level, trend and season begin with the first two seasons; errors count from the
second season on. Of a fixed grid of weights those with the least sum of squared errors are taken, of equals the first.
Each series is one group of as many rows as it has periods.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.05, 0.2), (0.0, 0.1, 0.3)
GRID = tuple((a, b, g) for a in ALPHAS for b in BETAS if b < a for g in GAMMAS)
Z95 = 1.96


@dataclass(frozen=True)
class Fit:
    level: float
    trend: float
    season: np.ndarray  # by period modulo the season's length
    weights: tuple[float, float, float]
    variance: float  # of one-step errors
    periods: int

    def ahead(self, first: int, last: int) -> tuple[float, float]:
        """The sum of the forecasts ``first`` to ``last`` periods ahead, each at least 0, and its standard deviation."""
        m = len(self.season)
        steps = np.arange(first, last + 1)
        values = self.level + steps * self.trend + self.season[(self.periods + steps - 1) % m]
        alpha, beta, gamma = self.weights
        k = np.arange(last)
        effect = np.where(k == 0, 1.0, alpha + beta * k + gamma * (k % m == 0))  # of an error, k periods later
        total = np.cumsum(effect)
        shock = np.arange(1, last + 1)  # an error at that step moves all forecasts of the sum from there on
        moved = total[last - shock] - np.where(shock < first, total[np.maximum(first - shock - 1, 0)], 0.0)
        return float(np.maximum(values, 0.0).sum()), float(np.sqrt(self.variance * (moved**2).sum()))


def fit(y: np.ndarray, season: int) -> Fit | None:
    """None with fewer than two seasons and a period."""
    m, n = season, len(y)
    if n < 2 * m + 1:
        return None
    alpha, beta, gamma = (np.array([w[i] for w in GRID]) for i in range(3))
    mean = y[:m].mean()
    trend = np.full(len(GRID), (y[m : 2 * m].mean() - mean) / m)
    middle = (m - 1) / 2
    terms = np.tile(y[:m] - (mean + trend[0] * (np.arange(m) - middle)), (len(GRID), 1))
    level, squares = mean + trend * middle, np.zeros(len(GRID))
    for t in range(m, n):
        error = y[t] - (level + trend + terms[:, t % m])
        level, trend = level + trend + alpha * error, trend + beta * error
        terms[:, t % m] += gamma * error
        squares += error * error
    best = int(squares.argmin())
    return Fit(float(level[best]), float(trend[best]), terms[best], GRID[best], float(squares[best]) / (n - m), n)


def forecast_sums(series: DataFrame, season: int, first: int, last: int) -> DataFrame:
    """(series, periods, alpha, beta, gamma, forecast, low, high): sums of the forecasts ``first`` to ``last`` periods ahead.

    ``series`` has series, period (whole numbers) and value; periods without a row between the first and the last count
    as 0. Bounds hold 95 of 100 sums if errors are normal. Where a series is too short everything but periods is NULL.
    """
    def run(rows: pa.Table) -> pa.Table:
        period = rows["period"].to_numpy()
        y = np.zeros(int(period.max() - period.min()) + 1)
        np.add.at(y, period - period.min(), rows["value"].to_numpy())
        found = fit(y, season)
        out = [None] * 6
        if found:
            mean, deviation = found.ahead(first, last)
            out = [*found.weights, mean, max(0.0, mean - Z95 * deviation), mean + Z95 * deviation]
        columns = {"series": pa.array([rows["series"][0].as_py()], pa.string()), "periods": pa.array([len(y)], pa.int64())}
        columns |= {n: pa.array([v], pa.float64()) for n, v in zip(("alpha", "beta", "gamma", "forecast", "low", "high"), out, strict=True)}
        return pa.table(columns)

    given = series.selectExpr("series", "CAST(period AS BIGINT) AS period", "CAST(value AS DOUBLE) AS value")
    return given.groupBy("series").applyInArrow(
        run, "series string, periods long, alpha double, beta double, gamma double, forecast double, low double, high double"
    )
