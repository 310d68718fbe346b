"""Exponential smoothing against the recursion written out, its bounds against simulation, and a back-test."""

import numpy as np

from spendscope.operators.smoothing import GRID, fit, forecast_sums


def written_out(y, m, alpha, beta, gamma):
    mean = sum(y[:m]) / m
    b = (sum(y[m : 2 * m]) / m - mean) / m
    level = mean + b * (m - 1) / 2
    s = [y[i] - (mean + b * (i - (m - 1) / 2)) for i in range(m)]
    squares = 0.0
    for t in range(m, len(y)):
        e = y[t] - (level + b + s[t % m])
        level, b = level + b + alpha * e, b + beta * e
        s[t % m] += gamma * e
        squares += e * e
    return squares, level, b, s


def series(rng, n, m):
    t = np.arange(n)
    return 50 + 0.3 * t + 8 * np.sin(2 * np.pi * t / m) + rng.normal(0, 2, n)


def test_fit_is_the_best_of_the_grid():
    rng = np.random.default_rng(1)
    for n, m in ((15, 7), (60, 7), (40, 12)):
        y = series(rng, n, m)
        tried = [(*written_out(list(y), m, *w), w) for w in GRID]
        squares, level, b, s, weights = min(tried, key=lambda x: x[0])
        found = fit(y, m)
        assert found.weights == weights and np.allclose([found.level, found.trend, found.variance], [level, b, squares / (n - m)])
        assert np.allclose(found.season, s)
        ahead = [max(0.0, level + h * b + s[(n + h - 1) % m]) for h in range(3, 10)]
        assert np.isclose(found.ahead(3, 9)[0], sum(ahead))
    assert fit(np.ones(14), 7) is None


def test_bounds_are_those_of_simulated_futures():
    rng = np.random.default_rng(2)
    found = fit(series(rng, 80, 7), 7)
    alpha, beta, gamma = found.weights
    sums = []
    for _ in range(4000):
        level, b, s, total = found.level, found.trend, found.season.copy(), 0.0
        for h in range(1, 13):
            at = (found.periods + h - 1) % 7
            e = rng.normal(0, np.sqrt(found.variance))
            if h >= 4:
                total += level + b + s[at] + e
            level, b = level + b + alpha * e, b + beta * e
            s[at] += gamma * e
        sums.append(total)
    mean, deviation = found.ahead(4, 12)
    assert abs(np.mean(sums) - mean) < 0.1 * deviation and abs(np.std(sums) / deviation - 1) < 0.06


def test_smoothing_beats_the_line_where_there_is_a_season():
    """Sums of the next ten days, from every day on: the mean error against that of a straight line through thirty days."""
    rng = np.random.default_rng(3)
    y = series(rng, 200, 7)
    smooth, line = [], []
    for n in range(90, 190):
        actual = y[n : n + 10].sum()
        smooth.append(abs(fit(y[n - 90 : n], 7).ahead(1, 10)[0] - actual))
        slope, base = np.polyfit(np.arange(30), y[n - 30 : n], 1)
        line.append(abs((base + slope * np.arange(30, 40)).sum() - actual))
    assert np.mean(smooth) < 0.8 * np.mean(line)


def test_many_series_in_groups(spark):
    rng = np.random.default_rng(4)
    ys = {f"s{i}": series(rng, 30 + i, 7) for i in range(5)} | {"short": np.ones(9), "gaps": series(rng, 40, 7)}
    rows = [(k, t, float(v)) for k, y in ys.items() for t, v in enumerate(y) if not (k == "gaps" and t in (3, 20))]
    df = spark.createDataFrame(rows, "series string, period int, value double")
    found = {r["series"]: r for r in forecast_sums(df, 7, 1, 5).collect()}
    ys["gaps"][[3, 20]] = 0
    assert set(found) == set(ys) and found["short"]["forecast"] is None and found["short"]["periods"] == 9
    for k, y in ys.items():
        if k != "short":
            mean, deviation = fit(y, 7).ahead(1, 5)
            assert np.allclose([found[k]["forecast"], found[k]["high"]], [mean, mean + 1.96 * deviation]) and found[k]["low"] == max(0.0, mean - 1.96 * deviation)
    assert forecast_sums(df.limit(0), 7, 1, 5).count() == 0
