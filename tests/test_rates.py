"""Increase and rate of counters against a plain version, and exact selection against sorting."""

import datetime

import numpy as np
import pytest

from leafmill.operators import rates, reports

START = datetime.datetime(2024, 1, 1)


def plain_increase(samples, at, size):
    inside = [(t, v) for t, v in samples if at - size < t <= at]
    if len(inside) < 2:
        return None
    grew = sum(b - a if b >= a else b for (_, a), (_, b) in zip(inside, inside[1:], strict=False))
    (first, value), (last, _) = inside[0], inside[-1]
    span, mean = last - first, (last - first) / (len(inside) - 1)
    left, right = first - (at - size), at - last
    left = mean / 2 if left >= 1.1 * mean else left
    left = min(left, span * value / grew) if grew > 0 else left
    return grew * (span + left + (mean / 2 if right >= 1.1 * mean else right)) / span


def test_increases(spark):
    """Resets, gaps, a series that begins late, and one with a single sample."""
    rng = np.random.default_rng(3)
    series = {}
    for name in "abc":
        t, v, out = 0, 0.0, []
        for _ in range(120):
            t += 60 if rng.random() < 0.8 else 300
            v = 0.0 if rng.random() < 0.05 else v + float(rng.integers(0, 4))
            out.append((t, v))
        series[name] = out
    series["d"] = [(7, 1.0)]
    rows = [(k, START + datetime.timedelta(seconds=t), v) for k, out in series.items() for t, v in out]
    got = {(r.s, (r["at"] - START).total_seconds()): r.increase for r in rates.increases(spark.createDataFrame(rows, "s string, ts timestamp, v double"), ["s"], 900, 300).collect()}
    want = {(k, at): x for k, out in series.items() for at in range(300, 40_000, 300) if (x := plain_increase(out, at, 900)) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scraped(spark):
    """Counters begin at nought in each life of the process, and stand still without events."""
    at = lambda s: START + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([("x", at(5), 2), ("x", at(10), 1), ("x", at(31), 1), ("x", at(45), 7), ("y", at(52), 1)], "s string, ts timestamp, n int")
    lives = spark.createDataFrame([(at(0), at(42)), (at(42), at(70))], "start timestamp, ending timestamp")
    got = sorted((r.s, (r.ts - START).total_seconds(), r.v) for r in rates.scraped(events, ["s"], 10, lives).collect())
    assert got == [("x", 10, 3), ("x", 20, 3), ("x", 30, 3), ("x", 40, 4), ("x", 50, 7), ("x", 60, 7), ("y", 60, 1)]


def test_rate_quantiles(spark):
    inf = float("inf")
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.5), ("a", 4.0, 6.0), ("a", inf, 6.0), ("b", 1.0, 0.0), ("b", inf, 0.0), ("c", 1.0, 1.0), ("c", inf, 10.0)]
    got = {(r.s, r.share): r.value for r in rates.rate_quantiles(spark.createDataFrame(rows, "s string, le double, rate double"), ["s"], (0.25, 0.5, 0.95)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {("a", 0.25): 0.75, ("a", 0.5): 2.5, ("a", 0.95): 3.85, ("c", 0.25): 1.0, ("c", 0.5): 1.0, ("c", 0.95): 1.0}


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_percentiles(spark, most):
    """Skewed, tied and few values, groups of very different sizes, nulls; narrowed again and again, and at once."""
    rng = np.random.default_rng(7)
    groups = {"even": rng.random(3000), "tied": rng.integers(0, 3, 900).astype(float), "skew": np.exp(rng.normal(0, 9, 2000)), "one": np.array([5.0]), "same": np.full(300, 2.5), "signed": np.append(-np.exp(rng.normal(0, 4, 800)), [0.0, 1e300, -1e300])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("none", None)]
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in reports.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], (0.0, 0.5, 0.95, 1.0), most).collect()}
    assert got == {k: tuple(float(np.sort(v)[min(int(len(v) * p), len(v) - 1)]) for p in (0.0, 0.5, 0.95, 1.0)) for k, v in groups.items()}
