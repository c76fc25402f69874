"""Ordered operators against their plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import ordered, radio, stats


def test_peaks_are_those_of_the_fold(spark):
    rng = random.Random(1)
    rows = [(k, f, rng.choice([rng.uniform(-5, 5), 1.0])) for k in range(4) for f in range(200) if rng.random() < 0.8]
    got = {(r["k"], r["f"]) for r in ordered.decayed_peaks(spark.createDataFrame(rows, "k int, f int, m double"), ["k"], "f", "m").collect()}
    want = set()
    for k in range(4):
        level, last = -math.inf, 0
        for _, f, m in sorted(r for r in rows if r[0] == k):
            level -= 0.08 * (f - last)
            last = f
            if m >= level - 1e-12:
                want.add((k, f))
                level = max(level, m)
    assert got == want


def test_fan_out_is_the_plain_walk(spark):
    rng = random.Random(2)
    peaks = sorted({(rng.randint(0, 300), b) for _ in range(150) for b in [rng.randint(0, 5)]})
    got = sorted((r["anchor_frame"], r["anchor"], r["target"], r["delta"]) for r in ordered.fan_out(spark.createDataFrame([(1, f, b) for f, b in peaks], "id int, f int, b int"), ["id"], "f", "b", "b").collect())
    want = []
    for i, (f, b) in enumerate(peaks):
        later = [(g, c) for g, c in peaks[i + 1 :] if 1 <= g - f <= 63][:4]
        want += [(f, b, c, g - f) for g, c in later]
    assert got == sorted(want)


def test_limiter(spark):
    rows = [(1, i, x) for i, x in enumerate([1, 1] + [0] * 9 + [1] * 10 + [0] * 3)] + [(2, i, 0) for i in range(5)]
    got = ordered.limiter(spark.createDataFrame(rows, "k long, event_id long, hit int").withColumn("hit", F.col("hit") == 1), "k", ["event_id"], "hit", recover_after=2).orderBy("key", "event_id").collect()
    one = [r["slots"] for r in got if r["key"] == 1]
    assert one[:2] == [4, 2] and one[10] == 6 and one[20] == 2 and one[-1] == 3
    assert [r["slots"] for r in got if r["key"] == 2] == [8] * 5
    assert [r["backoff"] for r in got if r["key"] == 1][11:17] == [5, 10, 20, 40, 60, 60]


def test_running_statistics(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.uniform(0, 9)) for k in range(3) for i in range([1, 5, 3000][k])]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    got = {r["k"]: r["ewma"] for r in ordered.ewma(df, ["k"], ["i"], "x").collect()}
    for k in range(3):
        mean = None
        for _, _, x in sorted(r for r in rows if r[0] == k):
            mean = x if mean is None else 0.7 * mean + 0.3 * x
        assert got[k] == pytest.approx(mean)
    values = sorted(x for _, _, x in rows)
    n = len(values)
    found = {r["name"]: r["x"] for r in ordered.order_statistics(df, "x", {"low": lambda n: 0, "p10": lambda n: n // 10, "mid": lambda n: n // 2, "top": lambda n: n - 1}).collect()}
    assert found == {"low": values[0], "p10": values[n // 10], "mid": values[n // 2], "top": values[-1]}
    ties = spark.createDataFrame([(x,) for x in [1.0] * 50 + [2.0] * 5], "x double")
    assert ordered.order_statistics(ties, "x", {"m": lambda n: n // 2, "t": lambda n: n - 1}).orderBy("name").collect() == [("m", 1.0), ("t", 2.0)]
    assert ordered.order_statistics(ties.where("false"), "x", {"m": lambda n: 0}).count() == 0


def test_best_cut(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(y, 0.8), 6), y) for y in [rng.randint(0, 1) for _ in range(200)]]
    got = stats.best_cut(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    ys = [y for _, y in sorted(rows)]
    assert got["n"] == 200 and got["accuracy"] == pytest.approx(max((ys[:k].count(0) + ys[k:].count(1)) / 200 for k in range(201)))


def test_frames_and_segments(spark):
    df = spark.createDataFrame([([float(i) for i in range(n)],) for n in (0, 3, 4, 9, 10)], "x array<double>")
    got = df.select(F.size(ordered.frames(F.col("x"), 4, 3)).alias("n"), ordered.padded_segments(F.col("x"), 4, 3).alias("s")).collect()
    assert [r["n"] for r in got] == [0, 0, 1, 2, 3]
    assert [len(r["s"]) for r in got] == [1, 1, 1, 3, 3] and got[3]["s"][-1] == [6.0, 7.0, 8.0, 0.0]


def test_walk_and_neighbours(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 0.4, (60, 6))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, " + ", ".join(f"{c} double" for c in radio.COORDINATES))
    apart = lambda a, b: math.sqrt(sum(w * (a[i] - b[i]) ** 2 for i, w in enumerate([1.6, 1.3, 0.8, 1.0, 0.6, 0.6])))
    here, left, want = 7, set(range(60)) - {7}, []
    for _ in range(8):
        nxt = min(left, key=lambda j: apart(points[here], points[j]))
        if apart(points[here], points[nxt]) > 0.3:
            break
        want.append(nxt)
        left.discard(nxt)
        here = nxt
    assert [r["id"] for r in radio.walk(df, "id", 7, 8, farthest=0.3).orderBy("step").collect()] == want
    near = radio.neighbours(df.where("id < 3"), df, "id", 4).orderBy("query", "rank").collect()
    for q in range(3):
        order = sorted((j for j in range(60) if j != q), key=lambda j: apart(points[q], points[j]))[:4]
        assert [r["id"] for r in near if r["query"] == q] == order
