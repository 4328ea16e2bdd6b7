"""Projection, nearest points and neighbours against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import geometry, timeops


def foot(points, x, y):
    """The nearest segment by its own distance, then the open ends."""
    best = None
    segs = geometry.segments_of(points)
    for i, ax, ay, ux, uy, n, arc in segs:
        w = (x - ax) * ux + (y - ay) * uy
        u = min(max(w, 0.0), n)
        d = round(float(np.hypot(x - ax - u * ux, y - ay - u * uy)), 9)
        if best is None or d < best[0]:
            best = (d, i, arc + u, (y - ay) * ux - (x - ax) * uy, w, n, arc)
    d, i, s, side, w, n, arc = best
    if (i == 0 and w < 0) or (i == len(segs) - 1 and w > n):
        d, s = abs(side), arc + w
    return round(d, 6), i, round(s, 6), round(side, 6)


def projected(spark, points, xy, **kw):
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "k int, x double, y double")
    return geometry.project(df, points, **kw).orderBy("k").collect()


HOOK = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (-5.0, 10.0), (-5.0, -10.0)]


def test_foot_near_the_crossing_of_an_own_prolongation(spark):
    (r,) = projected(spark, HOOK, [(-4.9, 0.05)])
    assert r.foot.i == 3 and r.foot.dist == pytest.approx(0.1) and not r.beyond


def test_feet_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(-12, 15, (300, 2))
    for r, (x, y) in zip(projected(spark, HOOK, xy), xy, strict=True):
        assert (round(r.foot.dist, 6), r.foot.i, round(r.foot.s, 6), round(r.foot.lateral, 6)) == foot(HOOK, x, y)


def test_long_line_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    line = np.cumsum(rng.normal(size=(400, 2)), axis=0).tolist()
    xy = rng.uniform(-20, 20, (200, 2))
    for r, (x, y) in zip(projected(spark, line, xy), xy, strict=True):
        assert (round(r.foot.dist, 6), r.foot.i, round(r.foot.s, 6), round(r.foot.lateral, 6)) == foot(line, x, y)


def test_long_line_in_a_window_and_without_numbers(spark):
    line = [(float(k), float(k % 2)) for k in range(300)]
    df = spark.createDataFrame([(1, 50.0, 0.5, 60.0, 61.0), (2, 50.0, 0.5, 1e6, 2e6), (3, None, 0.5, 0.0, 9.0)], "k int, x double, y double, lo double, hi double")
    got = {r.k: r.foot for r in geometry.project(df, line, beyond=False, lo=F.col("lo"), hi=F.col("hi")).collect()}
    arcs = [s for s in geometry.segments_of(line) if s[6] <= 61.0 and s[6] + s[5] >= 60.0]
    assert got[1].i in {s[0] for s in arcs} and got[2] is None and got[3] is None


def test_20_000_segments(spark):
    t = np.linspace(0, 200, 20_001)
    line = list(zip((t * np.cos(t)).tolist(), (t * np.sin(t)).tolist(), strict=True))
    df = spark.range(100_000).select((F.rand(1) * 400 - 200).alias("x"), (F.rand(2) * 400 - 200).alias("y"))
    began = time.perf_counter()
    n, worst = geometry.project(df, line).agg(F.count("foot.s"), F.max("foot.dist")).first()
    assert n == 100_000 and worst < 200 and time.perf_counter() - began < 60


def test_vertex_rule_on_a_long_line(spark):
    rng = np.random.default_rng(5)
    line = np.cumsum(rng.normal(size=(200, 2)), axis=0).tolist()
    xy = rng.uniform(-15, 15, (100, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "k int, x double, y double")
    long = geometry.project_by_vertex(df, line).orderBy("k").collect()
    for r, (x, y) in zip(long, xy, strict=True):
        v = int(np.argmin([round((x - a) ** 2 + (y - b) ** 2, 9) for a, b in line]))
        assert r.vertex == v and r.foot.i in (v - 1, v)


def test_pose_on_a_long_line(spark):
    line = [(float(k), float(k % 3)) for k in range(200)]
    ways = [-5.0, 0.0, 3.3, 100.0, 1e9]
    df = spark.createDataFrame([(w,) for w in ways], "s double")
    long = {r.s: (round(r.px, 6), round(r.py, 6)) for r in geometry.pose_at(df, line).collect()}
    segs = geometry.segments_of(line)
    total = segs[-1][5] + segs[-1][6]
    for w in ways:
        at = min(max(w, 0.0), total)
        g = [s for s in segs if s[6] <= at][-1]
        assert long[w] == (round(g[1] + (at - g[6]) * g[3], 6), round(g[2] + (at - g[6]) * g[4], 6))


def test_nearest_point_without_a_limit(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 2)) * 5, rng.normal(size=(80, 2))
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)] + [(99, None, 0.0)], "row int, x double, y double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)], "point int, x double, y double")
    got = {r.row: (r.point, r.dist) for r in geometry.nearest_point(rows, points, cell=0.1).collect()}
    assert got.pop(99) == (None, None)
    for k, p in enumerate(a):
        d = np.hypot(*(b - p).T)
        assert got[k][0] == int(d.argmin()) and got[k][1] == pytest.approx(d.min(), abs=1e-8)
    assert geometry.nearest_point(rows, points.limit(0), cell=0.1).filter("point is null").count() == 61


def brute_sync(rows, slop, depth):
    """The synchroniser's stated rules, one at a time."""
    wait, out = {"a": [], "b": []}, []
    for stream, t, seq in rows:
        mine, theirs = wait[stream], wait["b" if stream == "a" else "a"]
        old = [m for m in mine if m[0] == t]
        if old:
            mine[mine.index(old[0])] = (t, seq)
        else:
            mine.append((t, seq))
        if len(mine) > depth:
            mine.remove(min(mine, key=lambda m: m[0]))
        near = [m for m in theirs if abs(m[0] - t) < slop]
        if (t, seq) in mine and near:
            closest = min(abs(m[0] - t) for m in near)
            other = next(m for m in near if abs(m[0] - t) == closest)
            mine.remove((t, seq))
            theirs.remove(other)
            out.append((seq, other[1]) if stream == "a" else (other[1], seq))
    return out


@pytest.mark.parametrize("depth", [2, 100])
def test_synchroniser_equals_its_rules(spark, depth):
    rng = np.random.default_rng(7)
    data = [(r, "ab"[int(rng.integers(2))], int(rng.integers(0, 60)), k) for r in range(8) for k in range(60)]
    df = spark.createDataFrame(data, "run long, stream string, t long, seq long")
    got = sorted((r.run, r.seq_first, r.seq_second) for r in timeops.synchronise(df, first="a", second="b", slop=4, depth=depth).collect())
    want = sorted((run, *p) for run in range(8) for p in brute_sync([(s, t, q) for r, s, t, q in data if r == run], 4, depth))
    assert got == want and want


def test_one_long_run_costs_a_row_a_row(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("run"), F.col("id").alias("seq"), (F.col("id") * 10).alias("t"), F.rand(1).alias("v")).persist()
    rows.count()

    def seconds(df):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    probe = rows.withColumn("t", F.col("t") + 5)
    seconds(timeops.asof(probe, rows))
    assert seconds(timeops.interpolate(probe, rows)) < 2 * seconds(timeops.asof(probe, rows)) + 1.0
