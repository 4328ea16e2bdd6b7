import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import geo
from sensorloom.operators import aggregates, episodes, faults, fitting, geometry, recurrences, timeops
from sensorloom.sources import catalog, files, logs, messages
from sensorloom.streaming.steps import Config


def series(spark, rows, run=1):
    return spark.createDataFrame([(run, k, int(t), float(v)) for k, (t, v) in enumerate(rows)], "run long, seq long, t long, v double")


def test_nearest_prefers_the_earlier_of_two_and_includes_the_tolerance(spark):
    a, b = series(spark, [(100, 0), (200, 0), (305, 0)]), series(spark, [(90, 1), (110, 2), (195, 3), (300, 4), (300, 5)])
    got = [(r.t, r.r_v) for r in timeops.nearest(a, b, tol=10).orderBy("t").collect()]
    assert got == [(100, 1.0), (200, 3.0), (305, 5.0)]
    strict = {r.t: r.r_v for r in timeops.nearest(a, b, tol=10, strict=True).collect()}
    assert strict[100] is None and strict[200] == 3.0


@pytest.mark.parametrize("tol", [3, 40, 1000])
def test_buckets_do_not_change_the_nearest(spark, tol):
    rng = np.random.default_rng(1)
    ta, tb = np.sort(rng.integers(0, 5000, 150)), np.unique(rng.integers(0, 5000, 120))
    got = {r.seq: r.r_t for r in timeops.nearest(series(spark, [(t, 0) for t in ta]), series(spark, [(t, 1) for t in tb]), tol=tol).collect()}
    for k, t in enumerate(ta):
        best = min(tb, key=lambda x: (abs(x - t), x))
        assert got[k] == (best if abs(best - t) <= tol else None)


def test_interpolation_edges(spark):
    b = series(spark, [(0, 0), (10, 10), (20, 0)])
    q = series(spark, [(-5, 0), (0, 0), (4, 0), (15, 0), (20, 0), (30, 0)])
    at = lambda **k: [r.interp for r in timeops.interpolate(q, b, **k).orderBy("t").collect()]
    assert at() == [0.0, 0.0, 4.0, 5.0, 0.0, 0.0]
    assert at(clamp=False, half_open=True) == [None, 0.0, 4.0, 5.0, None, None]
    assert at(clamp=False, max_gap=4) == [None, 0.0, 4.0, None, 0.0, None]


def test_synchroniser_pairs_greedily(spark):
    rows = [(1, "a", 100, 0), (1, "b", 104, 1), (1, "b", 101, 2), (1, "a", 103, 3), (1, "a", 300, 4)]
    got = timeops.synchronise(spark.createDataFrame(rows, "run long, stream string, t long, seq long"), first="a", second="b", slop=5).collect()
    assert sorted((r.seq_first, r.seq_second) for r in got) == [(0, 1), (3, 2)]


def test_projection_round_trip(spark):
    rows = [(float(lat), float(lon)) for lat in (0.1, 31, 55.7, 70) for lon in (36.0, 39.0, 41.9)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    e, n = geo.utm(F.col("lat"), F.col("lon"), 39.0)
    la, lo = geo.utm_inverse(F.col("e"), F.col("n"), 39.0)
    for r in df.withColumn("e", e).withColumn("n", n).select("*", la.alias("la"), lo.alias("lo")).collect():
        assert abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-8
    x, y, z = geo.ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert [round(v, 6) for v in spark.range(1).select(x, y, z).first()] == [6378137.0, 0.0, 0.0]
    o = geo.local_enu(F.lit(55.0), F.lit(37.0), F.lit(120.0), 55.0, 37.0, 100.0)
    assert np.allclose(list(spark.range(1).select(*o).first()), [0, 0, 20], atol=1e-6)


def test_projection_on_a_polyline(spark):
    df = spark.createDataFrame([(5.0, 2.0), (12.0, 5.0), (-3.0, 1.0), (10.0, 14.0)], "x double, y double")
    got = [r.foot for r in geometry.project(df, [(0, 0), (10, 0), (10, 0), (10, 10)]).collect()]
    assert [(f.i, f.s, f.lateral) for f in got] == [(0, 5.0, 2.0), (1, 15.0, -2.0), (0, -3.0, 1.0), (1, 24.0, 0.0)]


def test_injected_errors_are_measured(spark):
    base = series(spark, [(k * 100, 10 + 0.1 * k) for k in range(200)])
    shifted = base.withColumn("v", F.col("v") + 0.5)
    m = timeops.nearest(base, shifted, tol=10).withColumn("e", F.col("r_v") - F.col("v")).agg(*aggregates.error_stats(F.col("e"))).first()
    assert (m.n, round(m.rmse, 9), round(m.bias, 9), round(m.max, 9)) == (200, 0.5, 0.5, 0.5)
    late = timeops.nearest(base, base.withColumn("t", F.col("t") + 11), tol=10)
    assert late.filter("r_t is not null").count() == 0


def test_recovery_and_islands(spark):
    rows = [(0, 9), (10, 9), (20, 0), (30, 9), (40, 0), (50, 0), (60, 0), (90, 0)]
    assert episodes.recovery(series(spark, rows), F.col("v") > 5, hold=25).first().recovered == 40
    ep = episodes.islands(series(spark, rows).filter("v = 0"), gap=20).orderBy("start").collect()
    assert [(e.start, e.stop, e.n) for e in ep] == [(20, 60, 4), (90, 90, 1)]


def test_short_runs_are_merged(spark):
    rows = [(0, 1), (10, 1), (20, 2), (22, 2), (30, 1), (60, 1), (70, 3), (99, 3)]
    got = episodes.merge_short_runs(series(spark, rows), F.col("v").cast("int"), least=5).orderBy("start").collect()
    assert [(r.start, r.stop, r.label) for r in got] == [(0, 60, "1"), (70, 99, "3")]


def test_recurrences(spark):
    s = series(spark, [(k * 1_000_000, v) for k, v in enumerate([0, 0, 10, 10, 10, 30, 10, 11])])
    lag = [r.filtered for r in recurrences.lag_filter(s, tau=1.0).orderBy("seq").collect()]
    assert math.isclose(lag[3], 10 * (1 - math.exp(-2)))
    assert [r.v for r in recurrences.keep_spaced(s, by="v", least=10).orderBy("seq").collect()] == [0, 10, 30, 10]
    assert [r.accepted for r in recurrences.reject_spikes(s, jump=15, per_second=0).orderBy("seq").collect()] == [True] * 5 + [False, True, True]
    assert [r.ramped for r in recurrences.ramp(s, rate=4).orderBy("seq").collect()][:5] == [0, 0, 4, 8, 10]


def test_faults_are_repeatable_and_confined(spark):
    df = series(spark, [(k * 1000, 20 + k) for k in range(100)]).withColumn("stream", F.lit("front"))
    f = faults.Fault("spikes", ("front",), 20_000, 50_000, amp=5.0, rate=0.5)
    a, b = ({r.seq: r.v for r in faults.inject(d, f).collect()} for d in (df, df.repartition(5)))
    hit = [k for k in a if a[k] != 20 + k]
    assert a == b and 10 < len(hit) < 40 and all(20 <= k < 70 for k in hit)
    with pytest.raises(ValueError):
        faults.Fault("explode")


def test_selectors(spark):
    names = spark.createDataFrame([("car_000012",), ("car_000112",), ("12",)], "name string")
    assert catalog.resolve(names, "12").first().name == "12"
    assert catalog.resolve(names, "0112").first().name == "car_000112"
    for bad in ("car", "012x"):
        with pytest.raises(ValueError):
            catalog.resolve(names, bad)
    with pytest.raises(ValueError):
        catalog.predicate("colour:red", {})


def test_messages_round_trip(spark):
    fields = {"VelocitySensor": {"v": 36.5}, "DriverControllerCommand": {"position": -8}, "TwistStamped": {n: 1.5 for n in ("vx", "vy", "vz", "wx", "wy", "wz")}, "NavSatFix": {"status": 2, "service": 9, "lat": 55.1, "lon": 37.2, "alt": 150.0, **{f"cov{i}": 0.1 * i for i in range(9)}, "cov_type": 1}}
    for kind, f in fields.items():
        for frame in ("", "a", "base"):
            got = messages.decode("pkg/msg/" + kind, messages.encode(kind, 1_700_000_000, 5000, frame, f))
            assert got == (1_700_000_000_000_005, frame, {k: float(v) for k, v in f.items()})
    assert messages.decode("pkg/msg/Image", b"1234") is None and messages.decode("x/VelocitySensor", b"\0\1\0\0\1") is None


def test_log_files_to_cache(spark, tmp_path):
    for run in ("a", "b"):
        con = sqlite3.connect(tmp_path / f"{run}.db3")
        con.execute("create table topics (id integer, name text, type text)")
        con.execute("create table messages (id integer, topic_id integer, timestamp integer, data blob)")
        con.executemany("insert into topics values (?, ?, ?)", [(1, "/front", "m/VelocitySensor"), (2, "/cmd", "m/DriverControllerCommand"), (3, "/image", "m/Image")])
        con.executemany("insert into messages values (?, ?, ?, ?)", [(k, 1 + k % 3, 1000 * (100 - k), messages.encode("VelocitySensor", 10, k, "f", {"v": k}) if k % 3 == 0 else messages.encode("DriverControllerCommand", 10, k, "f", {"position": k % 5})) for k in range(30)])
        con.commit()
        con.close()
    raw = logs.read_logs(spark, [str(tmp_path / "a.db3"), str(tmp_path / "b.db3")], ("/front", "/cmd"))
    samples = messages.wheel_samples(raw)
    assert raw.count() == 40 and samples.count() == 40
    logs.write_cache(samples.drop("fields"), str(tmp_path / "cache"))
    assert logs.read_cache(spark, str(tmp_path / "cache"), ("b",)).count() == 20


def test_small_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"points": [{"x": 1, "y": 2, "z": 3, "curv": 0}, {"x": 4, "y": 5, "z": 6, "curv": 0.1}]}')
    assert [(r.route, r.i, r.x) for r in files.read_route(spark, str(tmp_path / "r.json"), "out").collect()] == [("out", 0, 1.0), ("out", 1, 4.0)]
    (tmp_path / "l.json").write_text('{"east": {"from": "a", "to": "b", "branches": [{"name": "one", "x": [0, 1], "y": [2, 3], "z": [4, 5]}]}}')
    assert [(r.loop, r["from"], r.branch, r.k, r.z) for r in files.read_branches(spark, str(tmp_path / "l.json")).collect()] == [("east", "a", "one", 0, 4.0), ("east", "a", "one", 1, 5.0)]
    (tmp_path / "p.yaml").write_text("node:\n  ros__parameters:\n    agree: 0.5  # wider\n    resync: 7\n")
    c = files.with_values(Config(), files.read_params(str(tmp_path / "p.yaml")))
    assert (c.agree, c.resync) == (0.5, 7) and files.with_values(Config(), files.parse_sets("agree=0.5,resync=7")) == c
    (tmp_path / "q.yaml").write_text(files.write_params(c))
    assert files.with_values(Config(), files.read_params(str(tmp_path / "q.yaml"))) == c
    with pytest.raises(KeyError):
        files.with_values(c, {"nope": 1})
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "run long, x double")
    files.report_json(df, str(tmp_path / "r2.json"))
    assert "null" in (tmp_path / "r2.json").read_text() and "| 2 | 0.5 |" in files.report_markdown(df)


def test_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    rows = [(1.0, float(a), float(b), float(3 + 2 * a - b)) for a, b in x]
    eq = aggregates.normal_equations(spark.createDataFrame(rows, "c double, a double, b double, y double"), ["c", "a", "b"], "y")
    coef, rss = fitting.solve(eq, ridge=1e-9)
    assert np.allclose(coef, [3, 2, -1]) and abs(rss) < 1e-6
    t = np.linspace(0, 5, 60)
    fit = fitting.least_squares(lambda p: p[0] * np.exp(-t / p[1]) - 2 * np.exp(-t / 1.5), np.array([1.0, 0.5]), np.array([0.1, 0.1]), np.array([10.0, 10.0]))
    assert np.allclose(fit, [2, 1.5], atol=1e-5)
