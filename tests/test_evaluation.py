import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorloom.operators import evaluation, geometry

LINE = [(0.0, 0.0), (50.0, 0.0), (100.0, 20.0)]
TWO = {"low": LINE, "high": [(0.0, 10.0), (50.0, 10.0), (100.0, 30.0)]}


def test_alignment_finds_the_branch_and_place(spark):
    rows = [(1, k, k * 10, 20 + 0.1 * (k % 3), 9.5 + 0.05 * (k % 2)) for k in range(8)]  # on the upper branch
    rows += [(2, k, k * 10, 40.0, -3.0) for k in range(6)]  # near the lower one
    rows += [(3, k, k * 10, 40.0, -40.0) for k in range(6)] + [(4, 0, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run long, seq long, t long, x double, y double")
    got = {r.run: r for r in evaluation.align(df, TWO, window=1000, least=3, near=1.0, far=5.0).collect()}
    assert (got[1].rule, got[1].branch) == ("onmap", "high") and abs(got[1].s - 20.1) < 0.2
    assert (got[2].rule, got[2].branch, got[2].s) == ("near", "low", 40.0)
    assert got[3].rule == "free" and got[3].branch is None and got[4].rule == "none"


def test_ties_between_branches_go_to_the_first(spark):
    df = spark.createDataFrame([(25.0, 5.0)], "x double, y double")
    assert evaluation.project_over(df, TWO).first().best.branch == "low"


def test_on_map_errors_equal_what_was_injected(spark):
    rows = [(1, float(k), float(k) + 2.0, 1.0) for k in range(5, 40)]
    df = spark.createDataFrame(rows, "run long, s_true double, x double, y double")
    r = evaluation.on_map_summary(df, LINE, s_true="s_true", gate=5.0).first()
    assert (r.n_on_map, round(r.along_mean, 9), round(r.along_rmse, 9), round(r.cross_mean, 9)) == (35, 2.0, 2.0, 1.0)
    far = evaluation.on_map_summary(df.withColumn("y", F.lit(9.0)), LINE, s_true="s_true", gate=5.0).first()
    assert far.n_on_map == 0 and far.along_mean is None and far.off_max > 5


def test_template_moves_to_the_median(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), float(1.5 + rng.normal(0, 0.2))) for x in rng.uniform(0, 100, 800)]
    moved = evaluation.median_template(spark.createDataFrame(rows, "x double, y double"), [(float(k), 0.0) for k in range(0, 101, 10)], step=10.0, passes=2)
    assert max(abs(y - 1.5) for _, y in moved) < 0.15


def test_tracks_cluster_by_distance():
    x = np.linspace(0, 100, 60)
    tracks = {"a": np.c_[x, 0 * x], "b": np.c_[x, 0 * x + 0.4], "c": np.c_[x, 0 * x + 30]}
    got = evaluation.cluster_tracks(tracks, 2.0)
    assert got["a"] == got["b"] != got["c"]


def test_estimators_can_be_added(spark):
    @evaluation.estimator("constant")
    def constant(pdf: pd.DataFrame, options) -> pd.DataFrame:
        return pdf.assign(v=float(options["v"]))

    m = spark.createDataFrame([(1, 0, 0, "front", 3.0), (1, 1, 10, "rear", 5.0), (2, 0, 0, "cmd", 1.0)], "run long, seq long, t long, stream string, value double")
    assert {r.v for r in evaluation.replay(m, "constant", {"v": 2.5}).collect()} == {2.5}
    assert [(r.run, r.seq, r.v) for r in evaluation.replay(m, "hold_mean").orderBy("run", "seq").collect()] == [(1, 0, 3.0), (1, 1, 4.0), (2, 0, None)]
    del evaluation.ESTIMATORS["constant"]


def test_points_within_a_radius_only(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 10, (80, 2)), rng.uniform(0, 10, (60, 2))
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "row long, x double, y double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)], "point long, x double, y double")
    got = {r.row: r.point for r in geometry.nearest_point(rows, points, radius=0.8).collect()}
    for k, p in enumerate(a):
        d = np.sqrt(((b - p) ** 2).sum(axis=1))
        assert got.get(k) == (int(d.argmin()) if d.min() <= 0.8 else None)
