"""Sources and sinks outside of queries."""

from dataclasses import dataclass

import pytest

from sensorloom.sources import files, logs, messages


def test_log_files(tmp_path):
    (tmp_path / "b.db3").touch()
    (tmp_path / "a.db3").touch()
    assert logs.log_file(str(tmp_path)) == str(tmp_path / "a.db3") and logs.log_file("x/y.db3") == "x/y.db3"
    with pytest.raises(FileNotFoundError):
        logs.log_file(str(tmp_path / "none"))


def test_odometry_passes_over_what_it_has_no_name_for():
    data = messages.encode("Odometry", 5, 0, "map", {"x": 1.5, "qw": 1.0, "vx": 3.0, "wz": -2.0})
    t, frame, got = messages.decode("nav/Odometry", data)
    assert (t, frame, got["x"], got["qw"], got["vx"], got["wz"], len(got)) == (5_000_000, "map", 1.5, 1.0, 3.0, -2.0, 11)
    assert messages.decode("nav/Odometry", data[:-4]) is None


@dataclass
class P:
    a: int = 1
    b: float = 2.5
    c: str = "x"
    d: bool = True


def test_parameter_files_are_verified():
    text = files.write_params(P(), node="node", notes={"b": "a note"})
    assert "ros__parameters:" in text and "# a note" in text and files.verify_params(text, P()) == []
    assert len(files.verify_params(text, P(b=3.0))) == 1 and len(files.verify_params(text.replace("a: 1", "a: 1.0"), P())) == 1
    assert files.verify_params("a: 1\nz: 2\n", P())[-1] == "unknown: z"


def test_cache_skips_and_replaces_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", 1, 5.0), (2, "s", 2, 6.0)], "run long, stream string, seq long, v double")
    path = str(tmp_path / "cache")
    assert logs.write_cache(df.filter("run = 1"), path) == 1 and logs.write_cache(df, path) == 1 and logs.write_cache(df, path) == 0
    assert logs.write_cache(df.selectExpr("run", "stream", "seq", "v * 2 AS v"), path, force=True) == 2
    assert sorted((r.run, r.v) for r in logs.read_cache(spark, path).collect()) == [(1, 10.0), (2, 12.0)]
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("_new")]


def test_missing_metadata_is_null(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("nothing: here\n")
    (r,) = logs.read_metadata(spark, str(tmp_path / "m.yaml")).collect()
    assert r.start_us is None and r.duration_us is None
