"""Queries against their SQL on small logs that the test tables do not hold."""

import duckdb
import pytest

from sensorloom import plans
from sensorloom.sources import catalog, logs
from tests.compare import difference

TYPES = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"


@pytest.fixture
def differs(spark, tmp_path):
    """What a query and its SQL differ in on a log of rows ``(run, stamp, value)``, in order of arrival."""

    def run(name: str, rows: list[tuple], kind: str = "view", setting: str = "SET threads=1") -> str:
        con = duckdb.connect()
        con.sql(setting)
        con.sql("SET TimeZone='UTC'")
        con.sql(f"CREATE TABLE log ({TYPES})")
        if rows:
            con.executemany("INSERT INTO log VALUES (?, ?, ?, ?, ?, '{}')", [(i, t, r, kind, v) for i, (r, t, v) in enumerate(rows)])
        con.sql(f"COPY (SELECT * FROM log ORDER BY event_id) TO '{tmp_path}/events.parquet'")
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        return difference(spark, con, plans.queries()[name], plans.oracle_sql()[name], str(tmp_path))

    return run


def at(s: float) -> str:
    return f"2024-01-01 00:00:{s:09.6f}"


def test_rate_of_single_rows_and_of_one_stamp(differs):
    rows = [(1, at(1), 2.0), (2, at(1), 2.0), (2, at(3.5), 2.0), (2, at(4), 2.0), (3, at(7), 2.0), (3, at(7), 2.0), (4, None, 2.0), (4, None, 2.0), (None, at(1), 2.0), (None, at(2), 2.0)]
    assert differs("w32_rate_statistics", rows) == ""


def test_every_run_that_ends_so_is_listed(differs):
    rows = [(r, at(1), 2.0) for r in (12, 1012, 1012, 5012, 7012, 120, 1000012, -12, None)]
    assert differs("s7_catalog_resolution", rows) == ""


def test_a_full_name_is_found_among_many_that_end_so(spark):
    names = spark.createDataFrame([(n,) for n in ("a_12", "b_12", "c_12", "d_12", "12")], "name string")
    assert [r.name for r in catalog.resolve(names, "12").collect()] == ["12"]
    with pytest.raises(ValueError, match="several runs: a_12, b_12, c_12"):
        catalog.resolve(names, "_12")


def test_metadata_keeps_every_microsecond(differs):
    rows = [(run, f"2024-01-01 {run % 24:02}:30:17.{313040 + 7 * run:06}", 1.0) for run in range(200)]
    rows += [(91, "2024-01-01 11:36:57.313040", 1.0), (91, "2024-01-31 01:00:00.093915", 1.0)]
    assert differs("s8_metadata", rows) == ""


def test_metadata_of_odd_runs_and_times(differs):
    rows = [(-5, at(1), 1.0), (None, at(2), 1.0), (None, at(3), 1.0), (7, None, 1.0), (8, None, 1.0), (8, at(4), 1.0)]
    rows += [(9, "1960-02-03 04:05:06.000001", 1.0), (9, at(5.000002), 1.0), (10, "1500-01-01 00:00:00.000001", 1.0), (10, "9999-12-31 23:59:59.999999", 1.0), (2**62, at(6), 1.0)]
    assert differs("s8_metadata", rows) == ""


def test_metadata_of_an_empty_log(differs):
    assert differs("s8_metadata", []) == "no rows"


def test_metadata_nanoseconds_are_floored(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("duration:\n  nanoseconds: 1999\nstarting_time:\n  nanoseconds_since_epoch: -1\n")
    (r,) = logs.read_metadata(spark, str(tmp_path / "m.yaml")).collect()
    assert (r.start_us, r.duration_us) == (-1, 1)


#: A run that stands still from its 3rd to its 5th row, and one that ends standing.
STILL = [(run, at(10 * k + run), v) for run, vs in ((1, (150.0, 120.0, 90.0, 0.0, None, 230.0)), (2, (80.0, 0.0, 170.0, 0.0))) for k, v in enumerate(vs)]


def test_ways_shown_by_several_rows_count_at_the_last(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE log ({TYPES})")
    con.executemany("INSERT INTO log VALUES (?, ?, ?, 'click', ?, '{}')", [(i, t, r, v) for i, (r, t, v) in enumerate([*STILL, (None, at(1), 500.0)])])
    con.sql(f"COPY log TO '{tmp_path}/events.parquet'")
    got = {(r.run, r.way): r.reached_s - 1704067200 for r in plans.queries()["j25_inverse_interpolation"](spark, str(tmp_path)).collect()}
    points = {1: [(150, 1), (270, 11), (360, 41), (590, 51)], 2: [(80, 12), (250, 32)]}  # way, second
    want = {}
    for run, p in points.items():
        for way in range(100, int(p[-1][0]) + 1, 100):
            (w0, t0), (w1, t1) = max(((a, b) for a, b in zip(p, p[1:], strict=False) if a[0] <= way), default=(p[0], p[1]))
            want[run, way] = t0 if way <= w0 else int(t0 + (t1 - t0) * (way - w0) / (w1 - w0))
    assert got == want and len(want) == 7


def test_ways_shown_by_several_rows_agree_with_sql_that_sorts(differs):
    # so few rows are sorted stably; without the setting they are searched instead, and the first is taken
    assert differs("j25_inverse_interpolation", [*STILL, (None, at(1), 500.0)], "click", "SET asof_loop_join_threshold=0") == ""
