import json
import random
from dataclasses import replace
from math import inf, isfinite, nan

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.streaming import runner, steps
from sensorloom.streaming.steps import FORWARD, INVALID, LATE, OK, Config, State, Track, check_clock

C = Config()


def drive(seconds=30.0, v=lambda t: 10.0):
    """Wheel pairs at 10 Hz, 40 ms late, commands at 20 Hz: (arrival, stream, t, value)."""
    rows = []
    for k in range(int(seconds * 20)):
        t = 1000.0 + k * 0.05
        rows.append((t + 0.001, "cmd", t, 0.0))
        if k % 2 == 0:
            rows += [(t + 0.040, "front", t, v(t)), (t + 0.0401, "rear", t, v(t))]
    return [r[1:] for r in sorted(rows)]


def flags(rows):
    s = State()
    return [check_clock(s, C, stream, t) for stream, t, _ in rows]


def test_clean_clock():
    rows = drive()
    assert all(f == OK and e == t for (e, f), (_, t, _) in zip(flags(rows), rows))


def test_one_stamp_ahead_is_pulled_back():
    rows = drive(10)
    rows[200] = (rows[200][0], rows[200][1] + 5.0, 0.0)
    got = flags(rows)
    assert got[200][1] == FORWARD and got[200][0] < rows[200][1]
    assert [f for _, f in got].count(FORWARD) == 1 and all(f == OK for _, f in got[210:])


def test_all_streams_jump_together():
    rows = [(s, t + (3.0 if k >= 200 else 0.0), v) for k, (s, t, v) in enumerate(drive(20))]
    got = flags(rows)
    assert sum(f == FORWARD for _, f in got) <= 3 and all(f == OK for _, f in got[230:])


def test_one_stream_offset_is_accepted_after_a_while():
    rows = [(s, t + (2.0 if s == "cmd" and k > 100 else 0.0), v) for k, (s, t, v) in enumerate(drive(20))]
    got = [f for (_, f), (s, _, _) in zip(flags(rows), rows) if s == "cmd"]
    assert got.count(FORWARD) == C.resync


def test_late_and_invalid_stamps():
    s = State()
    check_clock(s, C, "cmd", 100.0)
    assert check_clock(s, C, "front", 99.0) == (99.0, LATE)
    assert [check_clock(s, C, "rear", t)[1] for t in (nan, inf, -1.0, 0.0, None)] == [INVALID] * 5


@pytest.mark.parametrize("seed", range(40))
def test_clock_invariants(seed):
    r, s, last = random.Random(seed), State(), None
    for stream, t, _ in drive(20):
        t += r.choice([0, 0, 0, 0, 5, -5, 0.5, -0.2, r.uniform(-1, 1)])
        e, f = check_clock(s, C, stream, t)
        assert f in (OK, FORWARD, LATE)
        assert (e == t) if f != FORWARD else (e < t)
        assert f != LATE or e < s.now
        assert last is None or s.now >= last
        last = s.now


def run(rows, c=C):
    s, out = State(), []
    for stream, t, v in rows:
        out.append(steps.message(s, c, stream, t, v))
    return out


def test_agreeing_sensors():
    out = run(drive(10, lambda t: 8.0))
    assert abs(out[-1][2] - 8.0) < 0.1 and any(o[4] == "both" for o in out) and not any(o[5] for o in out)


def test_spinning_wheel_is_flagged_and_outvoted():
    # no wheel reads exactly the same for long: one that did would count as frozen
    rows = [(s, t, v * (1.4 if s == "front" and t > 1005 else 1.0)) for s, t, v in drive(10, lambda t: 10.0 + 0.01 * ((t * 20) % 3))]
    out = run(rows)
    after = [o for o, (s, t, _) in zip(out, rows) if t > 1006 and s != "cmd"]
    assert sum(o[5] for o in after) > 0.9 * len(after) and abs(out[-1][2] - 10.0) < 1.0


def test_stuck_zero_and_lone_sensor():
    rows = [(s, t, 0.0 if s == "rear" else v) for s, t, v in drive(5)]
    assert {o[4] for o in run(rows)[50:]} <= {"single_front", "none"}
    rows = [r for r in drive(5) if r[0] != "rear"]
    assert {o[4] for o in run(rows)} <= {"single_front", "none"}


def test_a_spike_is_rejected_unless_both_see_it():
    rows = drive(5)
    k = next(i for i, r in enumerate(rows) if i > 60 and r[0] == "front")
    rows[k] = ("front", rows[k][1], 40.0)
    assert max(o[2] for o in run(rows)) < 11


def test_ramp_is_followed():
    rows = drive(30, lambda t: max(0.0, min(12.0, t - 1000.0)))
    out = run(rows)
    errors = [abs(o[2] - max(0.0, min(12.0, t - 1000.0))) for o, (_, t, _) in zip(out, rows) if t > 1002]
    assert max(errors) < 1.0 and sum(errors) / len(errors) < 0.2


@pytest.mark.parametrize("seed", range(30))
def test_random_messages_stay_finite(seed):
    r, t, rows = random.Random(seed), 1000.0, []
    for _ in range(400):
        t += r.choice([0.0, 0.05, 0.1, 1.0, 12.0])
        rows.append((r.choice(["front", "rear", "cmd"]), t + r.uniform(-0.3, 0.3), r.choice([0.0, 5.0, 20.0, 99.0, 500.0, -3.0, nan, None])))
    for _, _, v, var, state, *_ in run(rows):
        assert 0 <= v < 200 and 0 < var < 1e9 and state in ("none", "both", "disagree", "single_front", "single_rear")


def consensus_by_hand(rows):
    """Flags from the stated rules, each time from the whole history of messages."""
    seen, out = [], []
    for stream, t, _ in rows:
        if t is None or not isfinite(t) or t <= 0:
            out.append((t, INVALID))
            continue
        n = len(seen)
        newest = {}
        for k, (name, raw, _, _) in enumerate(seen):
            if name != stream:
                newest[name] = (k, raw)
        live = [raw for k, raw in newest.values() if n - k <= C.consensus]
        clocks = [e for _, _, e, f in seen if f != LATE]
        now = max(clocks, default=-inf)
        own = [(raw, f) for name, raw, _, f in seen if name == stream]
        base = [raw for raw, f in own if f != FORWARD]
        streak = 0
        for _, f in reversed(own):
            if f != FORWARD:
                break
            streak += 1
        glitch = live and t > max(live) + C.jump and t > now and (not base or t - base[-1] > C.jump + C.margin)
        if glitch and streak < C.resync:
            e, f = max(max(live), now), FORWARD
        else:
            e, f = t, LATE if t < now - C.late else OK
        seen.append((stream, t, e, f))
        out.append((e, f))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_clock_equals_its_rules_over_the_whole_history(seed):
    r = random.Random(100 + seed)
    rows = [(s, t + r.choice([0, 0, 0, 0, 0, 5, -5, 0.5, -0.2, r.uniform(-1, 1)]) + (2.5 if s == "cmd" and seed % 3 == 0 and t > 1005 else 0), v) for s, t, v in drive(12)]
    assert flags(rows) == consensus_by_hand(rows)


def test_frozen_sensor_is_left_out():
    rows = drive(12, lambda t: 4.0 + (t - 1000) * 0.5)
    rows = [(s, t, 5.0 if s == "front" and t > 1002 else v) for s, t, v in rows]
    late = [o.state for o, (s, t, _) in zip(run(rows), rows) if t > 1006 and s == "rear"]
    assert late.count("single_rear") > 0.9 * len(late)


def test_older_sensor_is_aligned():
    # the rear sensor reports 0.1 s later: own lines disagree while speeding up in steps, aligned ones agree
    s, v = State(), lambda t: 3.0 + 1.5 * (t - 1000)
    states = []
    for k in range(100):
        t = 1000 + k * 0.1
        for name, at in (("front", t), ("rear", t)):
            steps.take(s, C, name, at, v(at))
            states.append(steps.fuse(s, C, at, v(at))[2])
    assert states.count("both") > 0.95 * len(states)


def test_sudden_common_jump_is_flagged():
    rows = drive(10, lambda t: 5.0 if t < 1005 else 9.0)
    assert any(o.slip for o, (_, t, _) in zip(run(rows), rows) if 1005 < t < 1006) and not any(o.slip for o, (_, t, _) in zip(run(rows), rows) if t < 1005)


def test_commands_by_time_and_dead_time():
    s, c = State(), replace(C, dead_traction=0.5)
    for t, n in ((10.0, 3), (12.0, 5), (11.0, -2)):
        steps.command(s, c, t, n)
    assert [steps.in_force(s, t)[0] for t in (9.9, 10.0, 11.5, 12.0)] == [0.0, 3.0, -2.0, 5.0]
    s = State()
    steps._begin(s, c, 10.0)
    steps.command(s, c, 10.0, 5)
    assert steps.drive(s, c, 10.3, 0.3).mode == "standstill" and s.level_t == 0.0  # not yet in force
    steps.drive(s, c, 10.8, 0.5)
    assert s.level_t > 0


def test_start_delay_and_standstill_latch():
    s = State()
    t, v = 1000.0, []
    for k in range(100):
        a = steps.message(s, C, "cmd", t + k * 0.05, 6.0)
        v.append(a.v)
    moving = next(k for k, x in enumerate(v) if x > 0)
    assert C.start_delay <= moving * 0.05 <= C.start_delay + 0.2 and v[-1] > 0.5
    zeros = run([(n, 1000 + k * 0.1, 0.0) for k in range(30) for n in ("front", "rear")])
    assert zeros[-1].v == 0 and zeros[-1].var == pytest.approx(C.sigma_still**2) and zeros[-1].way == 0


def test_way_is_the_integral_of_speed():
    rows = drive(30, lambda t: 8.0)
    assert run(rows)[-1].way == pytest.approx(8 * 30, rel=0.05)
    ramp = drive(20, lambda t: max(0.0, 10 - (t - 1000)))
    assert run(ramp)[-1].way == pytest.approx(50, rel=0.05) and run(ramp)[-1].v < 0.05


def test_covariance_stays_a_covariance():
    r = random.Random(3)
    s = State()
    for stream, t, v in drive(20, lambda t: 6 + 3 * ((t - 1000) % 4)):
        steps.message(s, C, stream, t + r.choice([0, 0, 0, 0.4]), v if stream != "cmd" else r.choice([0, 4, -3, -8]))
        if s.p is not None:
            assert (abs(s.p - s.p.T) < 1e-9).all() and min(np.linalg.eigvalsh(s.p)) > -1e-9
            assert C.gain_low <= s.x[2] <= C.gain_high and C.gain_low <= s.x[3] <= C.gain_high


def test_covariance_step_equals_the_numbers_of_the_model():
    """F by differences of the model itself against the filter's own F."""
    c = replace(C, sigma_traction=0.0, bias_noise=0.0, gain_noise=0.0)
    base = State(x=np.array([6.0, 0.02, 1.1, 0.9, 40.0]), p=np.zeros((5, 5)), t=10.0, commands=[[0.0, 5.0]], level_t=0.4)
    c = replace(c, command_stale=100.0, gain_start=10.0)

    def after(x):
        s = State(**{**steps.dump(base), "x": np.array(x), "p": np.zeros((5, 5))})
        steps._step(s, c, 10.05, 0.05, None)
        return s.x

    x0 = base.x.copy()
    f = np.array([(after(x0 + h) - after(x0 - h)) / 2e-5 for h in np.eye(5) * 1e-5]).T
    s = State(**{**steps.dump(base), "x": x0.copy(), "p": np.diag([1.0, 0.3, 0.2, 0.1, 2.0])})
    steps._step(s, c, 10.05, 0.05, None)
    f[0, 0] = f[4, 0] / 0.05 and 1.0  # the filter leaves out how the levels follow the speed
    f[4, 0] = 0.05
    assert np.allclose(s.p, f @ np.diag([1.0, 0.3, 0.2, 0.1, 2.0]) @ f.T, atol=1e-4)


def test_extrapolation_stops_exactly():
    s = State(x=np.array([2.0, 0.0, 1.0, 1.0, 10.0]), t=5.0, accel=-4.0)
    assert steps.extrapolate(s, C, 5.25) == (1.0, 10.375)
    assert steps.extrapolate(s, C, 6.0) == (0.0, 10.5)  # v^2 / 2a
    assert steps.extrapolate(s, C, 99.0) == steps.extrapolate(s, C, 6.0) and s.v == 2.0
    assert steps.extrapolate(State(), C, 3.0) == (0.0, 0.0)


def test_uphill_is_slower_than_downhill():
    rows = [("cmd", 1000 + k * 0.05, 4.0) for k in range(600)]
    track = lambda g: Track([0.0, 1e4], [g, g], [0.0, 0.0])

    def end(track):
        s = State()
        return [steps.message(s, C, *r, track) for r in rows][-1].v

    assert end(track(0.02)) < end(None) < end(track(-0.02))
    assert Track([0.0, 10.0], [0.0, 1.0], [float("nan"), 0.0]).at(5.0) == (0.5, 0.0) and track(1.0).at(-1.0) == (0.0, 0.0)


def test_gains_learn_and_are_bounded():
    s = State()
    v = 0.0
    for k in range(4000):
        t = 1000 + k * 0.05
        steps.message(s, C, "cmd", t, 5.0 if (k // 200) % 2 == 0 else -3.0)
        if k % 2 == 0:
            level = s.level_t * 1.2 + s.level_b * 1.1
            v = max(0.0, v + 0.1 * level)
            for name in ("front", "rear"):
                steps.message(s, C, name, t, v)
    assert 1.0 < s.x[2] <= C.gain_high


def test_answers_by_kind():
    rows = drive(2)
    data = [(k, int(t * 1e6), st, v) for k, (st, t, v) in enumerate(rows)]
    for kind, want in (("all", 120), ("wheels", 80), ("cmd", 40)):
        assert len(list(steps.replay(data, State(), replace(C, publish_on=kind)))) == {"all": len(rows), "wheels": sum(r[0] != "cmd" for r in rows), "cmd": sum(r[0] == "cmd" for r in rows)}[kind] and want


def test_state_survives_as_text():
    rows = drive(6, lambda t: 3 + (t - 1000))
    whole = run(rows)
    s, out = State(), []
    for k, (stream, t, v) in enumerate(rows):
        out.append(steps.message(s, C, stream, t, v))
        if k % 7 == 0:
            s = steps.load(json.loads(json.dumps(steps.dump(s))))
    assert out == whole


def frame(spark, rows, run_id=1):
    data = [(run_id, k, int(round(t * 1e6)), s, float(v)) for k, (s, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "run long, seq long, t long, stream string, value double")


def test_one_answer_for_each_message(spark):
    m = frame(spark, drive(3)).unionByName(frame(spark, drive(2), 2))
    out = runner.estimate(m)
    assert out.count() == m.count() and out.filter("v is null").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = drive(6, lambda t: 5 + (t - 1000) / 3)
    m = frame(spark, rows).unionByName(frame(spark, drive(3), 2)).toPandas()
    for k, part in enumerate((m[m.seq < 100], m[(m.seq >= 100) & (m.seq < 200)], m[m.seq >= 200])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part{k}"))
    source = spark.readStream.schema("run long, seq long, t long, stream string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = runner.estimate_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["run", "seq"], ignore_index=True)
    want = runner.estimate(spark.createDataFrame(m)).toPandas().sort_values(["run", "seq"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want)


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(1, 1_700_000_000 + k, float(k)) for k in range(40)]
    spark.createDataFrame(rows, "run long, s long, v double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("run long, s long, v double, ts timestamp").parquet(str(tmp_path / "in"))
    q = runner.rate_windows(source, at="ts", width="10 seconds", delay="1 second").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("rates").orderBy("window").collect()] == [10, 10, 10, 10]
