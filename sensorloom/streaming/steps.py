"""Stateful steps shared by batch and streaming: clock consensus, sensor fusion, drive model, speed filter.

A step takes one message and returns one output row; all state is a ``State`` that can live in a
partition's memory or, as a dict, in a state store.  Times are seconds of the stream's own clock.
The filter's state vector is (speed, bias, traction gain, brake gain, way).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields
from math import ceil, exp, inf, isfinite, sqrt
from typing import NamedTuple

import numpy as np

OK, FORWARD, LATE, INVALID = range(4)
SENSORS = ("front", "rear")
V, B, GT, GB, W = range(5)


@dataclass(frozen=True)
class Config:
    """Fixed values of the rules, in units of ``second`` seconds, so that slow logs run with the same rules."""

    second: float = 1.0
    #: Which messages are answered: all, wheels or cmd.
    publish_on: str = "all"
    # clock
    jump: float = 0.3
    margin: float = 0.15
    late: float = 0.15
    consensus: int = 30
    resync: int = 20
    # sensors
    top: float = 100.0
    bottom: float = -5.0
    spike: float = 2.0
    spike_rate: float = 6.0
    stale: float = 0.5
    least_span: float = 0.02
    ahead: float = 0.2
    agree: float = 0.2
    agree_share: float = 0.03
    stuck: float = 0.2
    frozen: float = 1.5
    frozen_range: float = 0.3
    anchor_hold: float = 3.0
    accel_window: float = 0.3
    accel_flag: float = 2.5
    decel_flag: float = 6.0
    hold: float = 1.0
    lock_decel: float = 1.0
    sigma_both: float = 0.03
    sigma_one: float = 0.045
    sigma_slip: float = 0.35
    # drive model
    dead_traction: float = 0.05
    dead_brake: float = 0.15
    lag: float = 0.25
    lag_brake: float = 0.30
    command_stale: float = 1.0
    command_history: float = 3.0
    start_delay: float = 1.2
    still: float = 0.05
    hold_notch: int = -8
    hold_speed: float = 2.5
    hold_accel: float = -0.85
    resistance: float = 0.04
    traction: tuple[float, float, float, float, float, float, float] = (0.0968, 0.1131, 3.49, 6.90, 1.048, 5.90, 0.571)
    brake: tuple[float, float, float, float, float] = (0.193, 0.1123, 0.327, 2.98, -1.7)
    slope_traction: float = 0.886
    slope_brake: float = 0.812
    slope_coast: float = 0.978
    curve: float = 3.0
    sigma_traction: float = 0.11
    sigma_coast: float = 0.16
    sigma_brake: float = 0.085
    sigma_hold: float = 0.6
    sigma_hard: float = 0.43
    sigma_unknown: float = 0.5
    # filter
    longest_step: float = 0.05
    gap: float = 5.0
    gap_accel: float = 0.5
    correlation: float = 1.0
    bias_tau: float = 10.0
    bias_noise: float = 0.05
    gain_noise: float = 0.002
    gain_start: float = 0.07
    gain_low: float = 0.8
    gain_high: float = 1.3
    gain_gate: float = 3.0
    fresh: float = 0.5
    sigma_start: float = 1.0
    sigma_still: float = 0.01
    accel_limit: float = 1.8
    decel_limit: float = 6.0
    decel_slip: float = 2.4
    least_dt: float = 0.1
    resync_after: float = 3.0
    way_share: float = 0.003
    furthest: float = 1.0


@dataclass(frozen=True)
class Track:
    """Grade and curvature along the way, looked up by the filter ``ahead`` of where it is."""

    arc: Sequence[float]
    grade: Sequence[float]
    curvature: Sequence[float]
    offset: float = 0.0
    ahead: float = 0.0

    def at(self, way: float) -> tuple[float, float]:
        """Linear between points, 0 outside and where a value is not finite."""
        at, arc = way + self.offset + self.ahead, self.arc
        if not arc[0] <= at <= arc[-1]:
            return 0.0, 0.0
        k = min(max(bisect_right(arc, at), 1), len(arc) - 1)
        share = (at - arc[k - 1]) / (arc[k] - arc[k - 1])
        found = [x[k - 1] + (x[k] - x[k - 1]) * share for x in (self.grade, self.curvature)]
        return tuple(x if isfinite(x) else 0.0 for x in found)


def _start() -> np.ndarray:
    return np.array([0.0, 0.0, 1.0, 1.0, 0.0])


@dataclass
class State:
    # clock: (raw stamp, arrival, own stamp, pulled back in a row) of each stream
    n: int = 0
    now: float | None = None
    clock: dict[str, list] = field(default_factory=dict)
    # sensors: see ``take``
    sensors: dict[str, dict] = field(default_factory=dict)
    fused: list[list[float]] = field(default_factory=list)
    anchor: list[float] | None = None
    before_slip: float = 0.0
    slip_until: float = -1e300
    lock_until: float | None = None
    # drive: commands by time, lagged levels, time that traction has been asked for at rest
    commands: list[list[float]] = field(default_factory=list)
    level_t: float = 0.0
    level_b: float = 0.0
    held: float = 0.0
    # filter
    t: float | None = None
    x: np.ndarray = field(default_factory=_start)
    p: np.ndarray | None = None
    accel: float = 0.0
    mode: str = "coast"
    latch: bool = False
    z: list[float] | None = None
    after: list[float] | None = None
    clipped_since: float | None = None

    @property
    def v(self) -> float:
        return float(self.x[V])


# --- clock consensus ---------------------------------------------------------------------------


def judge(t: float, now: float, reference: float | None, own: float, streak: int, c: Config) -> int:
    """A stamp against the other streams' newest, the filter's clock and the stream's own last stamp.

    Ahead of all three by more than a jump, it is pulled back, but not for ever; behind the filter's
    clock it is late.
    """
    leaps = reference is not None and min(t - reference, t - own - c.margin) > c.jump and t > now
    if leaps and streak < c.resync:
        return FORWARD
    return LATE if t < now - c.late else OK


def check_clock(s: State, c: Config, stream: str, t: float | None) -> tuple[float | None, int]:
    """Effective time and flag of a stamp, judged by the other streams and the order of arrival."""
    if t is None or not isfinite(t) or t <= 0:
        return t, INVALID
    s.n += 1
    others = [raw for name, (raw, arrival, _, _) in s.clock.items() if name != stream and s.n - arrival <= c.consensus]
    reference = max(others, default=None)
    _, _, own, streak = s.clock.get(stream, (None, 0, None, 0))
    now = -inf if s.now is None else s.now
    flag = judge(t, now, reference, -inf if own is None else own, streak, c)
    s.clock[stream] = [t, s.n, own, streak + 1] if flag == FORWARD else [t, s.n, t, 0]
    effective = max(reference, now) if flag == FORWARD else t
    s.now = max(now, effective)
    return effective, flag


# --- two sensors -------------------------------------------------------------------------------


def carried(x: dict, t: float, c: Config) -> float:
    """A sensor's value at ``t`` on the line through its last two samples, a little beyond them."""
    (t1, v1), old = x["new"], x["old"]
    span = t1 - old[0] if old else 0.0
    if span < c.least_span:
        return v1
    return max(0.0, v1 + (v1 - old[1]) / span * min(max(t - t1, -span), c.ahead))


def take(s: State, c: Config, name: str, t: float, v: float | None) -> bool:
    """Store a sample if it is in range and order, and on its sensor's or the other's line.

    One that is on neither is doubted and left out; the next is believed.  ``since`` is when the value
    last changed, ``other`` the range of the other sensor's values since.
    """
    if v is None or not isfinite(v) or not c.bottom <= v <= c.top:
        return False
    v = max(v, 0.0)
    mine, other = s.sensors.get(name), s.sensors.get(SENSORS[1 - SENSORS.index(name)])
    if mine is None:
        mine = s.sensors[name] = {"new": [t, v], "old": None, "doubt": False, "since": None, "other": None}
        changed = True
    else:
        t1, v1 = mine["new"]
        if t < t1:
            return False
        room = c.spike + c.spike_rate * (t - t1)
        on_line = [x for x in (mine, other) if x and abs(t - x["new"][0]) <= c.stale and abs(v - carried(x, t, c)) <= room]
        if t - t1 <= c.stale and not on_line and not mine["doubt"]:
            mine["doubt"] = True
            return False
        changed = v != v1
        mine.update(new=[t, v], old=mine["old"] if t == t1 else [t1, v1], doubt=False)
    if changed or v == 0.0:
        seen = other["new"][1] if other and t - other["new"][0] <= c.stale else None
        mine.update(since=t, other=None if seen is None else [seen, seen])
    if other:
        low, high = other["other"] or (v, v)
        other["other"] = [min(low, v), max(high, v)]
    return True


def _frozen(x: dict, c: Config) -> bool:
    t1, v1 = x["new"]
    return v1 != 0.0 and t1 - x["since"] >= c.frozen and x["other"] is not None and x["other"][1] - x["other"][0] > c.frozen_range


def _usable(s: State, c: Config, t: float) -> dict[str, float]:
    """Values at ``t`` of the sensors that are fresh, not frozen and not stuck at zero."""
    at = {n: carried(s.sensors[n], t, c) for n in SENSORS if n in s.sensors and t - s.sensors[n]["new"][0] <= c.stale and not _frozen(s.sensors[n], c)}
    if len(at) == 2:
        stuck = [n for n, m in (SENSORS, SENSORS[::-1]) if s.sensors[n]["new"][1] == 0.0 and at[m] > c.stuck]
        for n in stuck[:1]:
            del at[n]
    return at


def _aligned(s: State, c: Config, t: float, at: dict[str, float]) -> tuple[float, float]:
    """Both values with the older one moved by what the newer sensor has changed since."""
    newer, older = sorted(SENSORS, key=lambda n: -s.sensors[n]["new"][0])
    x, (t_old, v_old) = s.sensors[newer], s.sensors[older]["new"]
    if x["new"][0] > t_old and x["old"] is not None and x["old"][0] <= t_old and x["new"][0] <= t:
        at = {**at, older: v_old + at[newer] - carried(x, t_old, c)}
    return at["front"], at["rear"]


def _implausible(s: State, c: Config, t: float, v: float) -> bool:
    """The fused speed's mean acceleration over the window is more than the vehicle has."""
    if s.fused and t < s.fused[-1][0]:
        return False
    line = [x for x in s.fused if x[0] < t] + [[t, v]]
    long_ago = [x for x in line if x[0] <= t - c.accel_window]
    s.fused = long_ago[-1:] + line[len(long_ago) :]
    if not long_ago:
        return False
    t0, v0 = long_ago[-1]
    return not -c.decel_flag <= (v - v0) / (t - t0) <= c.accel_flag


def fuse(s: State, c: Config, t: float, predicted: float) -> tuple[float | None, float, str, bool]:
    """Speed, sigma, state and slip flag from the usable sensors.

    Two sensors are compared as they are and aligned: agreement in both is full, in one uncertain (the
    slip sigma, no flag), in none a disagreement, where the one nearer to the last full agreement, or
    later on to the prediction, is taken.
    """
    at = _usable(s, c, t)
    if not at:
        return None, c.sigma_slip, "none", False
    agreeing = 0
    if len(at) == 1:
        ((name, v),) = at.items()
        sigma, state = c.sigma_one, f"single_{name}"
    else:
        pairs = [_aligned(s, c, t, at), (at["front"], at["rear"])]
        room = max(c.agree, c.agree_share * max(at.values()))
        good = [f + r for f, r in pairs if abs(f - r) <= room]
        agreeing = len(good)
        if good:
            v, sigma, state = max(good[0] / 2, 0.0), (c.sigma_both if agreeing == 2 else c.sigma_slip), "both"
        else:
            held = s.anchor is not None and 0.0 <= t - s.anchor[0] <= c.anchor_hold
            near = s.anchor[1] if held else predicted
            v, sigma, state = min(at.values(), key=lambda x: abs(x - near)), c.sigma_slip, "disagree"
    if _implausible(s, c, t, v) or state == "disagree":
        if t >= s.slip_until:
            s.before_slip = s.anchor[1] if s.anchor else 0.0
        s.slip_until = t + c.hold
    elif agreeing == 2:
        s.anchor = [t, v]
    slip = t < s.slip_until
    if v > 0:
        s.lock_until = None
    elif slip and s.lock_until is None and s.before_slip > 0:
        s.lock_until = t + s.before_slip / c.lock_decel  # wheels that stop in a slip are not believed at once
    slip = slip or (s.lock_until is not None and t < s.lock_until)
    return v, c.sigma_slip if slip else sigma, state, slip


# --- drive model -------------------------------------------------------------------------------


class Drive(NamedTuple):
    u_t: float
    u_b: float
    accel: float
    mode: str
    sigma: float
    latch: bool
    slope: float


def command(s: State, c: Config, t: float, notch: float) -> None:
    """Put a command in order of time; those no longer looked at go, but for the one in force."""
    at = bisect_right(s.commands, t, key=lambda x: x[0])
    s.commands.insert(at, [t, float(int(notch))])
    if len(s.commands) > 64 and s.t is not None:
        old = bisect_right(s.commands, s.t - c.command_history, key=lambda x: x[0]) - 1
        del s.commands[: max(0, old)]


def in_force(s: State, t: float) -> tuple[float, float]:
    """Notch and stamp of the last command up to ``t``."""
    at = bisect_right(s.commands, t, key=lambda x: x[0])
    return (s.commands[at - 1][1], s.commands[at - 1][0]) if at else (0.0, -inf)


def traction_level(c: Config, notch: float, v: float) -> float:
    b0, a0, v1, va, top, vb, power = c.traction
    plateau = b0 + a0 * notch / (1 + max(v - v1, 0.0) / va)
    return min(plateau, top * min(1.0, vb / max(v, 1e-3)) ** power) - c.resistance


def brake_level(c: Config, notch: float, v: float) -> float:
    if notch == c.hold_notch:
        return c.hold_accel if v <= c.hold_speed else 0.0
    d0, d1, fade, vf, cap = c.brake
    return max((d0 + d1 * -notch) * (fade * exp(-v / vf) - 1), cap) - c.resistance


def drive(s: State, c: Config, t: float, dt: float) -> Drive:
    """What the commands ask for at ``t``: lagged levels before gains, and whether the vehicle is held still."""
    v = float(s.x[V])
    known = t - in_force(s, t)[1] <= c.command_stale
    up = in_force(s, t - c.dead_traction)[0] if known else 0.0
    down = in_force(s, t - c.dead_brake)[0] if known else 0.0
    target_t, target_b = (traction_level(c, up, v) if up > 0 else 0.0), (brake_level(c, down, v) if down < 0 else 0.0)
    s.level_t += (1 - exp(-dt / c.lag)) * (target_t - s.level_t)
    s.level_b += (1 - exp(-dt / c.lag_brake)) * (target_b - s.level_b)
    s.held = s.held + dt if up > 0 and v < c.still else 0.0
    latch = v < c.still and (up <= 0 or s.held < c.start_delay - 1e-6)
    accel = s.x[GT] * s.level_t + s.x[GB] * s.level_b - (c.resistance if up <= 0 and down >= 0 else 0.0)
    if up > 0:
        mode, sigma, slope = "traction", c.sigma_traction, c.slope_traction
    elif down < 0:
        slope = c.slope_brake
        mode, sigma = ("hold", c.sigma_hold) if down == c.hold_notch else ("brake", c.sigma_hard if down <= -9 else c.sigma_brake)
    else:
        mode, sigma, slope = "coast", c.sigma_coast, c.slope_coast
    return Drive(s.level_t, s.level_b, float(accel), "standstill" if latch else mode, sigma if known else c.sigma_unknown, latch, slope)


# --- speed filter ------------------------------------------------------------------------------


_EYE = np.eye(5)


def _begin(s: State, c: Config, t: float) -> None:
    s.t = t
    s.p = np.diag([c.sigma_start**2, c.bias_noise**2, c.gain_start**2, c.gain_start**2, 0.0])


def _spread(s: State, c: Config, dt: float, keep: float, row: Sequence[float], density: float, way: float) -> None:
    """P to F P F' + Q.  ``row``: how the new speed follows bias and gains; ``way``: seconds of speed
    that the way takes up; ``density`` of the acceleration's white noise."""
    f = _EYE.copy()
    f[V, B:W] = row
    f[B, B] = keep
    f[W, V] = way
    f[W, B:W] = f[V, B:W] * (way / 2)
    p = f @ s.p @ f.T
    q = density * dt
    p[V, V] += q
    p[V, W] += q * way / 2
    p[W, V] += q * way / 2
    p[W, W] += q * way * way / 3
    p[B, B] += c.bias_noise**2 * (1 - keep * keep)
    for g in (GT, GB):
        p[g, g] = min(p[g, g] + c.gain_noise**2 * dt, c.gain_start**2)
    s.p = p


def _confirm_still(s: State, c: Config) -> None:
    s.p[V, :] = 0.0
    s.p[:, V] = 0.0
    s.p[V, V] = c.sigma_still**2


def _step(s: State, c: Config, t: float, dt: float, track: Track | None) -> None:
    d = drive(s, c, t, dt)
    s.t, s.mode, s.latch = t, d.mode, d.latch
    keep = exp(-dt / c.bias_tau)
    measured = s.z[1] if s.z is not None and t - s.z[0] <= c.fresh else None
    if d.latch and (measured is None or measured < c.still):
        # held still: sure with a fresh zero; else v = 0 as it was, or growing doubt under the hold notch
        s.x[V], s.accel = 0.0, 0.0
        s.x[B] *= keep
        may_start = measured is None and in_force(s, t)[0] == c.hold_notch
        _spread(s, c, dt, keep, (0.0, 0.0, 0.0), d.sigma**2 * c.correlation if may_start else 0.0, dt if may_start else 0.0)
        if measured is not None:
            _confirm_still(s, c)
        return
    accel, sigma, u_t, u_b = d.accel, d.sigma, d.u_t, d.u_b
    if d.latch:  # the wheels turn although nothing should move: the model says nothing
        accel, sigma, u_t, u_b = 0.0, max(sigma, c.sigma_hold), 0.0, 0.0
    elif track is not None:
        grade, curvature = track.at(float(s.x[W]))
        accel -= d.slope * 9.81 * grade + c.curve * abs(curvature)
    v0, a = float(s.x[V]), accel + float(s.x[B])
    v1 = v0 + a * dt
    s.x[W] += (v0 + v1) / 2 * dt if v1 >= 0 else v0 * v0 / (-2 * a)
    s.x[V], s.accel = max(v1, 0.0), a
    s.x[B] *= keep
    _spread(s, c, dt, keep, (dt, u_t * dt, u_b * dt), sigma**2 * c.correlation, dt)


def predict(s: State, c: Config, t: float, track: Track | None = None) -> None:
    """Carry the state to ``t`` in short steps; a long gap is crossed at constant speed, with doubt."""
    if s.t is None:
        _begin(s, c, t)
    span = t - s.t
    if not span > 0:
        return
    if span > c.gap:
        d = drive(s, c, t, span)
        keep = exp(-span / c.bias_tau)
        at_rest = d.latch and s.x[V] == 0.0
        s.t, s.mode, s.latch, s.accel = t, d.mode, d.latch, 0.0
        s.x[B] *= keep
        s.x[W] += s.x[V] * span
        _spread(s, c, span, keep, (0.0, 0.0, 0.0), 0.0 if at_rest else c.gap_accel**2 * span, 0.0 if at_rest else span)
        return
    n = max(1, ceil(span / c.longest_step - 1e-9))
    begun = s.t
    for k in range(1, n + 1):
        _step(s, c, t if k == n else begun + k * span / n, span / n, track)


def update(s: State, c: Config, t: float, z: float, sigma: float, sure: bool = True) -> None:
    """Measured speed into the filter.

    ``sure``: both sensors agree without slip.  What changes faster than the vehicle can since the last
    update is clipped, or accepted anew after ``resync_after``.  Gains learn only from sure values
    near the prediction; else their doubt is considered but neither they nor it are changed.
    """
    raw, limit = max(z, 0.0), None
    z = raw
    if s.after is not None:
        dt = max(t - s.after[0], c.least_dt)
        low = s.after[1] - (c.decel_limit if sure else c.decel_slip) * dt
        limit = min(max(raw, low, 0.0), s.after[1] + c.accel_limit * dt)
    clipped = limit is not None and limit != raw
    s.clipped_since = (s.clipped_since if s.clipped_since is not None else t) if clipped else None
    anew = clipped and t - s.clipped_since >= c.resync_after
    if clipped and not anew:
        z = limit
    e = z - float(s.x[V])
    if anew:
        s.p[V, V] += e * e
    total = s.p[V, V] + max(sigma * sigma, 1e-8)
    learn = sure and not clipped and s.mode not in ("hold", "standstill") and e * e <= c.gain_gate**2 * total
    used = np.array([True, True, learn, learn, True])
    column = s.p[:, V].copy()
    s.x += np.where(used, column / total * e, 0.0)
    s.p -= np.where(used[:, None] | used, np.outer(column, column) / total, 0.0)
    s.x[GT:W] = np.clip(s.x[GT:W], c.gain_low, c.gain_high)
    s.x[V] = max(s.x[V], 0.0)
    if s.latch and z < c.still:
        s.x[V] = 0.0
        _confirm_still(s, c)
    s.after, s.z = [t, float(s.x[V])], [t, raw]


def extrapolate(s: State, c: Config, t: float | None) -> tuple[float, float]:
    """Speed and way at ``t`` with the last acceleration, to a stop and no further; the state stays."""
    v, way = float(s.x[V]), float(s.x[W])
    if s.t is None or t is None or not isfinite(t):
        return v, way
    dt = min(max(t - s.t, -c.furthest), c.furthest)
    end = v + s.accel * dt
    if end >= 0:
        return end, way + (v + end) / 2 * dt
    return 0.0, way + v / 2 * (-v / s.accel)


class Answer(NamedTuple):
    t_eff: float | None
    flag: int
    v: float
    var: float
    state: str
    slip: bool
    way: float
    var_way: float
    bias: float
    mode: str


def message(s: State, c: Config, stream: str, t: float | None, value: float | None, track: Track | None = None) -> Answer:
    """The answer to one message; late ones are answered, and late commands put where they belong."""
    at, flag = check_clock(s, c, stream, t)
    state, slip = "none", False
    number = value is not None and isfinite(value)
    if stream not in SENSORS and flag != INVALID and number:
        command(s, c, at, max(-15.0, min(15.0, value)))
    if flag in (OK, FORWARD):
        predict(s, c, at, track)
        if stream in SENSORS and take(s, c, stream, at, value):
            z, sigma, state, slip = fuse(s, c, at, s.v)
            if z is not None:
                two = state in ("both", "disagree")
                # a pair's two updates are one piece of evidence: each has half of its weight
                update(s, c, at, z, sigma * (sqrt(2) if two else 1.0), state == "both" and not slip)
    v, way = extrapolate(s, c, at if flag == LATE else None)
    p = s.p if s.p is not None else np.zeros((5, 5))
    return Answer(at, flag, v, float(p[V, V]), state, slip, way, float(p[W, W]) + (c.way_share * way) ** 2, float(s.x[B]), s.mode)


def answered(c: Config, stream: str) -> bool:
    return c.publish_on == "all" or (stream in SENSORS) == (c.publish_on == "wheels")


def replay(rows: Iterable[tuple], s: State, c: Config, track: Track | None = None) -> Iterator[tuple]:
    """Rows (seq, t in microseconds, stream, value) in order of arrival to (seq, answer) rows."""
    for seq, t, stream, value in rows:
        none = t is None or t != t
        a = message(s, c, stream, None if none else t / 1e6 / c.second, None if value is None or value != value else float(value), track)
        if answered(c, stream):
            yield seq, (None if a.t_eff is None or not isfinite(a.t_eff) else round(a.t_eff * c.second * 1e6)), *a[1:]


def dump(s: State) -> dict:
    """The state as plain lists and numbers."""
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x
    return {f.name: plain(getattr(s, f.name)) for f in fields(s)}


def load(data: dict | None) -> State:
    if not data:
        return State()
    s = State(**data)
    s.x = np.array(s.x, float)
    s.p = None if s.p is None else np.array(s.p, float)
    return s
