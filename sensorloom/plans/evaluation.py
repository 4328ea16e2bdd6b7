"""Queries over the evaluation layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import aggregates, episodes, evaluation, faults, geometry, timeops
from sensorloom.plans.joins import LINE, near
from sensorloom.plans.metrics import rounded
from sensorloom.plans.registry import HOUR, fix, front, log, over, r6, rear, register
from sensorloom.plans.stateful import SLOW, messages
from sensorloom.sources.files import with_values
from sensorloom.streaming.runner import estimate

DAY = 24 * HOUR
BRANCHES = {"main": LINE, "upper": [(-0.4, 0.2), (0.0, 0.4), (0.4, 0.6)], "lower": [(-0.2, -0.4), (0.4, -0.2)]}


def plane(s, d):
    """Positions in the plane of the map, made from the log."""
    return log(s, d).select("run", "stream", "seq", "t", (F.col("v") % 10 / 10 - 0.5).alias("x"), (F.col("seq") % 97 / 97.0 - 0.5).alias("y"))


PLANE = "pl AS (SELECT run, stream, seq, t, v % 10 / 10 - 0.5 AS x, seq % 97 / 97.0 - 0.5 AS y FROM s)"


def feet_sql(points, name: str, source: str = "pl", open_ends: bool = False) -> str:
    """CTE ``name``: the nearest segment's foot of each row of ``source`` (id), chosen before any prolongation."""
    segments = ", ".join(f"({i}, {x!r}, {y!r}, {ux!r}, {uy!r}, {n!r}, {arc!r})" for i, x, y, ux, uy, n, arc in geometry.segments_of(points))
    last = len(points) - 2
    off = f"((i = 0 AND w < 0) OR (i = {last} AND w > n))" if open_ends else "FALSE"
    return f"""{name}_g(i, gx, gy, ux, uy, n, arc) AS (VALUES {segments}),
    {name}_w AS (SELECT p.*, g.*, (x - gx) * ux + (y - gy) * uy AS w, (y - gy) * ux - (x - gx) * uy AS side FROM {source} p, {name}_g g),
    {name}_d AS (SELECT *, least(greatest(w, 0.0), n) AS u, round(sqrt((x - gx - least(greatest(w, 0.0), n) * ux) ** 2 + (y - gy - least(greatest(w, 0.0), n) * uy) ** 2), 9) AS d0 FROM {name}_w),
    {name}_b AS (SELECT *, {off} AS off FROM {name}_d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d0, i) = 1),
    {name} AS (SELECT * EXCLUDE (w, u, d0, i, gx, gy, ux, uy, n, arc, off), off, i AS segment, arc + CASE WHEN off THEN w ELSE u END AS s, CASE WHEN off THEN abs(side) ELSE d0 END AS dist FROM {name}_b)"""


def _branches_sql(source: str) -> str:
    """CTE ``best``: of all branches' feet the nearest, the first named of equal ones."""
    feet = ", ".join(feet_sql(points, f"f{k}", source) for k, points in enumerate(BRANCHES.values()))
    every = " UNION ALL ".join(f"SELECT *, {k} AS o, '{name}' AS branch FROM f{k}" for k, name in enumerate(BRANCHES))
    return f"{feet}, best AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, o) = 1)"


ON_MAP = f"""{PLANE}, pi AS (SELECT *, seq AS id FROM pl), {feet_sql(LINE, "ft", "pi", True)},
    om AS (SELECT run, dist <= 0.15 AND NOT off AS on_map, s - (x + 0.5) AS e, abs(side) AS c, dist FROM ft)"""
ALIGN = f"""{PLANE}, wn AS (SELECT * FROM (SELECT *, min(t) OVER (PARTITION BY run) AS t0 FROM pl WHERE stream = 'signup') WHERE t <= t0 + {5 * DAY}),
    mid AS (SELECT run, count(*) AS n, median(x) AS x, median(y) AS y FROM wn GROUP BY run),
    st AS (SELECT mid.run, mid.run AS id, any_value(mid.n) AS fixes, any_value(mid.x) AS x, any_value(mid.y) AS y, median(sqrt((wn.x - mid.x) ** 2 + (wn.y - mid.y) ** 2)) AS sigma FROM wn JOIN mid USING (run) GROUP BY mid.run),
    {_branches_sql("st")}"""


@register("a6_on_map_errors", over(ON_MAP, "SELECT run, count(*) FILTER (WHERE on_map) AS n_on_map, round(avg(e) FILTER (WHERE on_map), 6) AS along_mean, round(sqrt(avg(e * e) FILTER (WHERE on_map)), 6) AS along_rmse, round(quantile_cont(abs(e), 0.95) FILTER (WHERE on_map), 6) AS along_p95, round(avg(c) FILTER (WHERE on_map), 6) AS cross_mean, round(max(c) FILTER (WHERE on_map), 6) AS cross_max, round(avg(dist) FILTER (WHERE NOT on_map), 6) AS off_mean, round(max(dist) FILTER (WHERE NOT on_map), 6) AS off_max FROM om GROUP BY run"))
def _(s, d):
    p = plane(s, d).withColumn("s_true", F.col("x") + 0.5)
    return rounded(evaluation.on_map_summary(p, LINE, s_true="s_true", gate=0.15), "run")


@register("j19_projection_over_branches", over(f"{PLANE}, pi AS (SELECT *, seq AS id FROM pl), {_branches_sql('pi')}", "SELECT run, seq, branch, round(s, 6) AS s, round(dist, 6) AS dist FROM best"))
def _(s, d):
    return evaluation.project_over(plane(s, d), BRANCHES).select("run", "seq", "best.branch", F.round("best.s", 6).alias("s"), F.round("best.dist", 6).alias("dist"))


@register("st8_initial_alignment", over(ALIGN, "SELECT run, fixes AS n, round(x, 6) AS x, round(y, 6) AS y, round(sigma, 6) AS sigma, CASE WHEN fixes < 2 THEN 'none' WHEN dist <= 0.1 THEN 'onmap' WHEN dist <= 0.25 THEN 'near' ELSE 'free' END AS rule, CASE WHEN dist <= 0.25 THEN branch END AS branch, round(CASE WHEN dist <= 0.25 THEN s END, 6) AS s FROM best"))
def _(s, d):
    return rounded(evaluation.align(plane(s, d).filter("stream = 'signup'"), BRANCHES, window=5 * DAY, least=2, near=0.1, far=0.25), "run")


@register("g7_terminus_segments", over("e AS (SELECT run, min(t) AS a, max(t) AS b FROM front WHERE v BETWEEN 20 AND 60 GROUP BY run), p AS (SELECT run, t, CASE WHEN t < a THEN 'head' WHEN t > b THEN 'tail' END AS part FROM front JOIN e USING (run))", "SELECT run, part, count(*) AS n, min(t) AS start, max(t) AS stop FROM p WHERE part IS NOT NULL GROUP BY run, part"))
def _(s, d):
    return evaluation.termini(front(s, d), F.col("v").between(20, 60)).groupBy("run", "part").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


@register("e1_reference", over("k AS (SELECT run, seq, t, v FROM fix WHERE v > 3), n AS (SELECT *, abs(v - lag(v) OVER w) AS b, abs(v - lead(v) OVER w) AS a FROM k WINDOW w AS (PARTITION BY run ORDER BY t, seq))", "SELECT run, seq, t, v FROM n WHERE NOT coalesce(a > 100 AND b > 100, FALSE)"))
def _(s, d):
    return evaluation.build_reference(fix(s, d), good=F.col("v") > 3, jump=100.0).select("run", "seq", "t", "v")


def _evaluation_sql(estimate: str) -> str:
    parts = ", ".join(f"count(e) FILTER (WHERE regime = '{r}') AS {r}_n, round(sqrt(avg(e * e) FILTER (WHERE regime = '{r}')), 6) AS {r}_rmse" for r in evaluation.REGIMES)
    return over(
        near("front", estimate, 6 * HOUR) + f""", e AS (SELECT *, r_v - v AS e, (t - lag(t) OVER w) / {HOUR}.0 AS dt, lag(v) OVER w AS pv, lag(r_v) OVER w AS pr FROM near WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
        g AS (SELECT *, CASE WHEN dt > 0 THEN (v - pv) / dt ELSE 0.0 END AS a FROM e), x AS (SELECT *, CASE WHEN v < 5 THEN 'stopped' WHEN a > 1 THEN 'accel' WHEN a < -1 THEN 'brake' ELSE 'cruise' END AS regime FROM g)""",
        f"SELECT run, count(*) AS rows, round(avg(CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, count(e) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.99), 6) AS p99, round(max(abs(e)), 6) AS max, {parts}, round(arg_max(e, (t, seq)) FILTER (WHERE e IS NOT NULL), 6) AS \"end\", round(sum(dt * (v + pv) / 2), 6) AS way, round(sum(dt * (r_v + pr) / 2), 6) AS r_way FROM x GROUP BY run",
    )


@register("e2_full_evaluation", _evaluation_sql("rear"))
def _(s, d):
    """The other wheel as an estimate of the first, by all metrics."""
    return rounded(evaluation.evaluate(rear(s, d), front(s, d), tol=6 * HOUR, unit=float(HOUR), still=5.0, edge=1.0), "run")


@register("e10_reference_as_estimate", _evaluation_sql("front"))
def _(s, d):
    return rounded(evaluation.evaluate(front(s, d), front(s, d), tol=6 * HOUR, unit=float(HOUR), still=5.0, edge=1.0), "run")


VARIANTS = {"final": {}, "no_bias": {"bias_noise": 1e-6}, "fixed_gains": {"gain_start": 1e-6, "gain_noise": 0.0}, "strict_agreement": {"agree": 0.05, "agree_share": 0.01}, "long_steps": {"longest_step": 4.0}, "wheels_only": {"command_stale": 0.0}}


@register("e6_variant_matrix")
def _(s, d):
    """Named sets of overrides, each replayed over every run and scored against the first wheel."""
    out = None
    for name, overrides in VARIANTS.items():
        e = estimate(messages(s, d), with_values(SLOW, overrides)).select("run", "seq", F.col("t_eff").alias("t"), (F.col("v") * 10).alias("v"))
        scores = evaluation.evaluate(e, front(s, d), tol=HOUR, unit=float(HOUR), still=5.0, edge=1.0).select("run", "coverage", "rmse", "bias", "end").withColumn("variant", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return rounded(out, "run", "variant")


@register("u1_pluggable_estimators")
def _(s, d):
    m = messages(s, d)
    a = evaluation.replay(m, "hold_mean").withColumn("name", F.lit("hold_mean"))
    b = evaluation.replay(m, "integrate_command", {"gain": 0.02, "second": 3600.0}).withColumn("name", F.lit("integrate_command"))
    return a.unionByName(b).groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


SCENARIOS = {"drop": faults.Fault("drop", ("view",), 8 * DAY, 4 * DAY), "zero": faults.Fault("zero", ("view",), 8 * DAY, 4 * DAY), "slip": faults.Fault("slip", ("view",), 8 * DAY, 4 * DAY, amp=0.3, ramp=DAY), "spikes": faults.Fault("spikes", ("view",), 8 * DAY, 4 * DAY, amp=80.0, rate=0.5)}


@register("f9_scenarios")
def _(s, d):
    """Each scenario against the clean log: value errors in the faulty stream, run by run."""
    clean = front(s, d)
    parts = []
    for name, fault in SCENARIOS.items():
        faulty = faults.inject(log(s, d), fault).filter("stream = 'view'")
        e = timeops.nearest(clean, faulty, tol=6 * HOUR).withColumn("e", F.col("r_v") - F.col("v"))
        parts.append(e.groupBy("run").agg(*aggregates.error_stats(F.col("e"))).withColumn("scenario", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, "run", "scenario")


@register("a37_fault_roll_up")
def _(s, d):
    """Time until the faulty stream is good for a day again, per scenario."""
    out = None
    for name, fault in SCENARIOS.items():
        faulty = faults.inject(log(s, d), fault).filter("stream = 'view'").select("run", "seq", "t", "v")
        e = timeops.nearest(front(s, d), faulty, tol=6 * HOUR)
        r = episodes.recovery(e, F.abs(F.col("r_v") - F.col("v")) > 5, hold=DAY).select(F.lit(name).alias("scenario"), ((F.col("recovered") - F.col("start")) / HOUR).alias("hours"))
        out = r if out is None else out.unionByName(r)
    return rounded(evaluation.fault_roll_up(out, "scenario", "hours", 12.0), "scenario")


@register("e14_anomaly_statistics", over("g AS (SELECT run, t, v, lag(v) OVER w AS pv, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY run ORDER BY t, seq))", f"SELECT run, count(*) AS n, sum(CASE WHEN abs(v - pv) > 100 THEN 1 ELSE 0 END)::BIGINT AS jumps, sum(CASE WHEN dt > {DAY} THEN 1 ELSE 0 END)::BIGINT AS gaps FROM g GROUP BY run"))
def _(s, d):
    from sensorloom.operators.windows import line

    w = line()
    g = log(s, d).select("run", (F.col("v") - F.lag("v").over(w)).alias("dv"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    return g.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("dv") > 100).alias("jumps"), F.count_if(F.col("dt") > DAY).alias("gaps"))


@register("j8_in_history_interpolation", over("b AS (SELECT a.run, a.seq, a.t, r.t AS t0, r.v AS v0 FROM front a ASOF LEFT JOIN rear r ON a.run = r.run AND a.t >= r.t), c AS (SELECT a.seq, r.t AS t1, r.v AS v1 FROM front a ASOF LEFT JOIN rear r ON a.run = r.run AND a.t < r.t)", "SELECT run, seq, round(CASE WHEN t1 IS NULL OR t0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS interp FROM b JOIN c USING (seq)"))
def _(s, d):
    return timeops.interpolate(front(s, d), rear(s, d), clamp=False, half_open=True).select("run", "seq", *r6("interp"))
