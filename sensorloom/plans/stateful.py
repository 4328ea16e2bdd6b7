"""Queries over ordered recurrences and stateful estimators: results that SQL cannot tell."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sensorloom.operators import aggregates, episodes, recurrences
from sensorloom.plans.registry import HOUR, front, log, over, r6, rear, register
from sensorloom.streaming.runner import estimate
from sensorloom.streaming.steps import Config, Track

DAY = 24 * HOUR
NAMES = {"view": "front", "click": "rear", "purchase": "cmd"}


def messages(s, d):
    """The log as wheel and command messages: speeds in tens, commands from -15 to 15."""
    x = log(s, d).filter(F.col("stream").isin(*NAMES))
    kind = F.when(F.col("stream") == "view", "front").when(F.col("stream") == "click", "rear").otherwise("cmd")
    value = F.when(F.col("stream") == "purchase", (F.col("seq") % 31 - 15).cast("double")).otherwise(F.col("v") / 10)
    return x.select("run", "seq", "t", kind.alias("stream"), value.alias("value"))


def walk(start: str, step: str, columns: str, source: str = "front", order: str = "t, seq") -> str:
    """CTEs of a walk over a run's ordered rows: ``f`` has the state after each row, ``n`` the next row."""
    return f"num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order}) AS i FROM {source}), f({columns}) AS (SELECT {start} FROM num WHERE i = 1 UNION ALL SELECT {step} FROM f JOIN num n ON n.run = f.run AND n.i = f.i + 1)"


#: State of a span over the offset: 0 none, 1 above the offset, 2 prolonged; what it ended with is told on the row after.
OFFSET = walk(
    "run, i, t, CASE WHEN abs(v) > 40 THEN 1 ELSE 0 END, t, t, 1, NULL::BIGINT, NULL::BIGINT, NULL::INT",
    """n.run, n.i, n.t,
    CASE WHEN m = 0 OR (m = 1 AND abs(n.v) <= 40 AND t1 - t0 < {half}) THEN CASE WHEN abs(n.v) > 40 THEN 1 ELSE 0 END
         WHEN m = 1 AND abs(n.v) > 40 THEN 1 WHEN abs(n.v) > 15 THEN 2 ELSE 0 END,
    CASE WHEN m = 0 THEN n.t ELSE t0 END, n.t, CASE WHEN m = 0 THEN 1 ELSE c + 1 END,
    CASE WHEN (m = 2 OR (m = 1 AND t1 - t0 >= {half})) AND abs(n.v) <= 15 THEN t0 END,
    CASE WHEN (m = 2 OR (m = 1 AND t1 - t0 >= {half})) AND abs(n.v) <= 15 THEN t1 END,
    CASE WHEN (m = 2 OR (m = 1 AND t1 - t0 >= {half})) AND abs(n.v) <= 15 THEN c END""".replace("{half}", str(DAY // 2)),
    "run, i, t, m, t0, t1, c, o0, o1, oc",
)
SEGMENTS = "lab AS (SELECT run, seq, t, v, v < 15 AS low FROM front), ch AS (SELECT *, CASE WHEN low = lag(low) OVER w THEN 0 ELSE 1 END AS new FROM lab WINDOW w AS (PARTITION BY run ORDER BY t, seq)), no AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY t, seq) AS run_no FROM ch), sg AS (SELECT run, run_no, min(t) AS a, max(t) AS b, max(v) AS vmax FROM no WHERE NOT low GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY a) AS i FROM sg)"


def _targets_sql() -> str:
    """The chosen row of each target in turn, with what was chosen before."""
    steps, before = [], []
    for k, share in enumerate((0.2, 0.4, 0.6, 0.8)):
        far = " AND ".join(f"NOT EXISTS (SELECT 1 FROM c{j} WHERE c{j}.run = x.run AND abs(x.t - c{j}.t) < {2 * DAY})" for j in before) or "TRUE"
        steps.append(f"c{k} AS (SELECT x.run, {k} AS target, arg_min(x.t, (x.t, x.seq)) AS t, arg_min(x.seq, (x.t, x.seq)) AS seq FROM ends x WHERE x.t >= a + {share} * (b - a) AND {far} GROUP BY x.run)")
        before.append(k)
    return "ends AS (SELECT *, min(t) OVER (PARTITION BY run) AS a, max(t) OVER (PARTITION BY run) AS b FROM front), " + ", ".join(steps)


SLOW = Config(second=3600.0, jump=2.0, margin=1.0, late=1.0, stale=24.0, spike=10.0, gap=48.0, longest_step=1.0, lag=4.0, lag_brake=4.0, command_stale=48.0, command_history=48.0, dead_traction=1.0, dead_brake=0.5, frozen=24.0, accel_window=2.0, fresh=24.0, furthest=4.0)
#: A grade and curvature profile along the way.
TRACK = Track(arc=[0.0, 50.0, 120.0, 400.0, 1000.0], grade=[0.0, 0.01, -0.01, 0.005, 0.0], curvature=[0.0, 0.01, 0.0, 0.02, 0.0])


@register("st1_clock_consensus")
def _(s, d):
    return estimate(messages(s, d), SLOW).groupBy("run", "flag").agg(F.count(F.lit(1)).alias("n"))


@register("st2_sensor_fusion")
def _(s, d):
    return estimate(messages(s, d), SLOW).groupBy("run", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if("slip").alias("slipping"))


@register("st5_speed_estimate")
def _(s, d):
    return estimate(messages(s, d), SLOW).select("run", "seq", "t_eff", "flag", F.round("v", 6).alias("v"), F.round("var", 6).alias("var"), "state", "slip")


@register("st3_command_model")
def _(s, d):
    """How far and how fast commands alone carry each run: the drive model without any wheel."""
    e = estimate(messages(s, d).filter("stream = 'cmd'"), SLOW)
    return e.select("run", "seq", "mode", F.round("v", 6).alias("v"), F.round("way", 4).alias("way"), F.round("var", 6).alias("var"))


@register("st4_five_state_filter")
def _(s, d):
    e = estimate(messages(s, d), SLOW)
    return e.select("run", "seq", "mode", F.round("way", 4).alias("way"), F.round("var_way", 4).alias("var_way"), F.round("bias", 6).alias("bias"))


@register("st6_answers_to_late_messages")
def _(s, d):
    """Every fifth message arrives later; late stamps are answered with the speed and way carried back to them."""
    m = messages(s, d).withColumn("seq", 2 * F.col("seq") + F.when(F.col("seq") % 5 == 0, 12_001).otherwise(0))
    e = estimate(m, SLOW).filter("flag = 2")
    return e.select("run", "seq", "t_eff", F.round("v", 6).alias("v"), F.round("way", 4).alias("way"))


@register("st13_answers_to_wheels_only")
def _(s, d):
    return estimate(messages(s, d), replace(SLOW, publish_on="wheels")).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("way"), 4).alias("way"))


@register("u3_track_lookups")
def _(s, d):
    e = estimate(messages(s, d), SLOW, TRACK)
    return e.groupBy("run").agg(F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.max("way"), 4).alias("way"))


@register("st11_correction_ramp", over(walk("run, i, t, seq, v", "n.run, n.i, n.t, n.seq, f.y + least(greatest(n.v - f.y, -0.001 * (n.t - f.t) / 1e6), 0.001 * (n.t - f.t) / 1e6)", "run, i, t, seq, y"), "SELECT run, seq, round(y, 6) AS ramped FROM f"))
def _(s, d):
    return recurrences.ramp(front(s, d), rate=0.001).select("run", "seq", *r6("ramped"))


@register("w12_spike_rule", over(walk("run, i, t, seq, v, v, t, TRUE", "n.run, n.i, n.t, n.seq, n.v, CASE WHEN ok AND abs(n.v - v0) > 60 + 0.0005 * (n.t - t0) / 1e6 THEN v0 ELSE n.v END, CASE WHEN ok AND abs(n.v - v0) > 60 + 0.0005 * (n.t - t0) / 1e6 THEN t0 ELSE n.t END, NOT (ok AND abs(n.v - v0) > 60 + 0.0005 * (n.t - t0) / 1e6)", "run, i, t, seq, v, v0, t0, ok"), "SELECT run, t, seq, v, ok AS accepted FROM f"))
def _(s, d):
    return recurrences.reject_spikes(front(s, d), jump=60.0, per_second=0.0005)


@register("w22_sustained_offsets", over(OFFSET, f"SELECT run, o0 AS start, o1 AS stop, oc AS n FROM f WHERE o0 IS NOT NULL UNION ALL SELECT run, t0, t1, c FROM f WHERE i = (SELECT max(i) FROM num WHERE num.run = f.run) AND (m = 2 OR (m = 1 AND t1 - t0 >= {DAY // 2}))"))
def _(s, d):
    return recurrences.offset_runs(front(s, d), offset=40.0, release=15.0, least=DAY // 2)


@register("w26_bounded_reemission", over(walk("run, i, seq, x, [x], TRUE", "n.run, n.i, n.seq, n.x, CASE WHEN list_contains(last, n.x) THEN last ELSE list_append(last, n.x)[-64:] END, NOT list_contains(last, n.x)", "run, i, seq, x, last, new", f"(SELECT run, seq, t // {6 * HOUR} AS x FROM s)", "seq"), "SELECT run, seq, x AS stamp FROM f WHERE new"))
def _(s, d):
    return recurrences.skip_recent(log(s, d).withColumn("stamp", F.floor(F.col("t") / F.lit(6 * HOUR))), by="stamp")


@register("w27_least_travel", over(walk("run, i, t, seq, v, v, TRUE", "n.run, n.i, n.t, n.seq, n.v, CASE WHEN abs(n.v - last) >= 25 THEN n.v ELSE last END, abs(n.v - last) >= 25", "run, i, t, seq, v, last, kept"), "SELECT run, t, seq, v FROM f WHERE kept"))
def _(s, d):
    return recurrences.keep_spaced(front(s, d), by="v", least=25.0)


@register("w30_first_order_lag", over(walk("run, i, t, seq, v", "n.run, n.i, n.t, n.seq, z + (1 - exp(-(n.t - f.t) / 1e6 / 43200.0)) * (n.v - z)", "run, i, t, seq, z"), "SELECT run, seq, round(z, 6) AS filtered FROM f"))
def _(s, d):
    return recurrences.lag_filter(front(s, d), tau=12 * 3600.0).select("run", "seq", *r6("filtered"))


@register("w33_forward_progress", over(walk("run, i, t, seq, v, v, TRUE", "n.run, n.i, n.t, n.seq, n.v, CASE WHEN n.v - last > 0.2 THEN n.v ELSE last END, n.v - last > 0.2", "run, i, t, seq, v, last, kept"), "SELECT run, t, seq, v FROM f WHERE kept"))
def _(s, d):
    return recurrences.keep_progress(front(s, d), by="v", least=0.2)


@register("w34_best_window", over(SEGMENTS + f", w AS (SELECT p.run, p.i, p.a AS start, max(q.b) AS stop, count(*) AS c, sum(q.vmax) AS total FROM k p JOIN (VALUES (1), (2), (3)) z(c) ON TRUE JOIN k q ON q.run = p.run AND q.i BETWEEN p.i AND p.i + z.c - 1 GROUP BY p.run, p.i, p.a, z.c HAVING count(*) = z.c AND max(q.b) - p.a <= {7 * DAY})", "SELECT run, start, stop, c::INT AS segments, total FROM w QUALIFY row_number() OVER (PARTITION BY run ORDER BY total DESC, i, c) = 1"))
def _(s, d):
    r = episodes.runs(front(s, d), F.col("v") < 15).filter("not label")
    segments = r.groupBy("run", "run_no").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max("v").alias("vmax"))
    return recurrences.best_window(segments, longest=7 * DAY)


@register("o6_spaced_samples", over(_targets_sql(), " UNION ALL ".join(f"SELECT run, target, t, seq FROM c{k}" for k in range(4))))
def _(s, d):
    return recurrences.sample_targets(front(s, d), targets=(0.2, 0.4, 0.6, 0.8), spacing=2 * DAY)


@register("e8_kinematic_filter")
def _(s, d):
    return recurrences.kinematic_filter(rear(s, d), q=5.0, r=100.0, second=3600.0).select("run", "seq", F.round("speed", 5).alias("speed"), F.round("accel", 5).alias("accel"))


@register("e2_evaluation_of_estimates")
def _(s, d):
    e = estimate(messages(s, d), SLOW)
    truth = front(s, d).select("run", "seq", (F.col("v") / 10).alias("truth"))
    x = e.join(truth, ["run", "seq"]).withColumn("e", F.col("v") - F.col("truth"))
    return x.groupBy("run").agg(*aggregates.error_stats(F.col("e")))


@register("e4_replay_with_variants")
def _(s, d):
    parts = [estimate(messages(s, d), c).groupBy("run").agg(F.avg("v").alias("mean_v")).withColumn("variant", F.lit(n)) for n, c in (("usual", SLOW), ("no_bias", replace(SLOW, bias_noise=0.0)), ("strict", replace(SLOW, agree=0.05)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
