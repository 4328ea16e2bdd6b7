"""Queries over ordered analytics and episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import episodes, timeops, windows
from sensorloom.operators.windows import backward, line, so_far
from sensorloom.plans.joins import near
from sensorloom.plans.registry import HOUR, fix, front, log, over, r6, rear, register

OW = "WINDOW w AS (PARTITION BY run ORDER BY t, seq)"
DAY = 24 * HOUR
TOL_DAY = 2 * DAY


@register("w1_step_differences", over(f"d AS (SELECT run, seq, t - lag(t) OVER w AS dt, v - lag(v) OVER w AS dv FROM front {OW})", "SELECT run, count(dt) AS steps, sum(CASE WHEN dv < 0 THEN 1 ELSE 0 END)::BIGINT AS back_steps, round(max(abs(dv)), 6) AS largest FROM d GROUP BY run"))
def _(s, d):
    x = front(s, d).select("run", (F.col("t") - F.lag("t").over(line())).alias("dt"), (F.col("v") - F.lag("v").over(line())).alias("dv"))
    return x.groupBy("run").agg(F.count("dt").alias("steps"), F.count_if(F.col("dv") < 0).alias("back_steps"), F.round(F.max(F.abs("dv")), 6).alias("largest"))


ODO = f"st AS (SELECT run, seq, t, v, least(greatest((t - lag(t) OVER w) / 1e6, 0.0), 36000.0) * (v + lag(v) OVER w) / 2 AS step FROM front {OW}), od AS (SELECT run, seq, t, v, coalesce(sum(step) OVER (PARTITION BY run ORDER BY t, seq), 0.0) AS way FROM st)"


def _odometer(df):
    stepped = df.withColumn("step", windows.odometer(F.col("t"), F.col("v"), line(), 36000.0))
    return stepped.withColumn("way", F.coalesce(F.sum("step").over(so_far(line())), F.lit(0.0)))


@register("w2_trapezoid_odometer", over(ODO, "SELECT run, seq, round(way, 3) AS way FROM od"))
def _(s, d):
    return _odometer(front(s, d)).select("run", "seq", F.round("way", 3).alias("way"))


@register("w3_running_maximum", over("", f"SELECT run, seq, max(v) OVER w AS top FROM front {OW}"))
def _(s, d):
    return front(s, d).select("run", "seq", F.max("v").over(so_far(line())).alias("top"))


@register("w4_label_forward_fill", over(f"l AS (SELECT run, seq, t, CASE WHEN v > 60 THEN 1 WHEN v < 15 THEN -1 END AS sign FROM front), f AS (SELECT run, seq, last_value(sign IGNORE NULLS) OVER w AS sign FROM l {OW})", "SELECT run, seq, coalesce(sign, 1) AS sign FROM f"))
def _(s, d):
    sign = F.when(F.col("v") > 60, 1).when(F.col("v") < 15, -1)
    return front(s, d).withColumn("x", sign).select("run", "seq", F.coalesce(F.last("x", ignorenulls=True).over(so_far(line())), F.lit(1)).alias("sign"))


def _mean_sql(n: int, src: str) -> str:
    lo, hi = n // 2, n - 1 - n // 2
    return f"""ma AS (SELECT run, seq, t, v, (sum(v) OVER (PARTITION BY run ORDER BY t, seq ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)
        + greatest(0, {lo} - (row_number() OVER w - 1)) * first_value(v) OVER (PARTITION BY run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        + greatest(0, {hi} - (count(*) OVER (PARTITION BY run) - row_number() OVER w)) * last_value(v) OVER (PARTITION BY run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {n} AS smooth FROM {src} {OW})"""


@register("w5_edge_padded_moving_average", over(_mean_sql(11, "front"), "SELECT run, seq, round(smooth, 6) AS smooth FROM ma"))
def _(s, d):
    return front(s, d).select("run", "seq", F.round(windows.moving_average(F.col("v"), 11, line()), 6).alias("smooth"))


def _gradient_sql(src: str, x: str) -> str:
    return f"""gs AS (SELECT run, seq, t, {x} AS x, (t - lag(t) OVER w) / 1e9 AS h0, (lead(t) OVER w - t) / 1e9 AS h1, lag({x}) OVER w AS xb, lead({x}) OVER w AS xa FROM {src} {OW}),
    gr AS (SELECT run, seq, t, x, CASE WHEN xb IS NULL THEN (xa - x) / h1 WHEN xa IS NULL THEN (x - xb) / h0 ELSE (h0 * h0 * xa + (h1 * h1 - h0 * h0) * x - h1 * h1 * xb) / (h0 * h1 * (h0 + h1)) END AS g FROM gs)"""


@register("w6_uneven_gradient", over(_gradient_sql("front", "v"), "SELECT run, seq, round(g, 3) AS gradient FROM gr"))
def _(s, d):
    return front(s, d).select("run", "seq", F.round(windows.gradient(F.col("v"), F.col("t") / 1e9, line()), 3).alias("gradient"))


@register("w7_angle_unwrap", over(f"a AS (SELECT run, seq, t, v % 6.283185307179586 AS angle FROM front), c AS (SELECT *, -6.283185307179586 * round_even((angle - lag(angle) OVER w) / 6.283185307179586, 0) AS fix FROM a {OW})", "SELECT run, seq, round(angle + coalesce(sum(fix) OVER (PARTITION BY run ORDER BY t, seq), 0), 6) AS unwrapped FROM c"))
def _(s, d):
    a = front(s, d).withColumn("angle", F.col("v") % 6.283185307179586).withColumn("fix", windows.unwrap(F.col("angle"), line()))
    return a.select("run", "seq", F.round(F.col("angle") + F.coalesce(F.sum("fix").over(so_far(line())), F.lit(0.0)), 6).alias("unwrapped"))


def _shifted(name: str, by: int) -> str:
    return f"""{name}b AS (SELECT a.run, a.seq, a.t + {by} AS t, b.t AS t0, b.v AS v0 FROM (SELECT *, t + {by} AS tt FROM front) a ASOF LEFT JOIN front b ON a.run = b.run AND a.tt >= b.t),
    {name}a AS (SELECT a.seq, b.t AS t1, b.v AS v1 FROM (SELECT *, t + {by} AS tt FROM front) a ASOF LEFT JOIN front b ON a.run = b.run AND a.tt < b.t),
    {name} AS (SELECT run, seq, t - {by} AS t, CASE WHEN t0 = t THEN v0 WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS x FROM {name}b JOIN {name}a USING (seq))"""


@register("w8_difference_over_interval", over(_shifted("lo", -6 * HOUR) + ", " + _shifted("hi", 6 * HOUR), "SELECT lo.run, lo.seq, round((hi.x - lo.x) / 12, 6) AS rate FROM lo JOIN hi USING (seq)"))
def _(s, d):
    f = front(s, d)
    at = lambda by, n: timeops.interpolate(f.withColumn("t", F.col("t") + by), f, out=n).select("run", "seq", n)
    return at(-6 * HOUR, "a").join(at(6 * HOUR, "b"), ["run", "seq"]).select("run", "seq", F.round((F.col("b") - F.col("a")) / 12, 6).alias("rate"))


@register("w9_running_median_mask", over("m AS (SELECT run, seq, v, quantile_cont(v, 0.5) OVER (PARTITION BY run ORDER BY t, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM front)", "SELECT run, seq, round(med, 6) AS med, abs(v - med) > 60 AS glitch FROM m"))
def _(s, d):
    m = front(s, d).withColumn("med", windows.running_median(F.col("v"), 11, line()))
    return m.select("run", "seq", F.round("med", 6).alias("med"), (F.abs(F.col("v") - F.col("med")) > 60).alias("glitch"))


@register("w10_position_glitch", over(f"st AS (SELECT run, seq, t, v, v - lag(v) OVER w AS moved, (t - lag(t) OVER w) / {HOUR}.0 * 2.0 AS room FROM front {OW})", "SELECT run, seq, coalesce(abs(moved) > room + 40, FALSE) AS glitch FROM st"))
def _(s, d):
    moved, room = F.col("v") - F.lag("v").over(line()), (F.col("t") - F.lag("t").over(line())) / HOUR * 2.0
    return front(s, d).select("run", "seq", F.coalesce(F.abs(moved) > room + 40, F.lit(False)).alias("glitch"))


FROZEN = f"""st AS (SELECT run, seq, t, v, abs(v - lag(v) OVER w) AS step FROM front {OW}),
    md AS (SELECT run, seq, t, v, quantile_cont(step, 0.5) OVER r AS med, count(step) OVER r AS n FROM st WINDOW r AS (PARTITION BY run ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING)),
    fl AS (SELECT *, v < 20 AND n >= 3 AND med > 25 AS hit FROM md),
    lastly AS (SELECT *, max(CASE WHEN hit THEN t END) OVER w AS lt, min(CASE WHEN hit THEN t END) OVER (PARTITION BY run ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM fl {OW})"""


@register("w11_frozen_reference_mask", over(FROZEN, f"SELECT run, seq, hit OR (n < 3 AND coalesce(t - lt <= {TOL_DAY}, FALSE)) OR (n < 3 AND coalesce(nt - t <= {TOL_DAY}, FALSE)) AS frozen FROM lastly"))
def _(s, d):
    around = Window.partitionBy("run").orderBy("t").rangeBetween(-DAY, DAY)
    x = front(s, d).withColumn("step", F.abs(F.col("v") - F.lag("v").over(line())))
    x = x.withColumn("med", F.percentile("step", F.lit(0.5)).over(around)).withColumn("n", F.count("step").over(around))
    x = x.withColumn("hit", F.coalesce((F.col("v") < 20) & (F.col("n") >= 3) & (F.col("med") > 25), F.lit(False))).withColumn("at", F.when(F.col("hit"), F.col("t")))
    back, ahead = F.max("at").over(so_far(line())), F.min("at").over(so_far(backward()))
    close = (F.col("n") < 3) & (F.coalesce(F.col("t") - back <= TOL_DAY, F.lit(False)) | F.coalesce(ahead - F.col("t") <= TOL_DAY, F.lit(False)))
    return x.select("run", "seq", (F.col("hit") | close).alias("frozen"))


RUNS = f"c AS (SELECT run, seq, t, v, CASE WHEN lvl = lag(lvl) OVER w THEN 0 ELSE 1 END AS new, lvl FROM (SELECT *, floor(v / 40) AS lvl FROM front) {OW}), k AS (SELECT *, sum(new) OVER w AS no FROM c {OW})"


@register("w13_frozen_sensor_runs", over(RUNS + ", g AS (SELECT run, no, min(lvl)::BIGINT AS lvl, min(t) AS a, max(t) AS b, count(*) AS n FROM k GROUP BY run, no)", f"SELECT g.run, g.lvl, g.n, count(r.v) AS others, round(max(r.v) - min(r.v), 6) AS other_range FROM g LEFT JOIN rear r ON r.run = g.run AND r.t BETWEEN g.a AND g.b WHERE b - a >= {12 * HOUR} GROUP BY g.run, g.no, g.lvl, g.n"))
def _(s, d):
    r = episodes.runs(front(s, d), F.floor(F.col("v") / 40))
    g = r.groupBy("run", "run_no").agg(F.first("label").alias("lvl"), F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("b") - F.col("a") >= 12 * HOUR)
    # runs do not overlap, so the run that holds a stamp is the last that began before it
    held = timeops.asof(rear(s, d), g.select("run", F.col("a").alias("t"), F.col("a").alias("seq"), "run_no", "b"), values=("run_no", "b")).filter(F.col("t") <= F.col("r_b"))
    other = held.groupBy("run", F.col("r_run_no").alias("run_no")).agg(F.count("v").alias("others"), F.round(F.max("v") - F.min("v"), 6).alias("other_range"))
    return g.join(other, ["run", "run_no"], "left").select("run", "lvl", "n", F.coalesce("others", F.lit(0)).alias("others"), "other_range")


@register("w14_stuck_at_zero", over("h AS (SELECT a.run, a.seq, a.v, b.v AS ov, a.t - b.t AS age FROM front a ASOF LEFT JOIN rear b ON a.run = b.run AND a.t >= b.t)", f"SELECT run, seq, coalesce(v < 5 AND ov > 20 AND age <= {12 * HOUR}, FALSE) AS stuck FROM h"))
def _(s, d):
    return timeops.asof(front(s, d), rear(s, d), stale=12 * HOUR).select("run", "seq", F.coalesce((F.col("v") < 5) & (F.col("r_v") > 20), F.lit(False)).alias("stuck"))


@register("w15_common_mode_acceleration", over(f"p AS (SELECT run, seq, t, v, t - {6 * HOUR} AS tp FROM front), h AS (SELECT a.run, a.seq, a.t, a.v, b.t AS t0, b.v AS v0 FROM p a ASOF LEFT JOIN front b ON a.run = b.run AND a.tp >= b.t)", f"SELECT run, seq, round((v - v0) / ((t - t0) / {HOUR}.0), 6) AS slope, coalesce((v - v0) / ((t - t0) / {HOUR}.0) > 2.5 OR (v - v0) / ((t - t0) / {HOUR}.0) < -6, FALSE) AS common FROM h"))
def _(s, d):
    h = timeops.asof(front(s, d), front(s, d), shift=6 * HOUR)
    slope = (F.col("v") - F.col("r_v")) / ((F.col("t") - F.col("r_t")) / HOUR)
    return h.select("run", "seq", F.round(slope, 6).alias("slope"), F.coalesce((slope > 2.5) | (slope < -6), F.lit(False)).alias("common"))


@register("w16_hold_after_trigger", over("", f"SELECT run, seq, coalesce(t - max(CASE WHEN v > 120 THEN t END) OVER w < {2 * DAY}, FALSE) AS held FROM front {OW}"))
def _(s, d):
    return front(s, d).select("run", "seq", windows.held(F.col("v") > 120, F.col("t"), line(), 2 * DAY).alias("held"))


ISLANDS = f"f AS (SELECT run, seq, t FROM s WHERE v > 40), g AS (SELECT run, t, seq, CASE WHEN t - lag(t) OVER w <= {DAY} THEN 0 ELSE 1 END AS new FROM f {OW}), h AS (SELECT run, t, sum(new) OVER w AS no FROM g {OW}), ep AS (SELECT run, min(t) AS start, max(t) AS stop, count(*) AS n FROM h GROUP BY run, no)"


@register("w17_episodes", over(ISLANDS, "SELECT * FROM ep"))
def _(s, d):
    return episodes.islands(log(s, d).filter("v > 40"), gap=DAY).select("run", "start", "stop", "n")


@register("w18_index_intervals", over(f"n AS (SELECT run, seq, t, v > 40 AS on_, row_number() OVER w - 1 AS i FROM front {OW}), g AS (SELECT run, i, i - row_number() OVER (PARTITION BY run ORDER BY i) AS grp FROM n WHERE on_)", "SELECT run, min(i) AS first, max(i) AS last FROM g GROUP BY run, grp"))
def _(s, d):
    return episodes.intervals(front(s, d), F.col("v") > 40).select("run", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


MERGED = f"""lab AS (SELECT run, seq, t, CASE WHEN v > 60 THEN 'high' WHEN v < 15 THEN 'low' ELSE 'mid' END AS l FROM front),
    ch AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY run ORDER BY t, seq) THEN 0 ELSE 1 END AS new FROM lab), no AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY t, seq) AS no FROM ch),
    g AS (SELECT run, no, min(l) AS l, min(t) AS a, max(t) AS b FROM no GROUP BY run, no), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY a, b, l) AS i FROM g),
    m(run, i, k, l, a, b) AS (SELECT run, i, 1, l, a, b FROM o WHERE i = 1 UNION ALL
      SELECT o.run, o.i, CASE WHEN o.b - o.a < {DAY} OR o.l = m.l THEN m.k ELSE m.k + 1 END, CASE WHEN o.b - o.a < {DAY} OR o.l = m.l THEN m.l ELSE o.l END, CASE WHEN o.b - o.a < {DAY} OR o.l = m.l THEN m.a ELSE o.a END, o.b FROM m JOIN o ON o.run = m.run AND o.i = m.i + 1)"""


@register("w19_runs_with_short_ones_merged", over(MERGED, "SELECT run, min(a) AS start, arg_max(b, i) AS stop, min(l) AS label FROM m GROUP BY run, k"))
def _(s, d):
    label = F.when(F.col("v") > 60, "high").when(F.col("v") < 15, "low").otherwise("mid")
    return episodes.merge_short_runs(front(s, d), label, least=DAY)


SEG = f"""c AS (SELECT run, seq, t, v, CASE WHEN (v < 15) = (lag(v) OVER w < 15) THEN 0 ELSE 1 END AS new FROM front {OW}),
    k AS (SELECT *, sum(new) OVER w AS no FROM c {OW}), r AS (SELECT run, no, bool_and(v < 15) AS still, min(t) AS a, max(t) AS b, max(v) AS vmax, count(*) AS n FROM k GROUP BY run, no)"""


@register("w20_segments_between_stops", over(SEG, "SELECT run, a AS start, b AS stop, round(vmax, 6) AS vmax, n FROM r WHERE NOT still AND no > 1 AND no < (SELECT max(no) FROM r q WHERE q.run = r.run)"))
def _(s, d):
    r = episodes.runs(front(s, d), F.col("v") < 15)
    g = r.groupBy("run", "run_no").agg(F.first("label").alias("still"), F.min("t").alias("start"), F.max("t").alias("stop"), F.round(F.max("v"), 6).alias("vmax"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("top", F.max("run_no").over(Window.partitionBy("run")))
    return g.filter(~F.col("still") & (F.col("run_no") > 1) & (F.col("run_no") < F.col("top"))).select("run", "start", "stop", "vmax", "n")


@register("w21_recovery_time", over(f"b AS (SELECT run, seq, t, v > 60 AS bad FROM front), n AS (SELECT run, t, bad, min(CASE WHEN bad THEN t END) OVER f AS nb, max(t) OVER f AS e FROM b WINDOW f AS (PARTITION BY run ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", f"SELECT run, min(CASE WHEN NOT bad AND (nb IS NULL OR nb > t + {DAY}) AND e >= t + {DAY} THEN t END) AS recovered, min(t) AS start FROM n GROUP BY run"))
def _(s, d):
    return episodes.recovery(front(s, d), F.col("v") > 60, hold=DAY).select("run", "recovered", "start")


@register("w23_time_in_state", over(RUNS, "SELECT run, seq, t - min(t) OVER (PARTITION BY run, no) AS age FROM k"))
def _(s, d):
    r = episodes.runs(front(s, d), F.floor(F.col("v") / 40))
    return r.select("run", "seq", (F.col("t") - F.min("t").over(Window.partitionBy("run", "run_no"))).alias("age"))


@register("w24_last_of_each_stamp", over("", f"SELECT run, t // {HOUR} AS stamp, arg_max(v, seq) AS v, max(seq) AS seq FROM s GROUP BY ALL"))
def _(s, d):
    x = log(s, d).select("run", F.floor(F.col("t") / F.lit(HOUR)).alias("stamp"), "seq", "v")
    return timeops.last_per_key(x, ["run", "stamp"]).select("run", "stamp", "v", "seq")


@register("w25_least_spacing", over(f"g AS (SELECT run, seq, t - lag(t) OVER w AS dt FROM s {OW})", f"SELECT run, seq FROM g WHERE dt IS NULL OR dt > {HOUR}"))
def _(s, d):
    return log(s, d).withColumn("dt", F.col("t") - F.lag("t").over(line())).filter(F.col("dt").isNull() | (F.col("dt") > HOUR)).select("run", "seq")


@register("w28_rolling_slope", over(f"r AS (SELECT run, seq, t, v, regr_slope(v, (t - 1704067200000000) / {HOUR}.0) OVER w AS slope, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY run ORDER BY t RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW))", "SELECT run, seq, CASE WHEN n >= 5 AND NOT isnan(slope) THEN round(slope, 5) END AS slope FROM r"))
def _(s, d):
    frame = Window.partitionBy("run").orderBy("t").rangeBetween(-3 * DAY, 0)
    slope = F.regr_slope("v", (F.col("t") - 1704067200000000) / HOUR).over(frame)
    return log(s, d).select("run", "seq", F.when(F.count(F.lit(1)).over(frame) >= 5, F.round(slope, 5)).alias("slope"))


@register("w29_rolling_mean_null_edges", over("m AS (SELECT run, seq, avg(v) OVER w AS m, count(*) OVER w AS n FROM front WINDOW w AS (PARTITION BY run ORDER BY t, seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))", "SELECT run, seq, CASE WHEN n = 7 THEN round(m, 6) END AS mean FROM m"))
def _(s, d):
    f = line().rowsBetween(-3, 3)
    return front(s, d).select("run", "seq", F.when(F.count(F.lit(1)).over(f) == 7, F.round(F.avg("v").over(f), 6)).alias("mean"))


@register("w31_onsets", over(f"l AS (SELECT run, seq, v, lag(v) OVER w AS pv FROM front {OW})", "SELECT run, seq FROM l WHERE v > 60 AND pv <= 60"))
def _(s, d):
    return front(s, d).withColumn("pv", F.lag("v").over(line())).filter("v > 60 and pv <= 60").select("run", "seq")


@register("w32_rate_statistics", over(f"g AS (SELECT run, t, t - lag(t) OVER w AS dt FROM front {OW})", "SELECT run, round(median(dt) / 1e6, 3) AS median_dt, round((count(*) - 1) / ((max(t) - min(t)) / 1e9), 6) AS rate FROM g GROUP BY run HAVING count(*) > 1"))
def _(s, d):
    """A run of one row has no rate and is left out before anything is divided; rows that share one stamp have an infinite one."""
    g = front(s, d).withColumn("dt", F.col("t") - F.lag("t").over(line()))
    runs = g.groupBy("run").agg(F.median("dt").alias("dt"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span")).filter("n > 1")
    rate = F.when(F.col("span") == 0, float("inf")).otherwise((F.col("n") - 1) / (F.col("span") / 1e9))
    return runs.select("run", F.round(F.col("dt") / 1e6, 3).alias("median_dt"), F.round(rate, 6).alias("rate"))


SESSIONS = f"g AS (SELECT run, seq, t, v, CASE WHEN t - lag(t) OVER w > {DAY // 2} THEN 1 ELSE 0 END AS new FROM s {OW}), h AS (SELECT *, sum(new) OVER w AS no FROM g {OW}), b AS (SELECT *, (row_number() OVER (PARTITION BY run, no ORDER BY t, seq) - 1) // 8 AS burst FROM h)"


@register("st9_burst_sessions", over(SESSIONS, "SELECT run, min(t) AS start, max(t) AS stop, count(*) AS n, round(median(v), 6) AS median FROM b GROUP BY run, no, burst"))
def _(s, d):
    b = episodes.sessions(log(s, d), gap=DAY // 2, most=8)
    return b.groupBy("run", "session", "burst").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("n"), F.round(F.median("v"), 6).alias("median")).drop("session", "burst")


@register("st10_burst_decision", over(SESSIONS + ", q AS (SELECT run, no, burst, median(v) AS mid, count(*) AS n, max(t) AS stop FROM b GROUP BY run, no, burst)", "SELECT q.run, q.stop, round(any_value(mid), 6) AS mid, round(median(abs(v - mid)), 6) AS spread, count(*) >= 2 AND median(abs(v - mid)) <= 30 AS used FROM q JOIN b USING (run, no, burst) GROUP BY q.run, q.no, q.burst, q.stop"))
def _(s, d):
    b = episodes.sessions(log(s, d), gap=DAY // 2, most=8)
    k = ["run", "session", "burst"]
    q = b.groupBy(*k).agg(F.median("v").alias("mid"), F.max("t").alias("stop"))
    spread = F.median(F.abs(F.col("v") - F.col("mid")))
    return b.join(q, k).groupBy(*k, "stop").agg(F.round(F.first("mid"), 6).alias("mid"), F.round(spread, 6).alias("spread"), ((F.count(F.lit(1)) >= 2) & (spread <= 30)).alias("used")).select("run", "stop", "mid", "spread", "used")


@register("st14_delayed_output", over(_shifted("lo", -3 * HOUR), "SELECT run, seq, round(x, 6) AS delayed FROM lo"))
def _(s, d):
    f = front(s, d)
    return timeops.interpolate(f.withColumn("t", F.col("t") - 3 * HOUR), f, out="delayed").select("run", "seq", *r6("delayed"))


@register("st15_on_change", over(f"l AS (SELECT run, seq, v > 60 AS flag, lag(v > 60) OVER w AS was FROM front {OW})", "SELECT run, seq, flag FROM l WHERE flag IS DISTINCT FROM was"))
def _(s, d):
    x = front(s, d).withColumn("flag", F.col("v") > 60)
    return x.withColumn("was", F.lag("flag").over(line())).filter(~F.col("flag").eqNullSafe(F.col("was"))).select("run", "seq", "flag")


@register("st19_limited_feed", over("f AS (SELECT run, seq, t - min(t) OVER (PARTITION BY run) AS since FROM fix)", f"SELECT run, seq FROM f WHERE since <= {DAY} OR (since - {DAY}) % {5 * DAY} <= {DAY}"))
def _(s, d):
    since = F.col("t") - F.min("t").over(Window.partitionBy("run"))
    return fix(s, d).withColumn("since", since).filter((F.col("since") <= DAY) | ((F.col("since") - DAY) % (5 * DAY) <= DAY)).select("run", "seq")


@register("p14_regimes", over(_mean_sql(11, "front") + ", " + _gradient_sql("ma", "smooth"), "SELECT run, seq, CASE WHEN x < 30 THEN 'stopped' WHEN g > 0.15 THEN 'accel' WHEN g < -0.15 THEN 'brake' ELSE 'cruise' END AS regime FROM gr"))
def _(s, d):
    return with_regime(front(s, d)).select("run", "seq", "regime")


def with_regime(df):
    """Regime of each row by the gradient of the smoothed value; standing still overrides."""
    from sensorloom.functions.scalars import regime

    x = df.withColumn("smooth", windows.moving_average(F.col("v"), 11, line()))
    g = windows.gradient(F.col("smooth"), F.col("t") / 1e9, line())
    return x.withColumn("accel", g).withColumn("regime", regime(F.col("accel"), F.col("smooth"), still=30.0))


REGIME_SQL = _mean_sql(11, "front") + ", " + _gradient_sql("ma", "smooth") + ", rg AS (SELECT run, seq, CASE WHEN x < 30 THEN 'stopped' WHEN g > 0.15 THEN 'accel' WHEN g < -0.15 THEN 'brake' ELSE 'cruise' END AS regime FROM gr)"
FLAGSHIP = "matched AS (SELECT n.run, n.seq, rg.regime, r_v - v AS e FROM near n JOIN rg USING (run, seq))"


@register(
    "flagship",
    over(
        near("front", "rear", 6 * HOUR) + ", " + REGIME_SQL + ", " + FLAGSHIP,
        "SELECT run, regime, count(*) AS n, round(avg(CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e), 0.99), 6) AS p99, round(max(abs(e)), 6) AS max FROM matched GROUP BY run, regime",
    ),
)
def _(s, d):
    """Match each view to the nearest click of the run, then error statistics by regime."""
    matched = timeops.nearest(with_regime(front(s, d)), rear(s, d), tol=6 * HOUR).withColumn("e", F.col("r_v") - F.col("v"))
    e, a = F.col("e"), F.abs("e")
    return matched.groupBy("run", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(e.isNotNull().cast("double")), 6).alias("coverage"), F.round(F.avg(e), 6).alias("bias"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(a), 6).alias("mae"), F.round(F.percentile(a, F.lit(0.99)), 6).alias("p99"), F.round(F.max(a), 6).alias("max"),
    )

