"""Queries over scans, projections, predicates, map frames, faults and geometry."""

from __future__ import annotations

from math import cos, radians, sin, sqrt

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.functions import geo, scalars
from sensorloom.operators import faults, geometry
from sensorloom.operators.windows import line, so_far
from sensorloom.plans.joins import LINE, _segments_sql
from sensorloom.plans.registry import HOUR, cmd, front, log, over, r6, rear, register
from sensorloom.sources import logs
from sensorloom.sources.catalog import candidates, select_runs
from sensorloom.storage import scratch_path

DAY = 24 * HOUR


@register("s1_scan_with_stream_pruning", over("", "SELECT run, seq, t, v FROM s WHERE stream IN ('view', 'click')"))
def _(s, d):
    return log(s, d).filter(F.col("stream").isin("view", "click")).select("run", "seq", "t", "v")


@register("s6_cache_read", over("", "SELECT run, stream, count(*) AS n, round(sum(v), 4) AS total FROM s GROUP BY ALL"))
def _(s, d):
    """The whole log through a columnar cache in the shared folder."""
    path = scratch_path(s, "cache")
    logs.write_cache(log(s, d), path)
    samples = logs.read_cache(s, path)
    return samples.groupBy("run", "stream").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("s7_catalog_resolution", over("n AS (SELECT DISTINCT 'car_' || lpad(run::VARCHAR, 6, '0') AS name FROM s)", "SELECT name FROM n WHERE name LIKE '%012'"))
def _(s, d):
    names = log(s, d).select(F.concat(F.lit("car_"), F.lpad(F.col("run").cast("string"), 6, "0")).alias("name")).distinct()
    return candidates(names, "012")  # the SQL lists all; ``resolve`` takes more than one for an error


@register("s19_latency_capture", over(f"l AS (SELECT run, t // {HOUR} AS stamp, min(t) AS arrived FROM front GROUP BY ALL), r AS (SELECT run, t // {HOUR} AS stamp, min(t) AS left_ FROM rear GROUP BY ALL)", "SELECT run, stamp, left_ - arrived AS latency FROM l JOIN r USING (run, stamp)"))
def _(s, d):
    first = lambda df, n: df.groupBy("run", F.floor(F.col("t") / F.lit(HOUR)).alias("stamp")).agg(F.min("t").alias(n))
    return first(front(s, d), "a").join(first(rear(s, d), "b"), ["run", "stamp"]).select("run", "stamp", (F.col("b") - F.col("a")).alias("latency"))


@register("p1_unit_scale", over("", "SELECT run, seq, round(greatest(v - 20, 0) / CASE WHEN run % 2 = 0 THEN 3.6 ELSE 3.53 END, 6) AS speed FROM front"))
def _(s, d):
    k = F.when(F.col("run") % 2 == 0, 3.6).otherwise(3.53)
    return front(s, d).select("run", "seq", F.round(scalars.scaled(F.col("v") - 20, k), 6).alias("speed"))


@register("p2_sample_validity", over("n AS (SELECT run, seq, t, CASE WHEN seq % 13 = 0 THEN 'NaN'::DOUBLE ELSE v - 10 END AS v FROM front)", "SELECT run, seq, CASE WHEN isnan(v) THEN FALSE ELSE v BETWEEN -5 AND 100 END AS valid FROM n"))
def _(s, d):
    v = F.when(F.col("seq") % 13 == 0, float("nan")).otherwise(F.col("v") - 10)
    return front(s, d).select("run", "seq", scalars.valid_sample(v).alias("valid"))


FIXES = "f AS (SELECT run, seq, t, v / 2 - 10 AS lat, v - 60 AS lon, (seq % 4 - 1)::INT AS status FROM s)"


def _fixes(s, d):
    return log(s, d).select("run", "seq", "t", (F.col("v") / 2 - 10).alias("lat"), (F.col("v") - 60).alias("lon"), (F.col("seq") % 4 - 1).cast("int").alias("status"))


@register("p3_fix_validity", over(FIXES, "SELECT run, seq, status >= 0 AND abs(lat) <= 84 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) AND t > 0 AS valid FROM f"))
def _(s, d):
    return _fixes(s, d).select("run", "seq", scalars.valid_fix(F.col("lat"), F.col("lon"), F.col("status"), F.col("t")).alias("valid"))


@register("p4_stamp_validity", over("n AS (SELECT run, seq, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 11 = 0 THEN -1 ELSE t END AS t FROM front)", "SELECT run, seq, CASE WHEN t > 0 THEN 0 ELSE 3 END AS flag FROM n"))
def _(s, d):
    t = F.when(F.col("seq") % 7 == 0, F.lit(None)).when(F.col("seq") % 11 == 0, -1).otherwise(F.col("t"))
    return front(s, d).select("run", "seq", F.when(scalars.valid_stamp(t), 0).otherwise(3).alias("flag"))


EAST, NORTH = geo.utm_sql("lat", "lon", 39.0)
PLACES = "pl AS (SELECT run, seq, 55.0 + (v % 60) / 100 AS lat, 37.0 + (seq % 90) / 30.0 AS lon, 100 + v AS alt FROM front)"


def _places(s, d):
    return front(s, d).select("run", "seq", (55.0 + (F.col("v") % 60) / 100).alias("lat"), (37.0 + (F.col("seq") % 90) / 30.0).alias("lon"), (100 + F.col("v")).alias("alt"))


@register("p5_map_projection", over(PLACES, f"SELECT run, seq, round({EAST}, 4) AS east, round({NORTH}, 4) AS north FROM pl"))
def _(s, d):
    e, n = geo.utm(F.col("lat"), F.col("lon"), 39.0)
    return _places(s, d).select("run", "seq", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"))


@register("p6_inverse_projection", over(PLACES, "SELECT run, seq, round(lat, 7) AS lat, round(lon, 7) AS lon FROM pl"))
def _(s, d):
    e, n = geo.utm(F.col("lat"), F.col("lon"), 39.0)
    x = _places(s, d).select("run", "seq", e.alias("e"), n.alias("n"))
    lat, lon = geo.utm_inverse(F.col("e"), F.col("n"), 39.0)
    return x.select("run", "seq", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


R = f"{geo.A!r} / sqrt(1 - {geo.E2!r} * sin(radians(lat)) * sin(radians(lat)))"
ECEF = f"ec AS (SELECT run, seq, ({R} + alt) * cos(radians(lat)) * cos(radians(lon)) AS x, ({R} + alt) * cos(radians(lat)) * sin(radians(lon)) AS y, ({R} * {1 - geo.E2!r} + alt) * sin(radians(lat)) AS z FROM pl)"


def _origin() -> tuple[float, float, float]:
    p, q = radians(55.2), radians(38.0)
    r = geo.A / sqrt(1 - geo.E2 * sin(p) ** 2)
    return (r + 100) * cos(p) * cos(q), (r + 100) * cos(p) * sin(q), (r * (1 - geo.E2) + 100) * sin(p)


def _enu_sql() -> str:
    x0, y0, z0 = _origin()
    sp, cp, sq, cq = sin(radians(55.2)), cos(radians(55.2)), sin(radians(38.0)), cos(radians(38.0))
    dx, dy, dz = f"(x - {x0!r})", f"(y - {y0!r})", f"(z - {z0!r})"
    e = f"{-sq!r} * {dx} + {cq!r} * {dy}"
    n = f"{-sp * cq!r} * {dx} + {-sp * sq!r} * {dy} + {cp!r} * {dz}"
    u = f"{cp * cq!r} * {dx} + {cp * sq!r} * {dy} + {sp!r} * {dz}"
    return f"round({e}, 3) AS e, round({n}, 3) AS n, round({u}, 3) AS u"


@register("p7_earth_and_local_frames", over(f"{PLACES}, {ECEF}", f"SELECT run, seq, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, {_enu_sql()} FROM ec"))
def _(s, d):
    lat, lon, alt = F.col("lat"), F.col("lon"), F.col("alt")
    xyz = zip("xyz", geo.ecef(lat, lon, alt), strict=True)
    enu = zip("enu", geo.local_enu(lat, lon, alt, 55.2, 38.0, 100.0), strict=True)
    return _places(s, d).select("run", "seq", *[F.round(c, 3).alias(n) for n, c in (*xyz, *enu)])


@register("p8_start_frame", over("b AS (SELECT run, seq, t, v AS x, v % 37 AS y, (v % 6) - 3 AS yaw FROM front), o AS (SELECT run, arg_min(x, (t, seq)) AS x0, arg_min(y, (t, seq)) AS y0, arg_min(yaw, (t, seq)) AS w FROM b GROUP BY run)", "SELECT run, seq, round(cos(w) * (x - x0) + sin(w) * (y - y0), 6) AS x, round(cos(w) * (y - y0) - sin(w) * (x - x0), 6) AS y FROM b JOIN o USING (run)"))
def _(s, d):
    b = front(s, d).select("run", "seq", "t", F.col("v").alias("x"), (F.col("v") % 37).alias("y"), ((F.col("v") % 6) - 3).alias("yaw"))
    o = b.groupBy("run").agg(F.min(F.struct("t", "seq", "x", "y", "yaw")).alias("o"))
    x, y, _ = geo.in_frame("start", F.col("x"), F.col("y"), F.lit(0.0), x0=F.col("o.x"), y0=F.col("o.y"), z0=F.lit(0.0), yaw0=F.col("o.yaw"))
    return b.join(o, "run").select("run", "seq", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@register("p9_quaternion_and_wrap", over("", "SELECT run, seq, round(sin(v / 2), 6) AS qz, round(cos(v / 2), 6) AS qw, round((v + pi()) % (2 * pi()) - pi(), 6) AS wrapped FROM front"))
def _(s, d):
    z, w = scalars.yaw_quaternion(F.col("v"))
    return front(s, d).select("run", "seq", F.round(z, 6).alias("qz"), F.round(w, 6).alias("qw"), F.round(scalars.wrap(F.col("v")), 6).alias("wrapped"))


@register("p10_covariance_rotation", over("c AS (SELECT run, seq, CASE WHEN seq % 9 = 0 THEN 1e6 ELSE greatest(v - 20, 0) END AS a, v / 10 AS b, v % 6 AS w FROM front)", "SELECT run, seq, round(a * cos(w) * cos(w) + b * sin(w) * sin(w), 4) AS xx, round((a - b) * cos(w) * sin(w), 4) AS xy, round(a * sin(w) * sin(w) + b * cos(w) * cos(w), 4) AS yy FROM c"))
def _(s, d):
    va = F.when(F.col("seq") % 9 == 0, float("nan")).otherwise(F.col("v") - 20)
    cov = scalars.rotated_covariance(va, F.col("v") / 10, F.col("v") % 6)
    return front(s, d).select("run", "seq", *[F.round(c, 4).alias(n) for n, c in zip(("xx", "xy", "yy"), cov, strict=True)])


NOTCH = "nt AS (SELECT run, seq, v / 10 AS v, (seq % 31 - 15)::INT AS n FROM cmd)"


def _notched(s, d):
    return cmd(s, d).select("run", "seq", (F.col("v") / 10).alias("v"), (F.col("seq") % 31 - 15).cast("int").alias("n"))


@register("p11_traction_curve", over(NOTCH, "SELECT run, seq, round(least(0.1 + 0.08 * n / (1 + greatest(v - 4, 0) / 6), 1.2 * pow(CASE WHEN v > 7 THEN 7 / v ELSE 1 END, 1.3)) - 0.05, 6) AS accel FROM nt WHERE n > 0"))
def _(s, d):
    a = scalars.traction(F.col("v"), F.col("n"), b0=0.1, a0=0.08, v1=4.0, va=6.0, top=1.2, vb=7.0, power=1.3, r0=0.05)
    return _notched(s, d).filter("n > 0").select("run", "seq", F.round(a, 6).alias("accel"))


@register("p12_brake_curve", over(NOTCH, "SELECT run, seq, round(CASE WHEN n = -8 THEN CASE WHEN v > 2.5 THEN 0 ELSE -0.85 END ELSE greatest(-(0.2 + 0.08 * abs(n)) * (1 - 0.3 * exp(-v / 2)), -1.2) - 0.05 END, 6) AS accel FROM nt WHERE n < 0"))
def _(s, d):
    a = scalars.braking(F.col("v"), F.col("n"), d0=0.2, d1=0.08, fade=0.3, vf=2.0, cap=-1.2, r0=0.05)
    return _notched(s, d).filter("n < 0").select("run", "seq", F.round(a, 6).alias("accel"))


@register("p13_mode_classification", over("nt AS (SELECT run, seq, greatest(v / 10 - 2, 0) AS v, CASE WHEN seq % 17 = 0 THEN NULL ELSE (seq % 31 - 15)::INT END AS n FROM cmd)", "SELECT run, seq, CASE WHEN n IS NULL THEN 'nocmd' WHEN v < 0.05 AND n <= 0 THEN 'standstill' WHEN n > 0 THEN 'traction' WHEN n = -8 THEN 'hold' WHEN n < 0 THEN 'brake' ELSE 'coast' END AS mode, CASE WHEN n IS NULL THEN 0.5 WHEN n <= -9 THEN 0.3 ELSE 0.15 END AS sigma FROM nt"))
def _(s, d):
    n = F.when(F.col("seq") % 17 == 0, F.lit(None)).otherwise(F.col("n"))
    v = F.greatest(F.col("v") - 2, F.lit(0.0))
    return _notched(s, d).select("run", "seq", scalars.drive_mode(n, v).alias("mode"), scalars.model_sigma(n).alias("sigma"))


@register("p15_run_selector", over("", "SELECT DISTINCT run FROM s WHERE (run % 3 = 1 AND run < 60) OR run % 10 = 9"))
def _(s, d):
    runs = log(s, d).select("run").distinct()
    known = {"group": lambda a: F.col("run") % 3 == int(a), "below": lambda a: F.col("run") < int(a), "last": lambda a: F.col("run") % 10 == int(a)}
    return select_runs(runs, "group:1&below:60,last:9", known)


@register("p17_output_validity", over("x AS (SELECT run, t, seq, CASE WHEN seq % 19 = 0 THEN NULL ELSE v - 5 END AS v FROM front), g AS (SELECT *, v - lag(v) OVER (PARTITION BY run ORDER BY t, seq) AS dv FROM x)", "SELECT run, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS not_finite, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END)::BIGINT AS negative, round(max(abs(dv)), 6) AS largest_step, round((count(*) - 1) / ((max(t) - min(t)) / 1e9), 6) AS rate FROM g GROUP BY run HAVING count(*) > 1"))
def _(s, d):
    x = front(s, d).withColumn("v", scalars.finite(F.when(F.col("seq") % 19 == 0, float("nan")).otherwise(F.col("v") - 5)))
    g = x.withColumn("dv", F.col("v") - F.lag("v").over(line())).groupBy("run").agg(
        F.count_if(F.col("v").isNull()).alias("not_finite"), F.count_if(F.col("v") < 0).alias("negative"), F.round(F.max(F.abs("dv")), 6).alias("largest_step"),
        F.round((F.count(F.lit(1)) - 1) / ((F.max("t") - F.min("t")) / 1e9), 6).alias("rate"), F.count(F.lit(1)).alias("n"),
    )
    return g.filter("n > 1").drop("n")


@register("p18_basis_functions", over("u AS (SELECT run, seq, v, greatest(0.0, least(1.0, v / 100)) AS u, floor(v / 25) AS k FROM front)", "SELECT run, seq, round(u * u * (3 - 2 * u), 6) AS smooth, k::BIGINT AS node, round(1 - (v / 25 - k), 6) AS weight, round((sin(0.3 + 0.01 * v) - sin(0.3)) / 0.01, 6) AS ax FROM u"))
def _(s, d):
    hats = scalars.hat_weights(F.col("v"), 25.0)
    ax, _ = scalars.arc_point(F.col("v"), F.lit(0.3), F.lit(0.01))
    return front(s, d).select("run", "seq", F.round(scalars.smoothstep(F.col("v") / 100), 6).alias("smooth"), hats[0]["node"].alias("node"), F.round(hats[0]["weight"], 6).alias("weight"), F.round(ax, 6).alias("ax"))


@register("p19_clean_sample_mask", over("n AS (SELECT run, seq, v, row_number() OVER (PARTITION BY run ORDER BY t, seq) AS i FROM s WHERE abs(v - 40) < 30)", "SELECT run, seq FROM n WHERE i % 2 = 1"))
def _(s, d):
    return log(s, d).filter(F.abs(F.col("v") - 40) < 30).withColumn("i", F.row_number().over(line())).filter("i % 2 = 1").select("run", "seq")


@register("p20_slip_and_adhesion", over("a AS (SELECT run, avg(CASE WHEN stream = 'view' THEN v END) AS f, avg(CASE WHEN stream = 'click' THEN v END) AS r, avg(v) AS v FROM s GROUP BY run)", "SELECT run, round((f - v) / greatest(v, 1), 6) AS slip_front, round((r - v) / greatest(v, 1), 6) AS slip_rear, round((f - r) / greatest(v, 1), 6) AS slip_between, round(abs(f - r) / 9.81, 6) AS adhesion FROM a"))
def _(s, d):
    a = log(s, d).groupBy("run").agg(F.avg(F.when(F.col("stream") == "view", F.col("v"))).alias("f"), F.avg(F.when(F.col("stream") == "click", F.col("v"))).alias("r"), F.avg("v").alias("v"))
    ratios = scalars.slip_ratio(F.col("f"), F.col("r"), F.col("v"))
    return a.select("run", *[F.round(c, 6).alias(n) for n, c in zip(("slip_front", "slip_rear", "slip_between"), ratios, strict=True)], F.round(scalars.adhesion(F.col("f") - F.col("r")), 6).alias("adhesion"))


@register("p21_heading_agreement", over("", "SELECT run, seq, cos(v - run) > cos(radians(60)) AS agree FROM front"))
def _(s, d):
    return front(s, d).select("run", "seq", scalars.headings_agree(F.col("v"), F.col("run").cast("double")).alias("agree"))


# --- geometry -------------------------------------------------------------------------------

ARC = "pt AS (SELECT run, seq, t, v AS x, v % 37 AS y FROM front), ar AS (SELECT run, seq, t, x, y, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)) OVER (PARTITION BY run ORDER BY t, seq) AS arc FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pt WINDOW w AS (PARTITION BY run ORDER BY t, seq)))"


def _arc(s, d):
    p = front(s, d).select("run", "seq", "t", F.col("v").alias("x"), (F.col("v") % 37).alias("y"))
    dx, dy = F.col("x") - F.lag("x").over(line()), F.col("y") - F.lag("y").over(line())
    return p.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).select("run", "seq", "x", F.sum("step").over(so_far(line())).alias("arc"))


def _resampled(arc, ways):
    """``x`` at the ways of each run, an aggregate over its rows."""
    from sensorloom.operators import timeops

    grid = arc.groupBy("run").agg(ways.alias("ways")).select("run", F.explode("ways").alias("arc"))
    out = timeops.interpolate(grid, arc, value="x", t="arc", out="x")
    return out.select("run", F.col("arc").alias("way"), *r6("x"))


@register("g1_arc_length_and_resampling", over(ARC + ", tot AS (SELECT run, max(arc) AS len FROM ar GROUP BY run), q AS (SELECT run, 50.0::DOUBLE * unnest(range(0, floor(len / 50)::BIGINT + 1)) AS arc FROM tot UNION SELECT run, len FROM tot), lo AS (SELECT q.run, q.arc AS way, a.arc AS s0, a.x AS x0 FROM q ASOF LEFT JOIN ar a ON q.run = a.run AND q.arc >= a.arc), hi AS (SELECT q.run, q.arc AS way, a.arc AS s1, a.x AS x1 FROM q ASOF LEFT JOIN ar a ON q.run = a.run AND q.arc < a.arc)", "SELECT run, way, round(CASE WHEN s1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (way - s0) / (s1 - s0) END, 6) AS x FROM lo JOIN hi USING (run, way)"))
def _(s, d):
    total = F.max("arc")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(total / 50)), lambda k: k * 50.0)
    return _resampled(_arc(s, d), F.array_union(steps, F.array(total)))  # up to each run's own end


@register("g2_heading_profile", over("pt AS (SELECT run, seq, t, v AS x, v % 37 AS y FROM front), h AS (SELECT run, seq, t, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS yaw FROM pt WINDOW w AS (PARTITION BY run ORDER BY t, seq))", "SELECT run, seq, round(yaw, 6) AS yaw, round(yaw - lag(yaw) OVER (PARTITION BY run ORDER BY t, seq), 6) AS turn FROM h"))
def _(s, d):
    p = front(s, d).select("run", "seq", "t", F.col("v").alias("x"), (F.col("v") % 37).alias("y"))
    h = p.withColumn("yaw", F.atan2(F.lead("y").over(line()) - F.col("y"), F.lead("x").over(line()) - F.col("x")))
    return h.select("run", "seq", F.round("yaw", 6).alias("yaw"), F.round(F.col("yaw") - F.lag("yaw").over(line()), 6).alias("turn"))


@register("g3_pose_lookup", over(_segments_sql() + ", tot AS (SELECT max(arc + n) AS len FROM g), q AS (SELECT run, seq, least(greatest(v / 100 - 0.1, 0), len) AS q_at FROM front, tot)", "SELECT run, seq, round(arg_max(gx + (q_at - arc) * ux, arc), 6) AS px, round(arg_max(gy + (q_at - arc) * uy, arc), 6) AS py FROM q JOIN g ON arc <= q_at GROUP BY run, seq"))
def _(s, d):
    return geometry.pose_at(front(s, d).withColumn("s", F.col("v") / 100 - 0.1), LINE).select("run", "seq", *r6("px", "py"))


@register("g4_hermite_bridge", over("u AS (SELECT run, seq, (v % 100) / 100 AS u FROM front)", "SELECT run, seq, round((2 * u * u * u - 3 * u * u + 1) * 1.5 + (u * u * u - 2 * u * u + u) * 2.0 + (3 * u * u - 2 * u * u * u) * 4.0 + (u * u * u - u * u) * -1.0, 6) AS x FROM u"))
def _(s, d):
    return front(s, d).select("run", "seq", F.round(geometry.hermite((F.col("v") % 100) / 100, 1.5, 2.0, 4.0, -1.0), 6).alias("x"))


@register("g5_tail_extrapolation", over("e AS (SELECT run, max(v) AS v FROM front GROUP BY run), k AS (SELECT run, v, i, 0.02 * exp(-i / 5.0) AS c FROM e CROSS JOIN generate_series(1, 10) g(i)), y AS (SELECT run, v, i, sum(c) OVER (PARTITION BY run ORDER BY i) AS yaw FROM k)", "SELECT run, i, round(v + sum(cos(yaw)) OVER (PARTITION BY run ORDER BY i), 6) AS x, round(sum(sin(yaw)) OVER (PARTITION BY run ORDER BY i), 6) AS y FROM y"))
def _(s, d):
    tail = Window.partitionBy("run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    k = front(s, d).groupBy("run").agg(F.max("v").alias("v")).select("run", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("i"))
    y = k.withColumn("yaw", F.sum(0.02 * F.exp(-F.col("i") / 5.0)).over(tail))
    return y.select("run", "i", F.round(F.col("v") + F.sum(F.cos("yaw")).over(tail), 6).alias("x"), F.round(F.sum(F.sin("yaw")).over(tail), 6).alias("y"))


# --- faults ---------------------------------------------------------------------------------

SINCE = "q AS (SELECT *, t - min(t) OVER (PARTITION BY run) AS since FROM s)"
T0, DUR = 5 * DAY, 10 * DAY
IN = f"since >= {T0} AND since < {T0 + DUR}"


@register("f1_drop", over(SINCE, f"SELECT run, seq FROM q WHERE NOT (stream = 'view' AND {IN})"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("drop", ("view",), T0, DUR)).select("run", "seq")


@register("f2_zero", over(SINCE, f"SELECT run, seq, CASE WHEN stream IN ('view', 'click') AND {IN} THEN 0.0 ELSE v END AS v FROM q"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("zero", ("view", "click"), T0, DUR)).select("run", "seq", "v")


@register("f3_freeze", over(SINCE + f", h AS (SELECT run, stream, arg_max(v, (t, seq)) FILTER (WHERE since < {T0}) AS held, arg_min(v, (t, seq)) AS first FROM q GROUP BY run, stream)", f"SELECT run, seq, CASE WHEN stream = 'view' AND {IN} THEN coalesce(held, first) ELSE v END AS v FROM q JOIN h USING (run, stream)"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("freeze", ("view",), T0, DUR)).select("run", "seq", "v")


@register("f4_not_a_number", over(SINCE, f"SELECT run, seq, CASE WHEN stream = 'view' AND {IN} THEN NULL ELSE v END AS v FROM q"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("nan", ("view",), T0, DUR)).select("run", "seq", "v")


@register("f5_spikes")
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("spikes", ("view",), T0, DUR, amp=50.0, rate=0.2)).select("run", "seq", "v")


@register("f6_noise")
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("noise_moving", ("view",), T0, DUR, amp=5.0)).select("run", "seq", "v")


@register("f7_scale_and_slip", over(SINCE, f"SELECT run, seq, round(CASE WHEN stream = 'view' AND {IN} THEN v * (1 + 0.3 * least(1.0, (since - {T0}) / {DAY}.0)) ELSE v END, 6) AS v FROM q"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("slip", ("view",), T0, DUR, amp=0.3, ramp=DAY)).select("run", "seq", *r6("v"))


@register("f8_stamp_jump", over(SINCE, f"SELECT run, seq, CASE WHEN {IN} THEN t + {HOUR} ELSE t END AS t FROM q"))
def _(s, d):
    return faults.inject(log(s, d), faults.Fault("stamp_jump", (), T0, DUR, jump=HOUR)).select("run", "seq", "t")


