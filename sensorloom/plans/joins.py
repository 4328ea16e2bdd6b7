"""Queries over joins, set operations and ordering."""

from __future__ import annotations

from math import cos, sin

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import geometry, timeops
from sensorloom.plans.registry import HOUR, cmd, fix, front, log, other, over, r6, read, rear, register

TOL = 6 * HOUR


def near(left: str, right: str, tol: int, strict: bool = False) -> str:
    """SQL of the nearest row of ``right``: CTE ``near`` (run, seq, t, v, r_t, r_v)."""
    op = "<" if strict else "<="
    return f"""
    nb AS (SELECT a.run, a.seq, a.t, a.v, b.t AS bt, b.v AS bv FROM {left} a ASOF LEFT JOIN {right} b ON a.run = b.run AND a.t >= b.t),
    nn AS (SELECT a.seq, b.t AS nt, b.v AS nv FROM {left} a ASOF LEFT JOIN {right} b ON a.run = b.run AND a.t < b.t),
    np AS (SELECT nb.run, nb.seq, nb.t, nb.v, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END AS r_t,
                  CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bv ELSE nv END AS r_v FROM nb JOIN nn USING (seq)),
    near AS (SELECT run, seq, t, v, CASE WHEN abs(r_t - t) {op} {tol} THEN r_t END AS r_t, CASE WHEN abs(r_t - t) {op} {tol} THEN r_v END AS r_v FROM np)"""


@register("j1_nearest_within_tolerance", over(near("front", "rear", TOL), "SELECT run, seq, r_t, r_v FROM near"))
def _(s, d):
    return timeops.nearest(front(s, d), rear(s, d), tol=TOL).select("run", "seq", "r_t", "r_v")


@register("j2_gate_by_neighbour", over(near("front", "fix", TOL, strict=True), "SELECT run, seq, t, v FROM near WHERE r_v > 20"))
def _(s, d):
    return timeops.nearest(front(s, d), fix(s, d), tol=TOL, strict=True).filter("r_v > 20").select("run", "seq", "t", "v")


BACK = "hold AS (SELECT a.run, a.seq, a.t, a.v, b.t AS r_t, b.v AS r_v FROM front a ASOF LEFT JOIN cmd b ON a.run = b.run AND a.t >= b.t)"


@register("j3_zero_order_hold", over(BACK, "SELECT run, seq, r_t, r_v FROM hold"))
def _(s, d):
    return timeops.asof(front(s, d), cmd(s, d)).select("run", "seq", "r_t", "r_v")


@register("j4_hold_with_dead_time", over(f"p AS (SELECT run, seq, t - {2 * HOUR} AS t FROM front)", "SELECT a.run, a.seq, b.v AS r_v FROM p a ASOF LEFT JOIN cmd b ON a.run = b.run AND a.t >= b.t"))
def _(s, d):
    return timeops.asof(front(s, d), cmd(s, d), shift=2 * HOUR).select("run", "seq", "r_v")


@register("j5_hold_with_staleness", over(BACK, f"SELECT run, seq, CASE WHEN t - r_t <= {TOL} THEN r_v END AS kept, CASE WHEN t - r_t < {TOL} THEN r_v END AS kept_strict FROM hold"))
def _(s, d):
    a = timeops.asof(front(s, d), cmd(s, d), stale=TOL).select("run", "seq", "t", "v", F.col("r_v").alias("kept"))
    return timeops.asof(a, cmd(s, d), stale=TOL, strict=True).select("run", "seq", "kept", F.col("r_v").alias("kept_strict"))


BRACKET = """
    br AS (SELECT a.run, a.seq, a.t, b.t AS t0, b.v AS v0 FROM front a ASOF LEFT JOIN rear b ON a.run = b.run AND a.t >= b.t),
    ba AS (SELECT a.seq, b.t AS t1, b.v AS v1 FROM front a ASOF LEFT JOIN rear b ON a.run = b.run AND a.t < b.t),
    bb AS (SELECT run, seq, t, t0, v0, t1, v1 FROM br JOIN ba USING (seq)),
    lin AS (SELECT *, CASE WHEN t0 = t THEN v0 WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS x FROM bb)"""


@register("j6_linear_interpolation", over(BRACKET, "SELECT run, seq, round(x, 6) AS interp FROM lin"))
def _(s, d):
    return timeops.interpolate(front(s, d), rear(s, d)).select("run", "seq", *r6("interp"))


@register("j7_gap_limited_interpolation", over(BRACKET, f"SELECT run, seq, round(CASE WHEN (t0 = t OR t1 - t0 <= {30 * HOUR}) AND least(t - t0, t1 - t) <= {TOL} AND t0 IS NOT NULL AND t1 IS NOT NULL THEN x END, 6) AS interp FROM lin"))
def _(s, d):
    return timeops.interpolate(front(s, d), rear(s, d), clamp=False, max_gap=TOL, bracket=30 * HOUR, half_open=True).select("run", "seq", *r6("interp"))


STAMPS = f"l AS (SELECT run, t // {HOUR} AS stamp, count(*) AS n FROM front GROUP BY ALL), r AS (SELECT run, t // {HOUR} AS stamp, count(*) AS n FROM rear GROUP BY ALL)"


@register("j9_exact_stamp_join", over(STAMPS, "SELECT l.run, sum(CASE WHEN r.n IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS matched, sum(CASE WHEN r.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS unmatched, sum(l.n - 1)::BIGINT AS duplicates FROM l LEFT JOIN r USING (run, stamp) GROUP BY l.run"))
def _(s, d):
    stamps = lambda df: df.withColumn("stamp", F.floor(F.col("t") / F.lit(HOUR))).groupBy("run", "stamp").agg(F.count(F.lit(1)).alias("n"))
    both = stamps(front(s, d)).join(stamps(rear(s, d)).withColumnRenamed("n", "m"), ["run", "stamp"], "left")
    return both.groupBy("run").agg(F.count("m").alias("matched"), F.count_if(F.col("m").isNull()).alias("unmatched"), F.sum(F.col("n") - 1).alias("duplicates"))


@register("j10_membership_share", over("", f"SELECT run, round(avg(CASE WHEN EXISTS (SELECT 1 FROM rear r WHERE r.run = front.run AND r.t // {HOUR} = front.t // {HOUR}) THEN 1.0 ELSE 0.0 END), 6) AS share FROM front GROUP BY run"))
def _(s, d):
    hours = lambda df: df.withColumn("h", F.floor(F.col("t") / F.lit(HOUR)))
    known = hours(rear(s, d)).select("run", "h").distinct().withColumn("in_it", F.lit(1.0))
    return hours(front(s, d)).join(known, ["run", "h"], "left").groupBy("run").agg(F.round(F.avg(F.coalesce("in_it", F.lit(0.0))), 6).alias("share"))


@register("j11_approximate_time_pairs")
def _(s, d):
    return timeops.synchronise(log(s, d), first="view", second="click", slop=TOL)


PAIRED = "CASE WHEN abs(abs(v - r_v) - 12.44) <= 2.5 THEN 0 WHEN abs(abs(v - r_v) - 12.44) <= 10 THEN 1 ELSE 2 END"


@register("j12_ranked_pair_join", over(near("fix", "other", 12 * HOUR), f"SELECT run, min({PAIRED}) AS best_class, count(*) AS pairs FROM near WHERE r_t IS NOT NULL GROUP BY run"))
def _(s, d):
    off = F.abs(F.abs(F.col("v") - F.col("r_v")) - 12.44)
    rank = F.when(off <= 2.5, 0).when(off <= 10, 1).otherwise(2)
    return timeops.nearest(fix(s, d), other(s, d), tol=12 * HOUR).filter("r_t is not null").groupBy("run").agg(F.min(rank).alias("best_class"), F.count(F.lit(1)).alias("pairs"))


@register("j13_midpoint_join", over(near("fix", "other", TOL), "SELECT run, seq, round((v + r_v) / 2, 6) AS mid FROM near WHERE r_t IS NOT NULL AND v > 5 AND r_v > 5"))
def _(s, d):
    pairs = timeops.nearest(fix(s, d), other(s, d), tol=TOL).filter("r_t is not null and v > 5 and r_v > 5")
    return pairs.select("run", "seq", F.round((F.col("v") + F.col("r_v")) / 2, 6).alias("mid"))


@register("j14_ordered_merge", over("m AS (SELECT run, t, seq, 0 AS rank FROM cmd UNION ALL SELECT run, t, seq, 1 FROM front UNION ALL SELECT run, t, seq, 2 FROM rear)", "SELECT run, seq, rank, row_number() OVER (PARTITION BY run ORDER BY t, rank, seq) AS place FROM m"))
def _(s, d):
    m = timeops.merge_streams([(0, cmd(s, d)), (1, front(s, d)), (2, rear(s, d))], ["run", "t", "seq"])
    return m.select("run", "seq", "rank", F.row_number().over(Window.partitionBy("run").orderBy("t", "rank", "seq")).cast("long").alias("place"))


POINTS = "p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _points(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@register("j15_nearest_point", f"WITH {POINTS}, n AS (SELECT a.id, b.id AS point, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM p a, p b WHERE b.label = 0 AND a.label <> 0) SELECT id AS row, arg_min(point, (dist, point)) AS point, round(min(dist), 6) AS dist FROM n GROUP BY id")
def _(s, d):
    p = _points(s, d)  # those of label 0 are the map
    return geometry.nearest_point(p.filter("label <> 0").withColumnRenamed("id", "row"), p.filter("label = 0").withColumnRenamed("id", "point"), cell=0.05).select("row", "point", *r6("dist"))


LINE = [(-0.4, -0.3), (-0.1, -0.05), (0.05, 0.0), (0.2, 0.25), (0.5, 0.3)]


#: A line that crosses the prolongation of its own end: points near there belong to its last segment.
HOOK = [(-0.2, 0.0), (0.2, 0.0), (0.2, 0.3), (-0.35, 0.3), (-0.35, -0.4)]

#: A line of more segments than an array constant holds: it is searched by blocks.
SPIRAL = [(round(0.002 * k * cos(k / 20), 6), round(0.002 * k * sin(k / 20), 6)) for k in range(301)]


def _segments_sql(points=LINE) -> str:
    rows = ", ".join(f"({i}, {x!r}, {y!r}, {ux!r}, {uy!r}, {n!r}, {arc!r})" for i, x, y, ux, uy, n, arc in geometry.segments_of(points))
    return f"g(i, gx, gy, ux, uy, n, arc) AS (VALUES {rows})"


def _feet_sql(where: str = "TRUE", points=LINE) -> str:
    """Each point with each segment: way along the segment's line, distance to the segment, side."""
    return f"""{POINTS}, {_segments_sql(points)},
    al AS (SELECT id, x, y, g.*, (x - gx) * ux + (y - gy) * uy AS w FROM p, g WHERE {where}),
    u AS (SELECT *, CASE WHEN w < 0 THEN 0.0 WHEN w > n THEN n ELSE w END AS u FROM al),
    f AS (SELECT id, x, y, i, n, w, arc, arc + u AS s, round(sqrt((x - gx - u * ux) ** 2 + (y - gy - u * uy) ** 2), 9) AS dist, (y - gy) * ux - (x - gx) * uy AS side FROM u)"""


FOOT = "SELECT id, arg_min(i, (dist, i)) AS segment, round(arg_min(s, (dist, i)), 6) AS s, round(min(dist), 6) AS dist, round(arg_min(side, (dist, i)), 6) AS side FROM f GROUP BY id"


def _open_ends_sql(points) -> str:
    """The nearest segment is chosen first, by row number; only its foot may then leave the line."""
    last = len(points) - 2
    return f"""WITH {_feet_sql(points=points)}, b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, i) = 1),
    o AS (SELECT *, (i = 0 AND w < 0) OR (i = {last} AND w > n) AS off FROM b)
    SELECT id, i AS segment, round(CASE WHEN off THEN arc + w ELSE s END, 6) AS s, round(CASE WHEN off THEN abs(side) ELSE dist END, 6) AS dist, round(side, 6) AS side, off AS beyond FROM o"""


def _feet(df, *more):
    return df.select("id", F.col("foot.i").alias("segment"), F.round("foot.s", 6).alias("s"), F.round("foot.dist", 6).alias("dist"), F.round("foot.lateral", 6).alias("side"), *more)


def _open_feet(df):
    return _feet(df, "beyond")


@register("j16_polyline_projection", _open_ends_sql(LINE))
def _(s, d):
    return _open_feet(geometry.project(_points(s, d), LINE))


@register("j16_self_crossing_line", _open_ends_sql(HOOK))
def _(s, d):
    return _open_feet(geometry.project(_points(s, d), HOOK))


@register("j16_long_line", _open_ends_sql(SPIRAL))
def _(s, d):
    return _open_feet(geometry.project(_points(s, d), SPIRAL))


VERTICES = "w(k, wx, wy) AS (VALUES " + ", ".join(f"({k}, {x!r}, {y!r})" for k, (x, y) in enumerate(LINE)) + ")"


@register("j17_projection_at_nearest_vertex", f"WITH {_feet_sql()}, {VERTICES}, nv AS (SELECT id, arg_min(k, (round((x - wx) * (x - wx) + (y - wy) * (y - wy), 9), k)) AS k FROM p, w GROUP BY id) SELECT id, arg_min(i, (dist, i)) AS segment, round(arg_min(s, (dist, i)), 6) AS s, round(min(dist), 6) AS dist, round(arg_min(side, (dist, i)), 6) AS side FROM f JOIN nv USING (id) WHERE i = k OR i = k - 1 GROUP BY id")
def _(s, d):
    return _feet(geometry.project_by_vertex(_points(s, d), LINE))


@register("j18_windowed_projection", f"WITH {_feet_sql('arc <= 0.3 + x AND arc + n >= 0.1 + x')} {FOOT}")
def _(s, d):
    return _feet(geometry.project(_points(s, d), LINE, beyond=False, lo=0.1 + F.col("x"), hi=0.3 + F.col("x"))).filter("segment is not null")


@register("j20_paired_run_comparison", over("a AS (SELECT run, avg(v) AS m FROM front GROUP BY run), b AS (SELECT run, avg(v) AS m FROM rear GROUP BY run)", "SELECT count(*) AS n, round(median(b.m - a.m), 6) AS median_change, sum(CASE WHEN b.m < a.m THEN 1 ELSE 0 END)::BIGINT AS lower FROM a JOIN b USING (run)"))
def _(s, d):
    mean = lambda df, n: df.groupBy("run").agg(F.avg("v").alias(n))
    return mean(front(s, d), "a").join(mean(rear(s, d), "b"), "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("b") - F.col("a")), 6).alias("median_change"), F.count_if(F.col("b") < F.col("a")).alias("lower"))


@register("j21_lookup_of_clean_value", over("faulty AS (SELECT run, seq, t + 600000000 AS t, v * 1.3 AS v FROM front)," + near("faulty", "front", HOUR), "SELECT run, seq, round(v - r_v, 6) AS change FROM near"))
def _(s, d):
    clean = front(s, d)
    faulty = clean.select("run", "seq", (F.col("t") + 600_000_000).alias("t"), (F.col("v") * 1.3).alias("v"))
    return timeops.nearest(faulty, clean, tol=HOUR).select("run", "seq", F.round(F.col("v") - F.col("r_v"), 6).alias("change"))


FOLDS = [(0, 0.98), (1, 1.0), (2, 1.03)]


@register("j22_fold_parameters", over("p(fold, k) AS (VALUES (0, 0.98), (1, 1.0), (2, 1.03))", "SELECT run, seq, round(v * coalesce(k, 1.0), 6) AS scaled FROM front LEFT JOIN p ON run % 4 = fold"))
def _(s, d):
    params = s.createDataFrame(FOLDS, "fold long, k double")
    return front(s, d).withColumn("fold", F.col("run") % 4).join(F.broadcast(params), "fold", "left").select("run", "seq", F.round(F.col("v") * F.coalesce("k", F.lit(1.0)), 6).alias("scaled"))


EXTRA = f"""
    pr AS (SELECT run, seq, t, v, lag(t) OVER w AS t1, lag(v) OVER w AS v1 FROM rear WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
    h AS (SELECT a.run, a.seq, a.t, a.v AS own, b.t AS bt, b.v AS bv, b.t1, b.v1 FROM front a ASOF LEFT JOIN pr b ON a.run = b.run AND a.t >= b.t),
    ex AS (SELECT *, CASE WHEN t - bt <= {TOL} THEN greatest(bv + CASE WHEN bt - t1 >= {HOUR} THEN (bv - v1) / (bt - t1) ELSE 0.0 END * least(t - bt, {HOUR}), 0.0) END AS x FROM h)"""


@register("j23_extrapolating_hold", over(EXTRA, "SELECT run, seq, round(x, 6) AS extrap FROM ex"))
def _(s, d):
    return timeops.extrapolating_asof(front(s, d), rear(s, d), stale=TOL, horizon=HOUR, least_span=HOUR).select("run", "seq", *r6("extrap"))


@register("j24_cross_sensor_alignment", over(BRACKET + ", newest AS (SELECT run, seq, t, v FROM front), j AS (SELECT n.run, n.seq, n.v, lin.x, lead(n.v) OVER (PARTITION BY n.run ORDER BY n.t, n.seq) AS nv, lead(lin.x) OVER (PARTITION BY n.run ORDER BY n.t, n.seq) AS nx FROM newest n JOIN lin USING (run, seq))", "SELECT run, seq, round(v + nx - x, 6) AS aligned FROM j"))
def _(s, d):
    w = Window.partitionBy("run").orderBy("t", "seq")
    x = timeops.interpolate(front(s, d), rear(s, d))
    return x.select("run", "seq", F.round(F.col("v") + F.lead("interp").over(w) - F.col("interp"), 6).alias("aligned"))


INVERSE = """
    od AS (SELECT run, seq, t, sum(v) OVER (PARTITION BY run ORDER BY t, seq) AS way FROM rear),
    q AS (SELECT run, 100.0::DOUBLE * unnest(range(1, floor(max(way) / 100)::BIGINT + 1)) AS way FROM od GROUP BY run),
    lo AS (SELECT q.run, q.way, o.t AS t0, o.way AS w0 FROM q ASOF LEFT JOIN od o ON q.run = o.run AND q.way >= o.way),
    hi AS (SELECT q.run, q.way, o.t AS t1, o.way AS w1 FROM q ASOF LEFT JOIN od o ON q.run = o.run AND q.way < o.way)"""


def _odometer(s, d):
    w = Window.partitionBy("run").orderBy("t", "seq")
    return rear(s, d).select("run", "seq", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("way"), F.col("t").alias("at"))


def _reached(od, ways):
    """When each run's ways, an aggregate over its rows, are reached; rows without a run reach none.

    A way that several rows show counts once, at the last of them, on both sides of what is looked up.
    The SQL leaves open which of them it takes, and not even its own reruns agree; it takes the last most often.
    """
    od = od.filter("run is not null")
    q = od.groupBy("run").agg(ways.alias("ways")).select("run", F.explode("ways").alias("way"))
    found = timeops.interpolate(q, timeops.last_per_key(od, ["run", "way"], "at"), value="at", t="way")
    return found.select("run", "way", F.floor(F.col("interp") / 1e6).cast("long").alias("reached_s"))


@register("j25_inverse_interpolation", over(INVERSE, "SELECT run, way, floor(CASE WHEN t0 IS NULL THEN t1 WHEN t1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * (way - w0) / (w1 - w0) END / 1000000)::BIGINT AS reached_s FROM lo JOIN hi USING (run, way)"))
def _(s, d):
    steps = F.sequence(F.lit(0).cast("long"), F.floor(F.max("way") / 100))
    return _reached(_odometer(s, d), F.filter(F.transform(steps, lambda k: k * 100.0), lambda way: way > 0))


@register("o1_stable_order", over("", "SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY t // 86400000000, seq) AS place FROM s"))
def _(s, d):
    w = Window.partitionBy("run").orderBy(F.floor(F.col("t") / F.lit(86_400_000_000)), "seq")
    return log(s, d).select("run", "seq", F.row_number().over(w).cast("long").alias("place"))


@register("o2_many_keys_order", over("", "SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY stream, v DESC, seq) AS place FROM s"))
def _(s, d):
    return log(s, d).select("run", "seq", F.row_number().over(Window.partitionBy("run").orderBy("stream", F.desc("v"), "seq")).cast("long").alias("place"))


@register("o4_extreme_rows", over("", "SELECT run, arg_min(seq, (v, seq)) AS least_at, arg_max(seq, (v, -seq)) AS most_at FROM s GROUP BY run"))
def _(s, d):
    return log(s, d).groupBy("run").agg(F.min_by("seq", F.struct("v", "seq")).alias("least_at"), F.max_by("seq", F.struct(F.col("v"), -F.col("seq"))).alias("most_at"))


@register("o5_first_qualifying", over("", "SELECT run, min(t) AS first_over FROM s WHERE v > 100 GROUP BY run"))
def _(s, d):
    return log(s, d).filter("v > 100").groupBy("run").agg(F.min("t").alias("first_over"))


@register("o7_every_kth", over("n AS (SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY t, seq) - 1 AS i FROM s)", "SELECT run, seq FROM n WHERE i % 5 = 0"))
def _(s, d):
    return log(s, d).withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("t", "seq")) - 1).filter("i % 5 = 0").select("run", "seq")


HOURS = {c: f"(SELECT run, t // {HOUR} AS h FROM {c})" for c in ("front", "rear")}


def _hours(df):
    return df.select("run", F.floor(F.col("t") / F.lit(HOUR)).alias("h"))


@register("x1_concatenation", over("", f"SELECT run, count(*) AS n, sum(h)::BIGINT AS h FROM ({HOURS['front']} UNION ALL {HOURS['rear']}) GROUP BY run"))
def _(s, d):
    return _hours(front(s, d)).unionByName(_hours(rear(s, d))).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))


@register("x2_distinct_union", over("", f"SELECT run, h FROM ({HOURS['front']} UNION {HOURS['rear']})"))
def _(s, d):
    return _hours(front(s, d)).union(_hours(rear(s, d))).distinct()


@register("x3_intersection", over("", f"SELECT run, h FROM ({HOURS['front']} INTERSECT {HOURS['rear']})"))
def _(s, d):
    return _hours(front(s, d)).intersect(_hours(rear(s, d)))


@register("x4_difference", over("", f"SELECT run, h, 'left' AS only_in FROM ({HOURS['front']} EXCEPT {HOURS['rear']}) UNION ALL SELECT run, h, 'right' FROM ({HOURS['rear']} EXCEPT {HOURS['front']})"))
def _(s, d):
    a, b = _hours(front(s, d)), _hours(rear(s, d))
    return a.subtract(b).withColumn("only_in", F.lit("left")).union(b.subtract(a).withColumn("only_in", F.lit("right")))


@register("x5_common_keys", over("", "SELECT DISTINCT run FROM front WHERE run IN (SELECT run FROM rear WHERE v > 150)"))
def _(s, d):
    return front(s, d).select("run").distinct().join(rear(s, d).filter("v > 150").select("run").distinct(), "run")
