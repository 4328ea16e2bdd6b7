"""Queries over error metrics, robust statistics, roll-ups and experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import aggregates as agg
from sensorloom.operators import episodes, timeops
from sensorloom.operators.windows import line
from sensorloom.plans.joins import near
from sensorloom.plans.registry import HOUR, front, log, over, r6, read, rear, register
from sensorloom.plans.windows import FLAGSHIP, ISLANDS, REGIME_SQL, with_regime

DAY = 24 * HOUR
TOL = 6 * HOUR
E = "e AS (SELECT run, seq, t, r_t, r_v - v AS e, v FROM near)"
NEAR = near("front", "rear", TOL)


def _errors(s, d):
    return timeops.nearest(front(s, d), rear(s, d), tol=TOL).withColumn("e", F.col("r_v") - F.col("v"))


def rounded(df, *keys):
    return df.select(*keys, *[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


STATS = "count(e) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.99), 6) AS p99, round(max(abs(e)), 6) AS max"


@register("a1_error_statistics", over(f"{NEAR}, {E}", f"SELECT run, {STATS} FROM e GROUP BY run"))
def _(s, d):
    return rounded(_errors(s, d).groupBy("run").agg(*agg.error_stats(F.col("e"))), "run")


@register("a2_statistics_by_regime", over(f"{NEAR}, {REGIME_SQL}, {FLAGSHIP}, g AS (SELECT run, regime, avg(e) AS b FROM matched GROUP BY run, regime)", "SELECT run, round(max(CASE WHEN regime = 'accel' THEN b END), 6) AS bias_accel, round(max(CASE WHEN regime = 'brake' THEN b END), 6) AS bias_brake, round(max(CASE WHEN regime = 'stopped' THEN b END), 6) AS bias_stopped, round(max(abs(b)), 6) AS worst FROM g WHERE regime <> 'cruise' GROUP BY run"))
def _(s, d):
    x = timeops.nearest(with_regime(front(s, d)), rear(s, d), tol=TOL).filter("regime <> 'cruise'")
    g = x.groupBy("run").pivot("regime", ["accel", "brake", "stopped"]).agg(F.avg(F.col("r_v") - F.col("v")))
    worst = F.greatest(F.abs("accel"), F.abs("brake"), F.abs("stopped"))
    return g.select("run", *[F.round(c, 6).alias(f"bias_{c}") for c in ("accel", "brake", "stopped")], F.round(worst, 6).alias("worst"))


@register("a3_coverage", over(NEAR, "SELECT run, round(avg(CASE WHEN r_t IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM near GROUP BY run"))
def _(s, d):
    return _errors(s, d).groupBy("run").agg(F.round(F.avg(F.col("r_t").isNotNull().cast("double")), 6).alias("coverage"))


PLANE = "pl AS (SELECT run, seq, e AS ex, e % 7 AS ey, v / 50 AS ez FROM e WHERE e IS NOT NULL)"


def _plane(s, d):
    return _errors(s, d).filter("e is not null").select("run", "seq", F.col("e").alias("ex"), (F.col("e") % 7).alias("ey"), (F.col("v") / 50).alias("ez"))


@register("a4_plane_and_space_errors", over(f"{NEAR}, {E}, {PLANE}, m AS (SELECT run, sqrt(ex * ex + ey * ey) AS d2, sqrt(ex * ex + ey * ey + ez * ez) AS d3, ez FROM pl)", "SELECT run, round(avg(d2), 6) AS mean2, round(sqrt(avg(d2 * d2)), 6) AS rmse2, round(quantile_cont(d2, 0.95), 6) AS p95, round(avg(d3), 6) AS mean3, round(max(d3), 6) AS max3, round(sqrt(avg(ez * ez)), 6) AS rmse_z FROM m GROUP BY run"))
def _(s, d):
    x, y, z = F.col("ex"), F.col("ey"), F.col("ez")
    m = _plane(s, d).withColumn("d2", F.sqrt(x * x + y * y)).withColumn("d3", F.sqrt(x * x + y * y + z * z))
    return rounded(m.groupBy("run").agg(F.avg("d2").alias("mean2"), F.sqrt(F.avg(F.col("d2") * F.col("d2"))).alias("rmse2"), F.percentile("d2", F.lit(0.95)).alias("p95"), F.avg("d3").alias("mean3"), F.max("d3").alias("max3"), F.sqrt(F.avg(z * z)).alias("rmse_z")), "run")


@register("a5_covariance_consistency", over(f"{NEAR}, {E}, {PLANE}, m AS (SELECT run, ex * ex / (400 + abs(ex)) + ey * ey / 9 AS m2, sqrt((400 + abs(ex) + 9) / 2) AS sg FROM pl)", "SELECT run, round(avg(CASE WHEN m2 <= 5.991 THEN 1.0 ELSE 0.0 END), 6) AS inside95, round(avg(least(m2, 1e4)) / 2, 6) AS nees, round(median(sg), 6) AS sigma_median FROM m GROUP BY run"))
def _(s, d):
    return rounded(_plane(s, d).groupBy("run").agg(*agg.consistency(F.col("ex"), F.col("ey"), 400 + F.abs("ex"), F.lit(9.0))), "run")


@register("a7_end_of_run_and_drift", over(f"{NEAR}, {E}, m AS (SELECT run, arg_max(e, (t, seq)) AS last, arg_min(e, (t, seq)) AS first, sum(v) AS way FROM e WHERE e IS NOT NULL GROUP BY run)", "SELECT run, round(last, 6) AS last, round(last - first, 6) AS change, CASE WHEN way >= 200 THEN round(100 * last / way, 6) END AS drift FROM m"))
def _(s, d):
    m = _errors(s, d).filter("e is not null").groupBy("run").agg(F.max(F.struct("t", "seq", "e"))["e"].alias("last"), F.min(F.struct("t", "seq", "e"))["e"].alias("first"), F.sum("v").alias("way"))
    return m.select("run", F.round("last", 6).alias("last"), F.round(F.col("last") - F.col("first"), 6).alias("change"), F.when(F.col("way") >= 200, F.round(100 * F.col("last") / F.col("way"), 6)).alias("drift"))


@register("a8_decimated_path_length", over(f"g AS (SELECT run, (t // {12 * HOUR}) AS slot, arg_min(v, (t, seq)) AS v FROM front GROUP BY ALL), p AS (SELECT run, abs(v - lag(v) OVER (PARTITION BY run ORDER BY slot)) AS step FROM g)", "SELECT run, round(coalesce(sum(CASE WHEN step < 150 THEN step END), 0), 6) AS way FROM p GROUP BY run"))
def _(s, d):
    g = front(s, d).groupBy("run", F.floor(F.col("t") / F.lit(12 * HOUR)).alias("slot")).agg(F.min(F.struct("t", "seq", "v"))["v"].alias("v"))
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("run").orderBy("slot")))
    return g.withColumn("step", step).groupBy("run").agg(F.round(F.coalesce(F.sum(F.when(F.col("step") < 150, F.col("step"))), F.lit(0.0)), 6).alias("way"))


WIDE = f"wide AS (SELECT run, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, max(abs(e)) AS top, avg(CASE WHEN r_t IS NULL THEN 0.0 ELSE 1.0 END) AS cov FROM e GROUP BY run)"


def _wide(s, d):
    e = F.col("e")
    return _errors(s, d).groupBy("run").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("top"), F.avg(F.col("r_t").isNotNull().cast("double")).alias("cov"))


@register("a9_score", over(f"{NEAR}, {E}, {WIDE}", "SELECT run, round(CASE WHEN rmse IS NULL THEN 10 ELSE (2 * least(rmse / 40, 10) + 1 * least(abs(bias) / 20, 10) + 0.5 * least(top / 100, 10)) / 3.5 END * cov + 10 * (1 - cov), 6) AS score FROM wide"))
def _(s, d):
    return agg.score(_wide(s, d), "run", {"rmse": (2.0, 40.0), "bias": (1.0, 20.0), "top": (0.5, 100.0)}, F.col("cov")).select("run", *r6("score"))


LONG = "long AS (SELECT run, 'rmse' AS metric, rmse AS value FROM wide UNION ALL SELECT run, 'bias', bias FROM wide UNION ALL SELECT run, 'top', top FROM wide)"
ACROSS = "count(value) AS n, round(median(abs(value)), 6) AS median, round(avg(abs(value)), 6) AS mean, round(quantile_cont(abs(value), 0.9), 6) AS p90, round(max(abs(value)), 6) AS max"


def _long(s, d):
    return agg.unpivoted(_wide(s, d).select("run", "rmse", "bias", "top"), ["run"], ["rmse", "bias", "top"])


@register("a10_across_runs", over(f"{NEAR}, {E}, {WIDE}, {LONG}", f"SELECT metric, {ACROSS} FROM long WHERE value IS NOT NULL GROUP BY metric"))
def _(s, d):
    return rounded(agg.across_runs(_long(s, d)), "metric")


@register("a11_by_dimensions", f"SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(n_name, 'all') AS nation, count(*) AS n, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((), (c_mktsegment), (n_name))")
def _(s, d):
    o = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    g = o.groupingSets([[], [seg], [nat]], seg, nat).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("o_totalprice"), 4).alias("median"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 4).alias("p90"))
    return g.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "median", "p90")


@register("a12_worst_runs", over(f"{NEAR}, {E}, {WIDE}, {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(value) DESC NULLS LAST, run) AS rank FROM long)", "SELECT metric, run, round(value, 6) AS value, rank FROM r WHERE rank <= 8"))
def _(s, d):
    return agg.worst(_long(s, d)).select("metric", "run", F.round("value", 6).alias("value"), F.col("rank").cast("long").alias("rank"))


@register("a13_robustness_roll_up", over("c AS (SELECT run, stream, count(*) AS n, sum(CASE WHEN v > 150 THEN 1 ELSE 0 END) AS high FROM s GROUP BY ALL)", "SELECT stream, median(n) AS median, min(n) AS least, max(n) AS most, sum(high)::BIGINT AS high, coalesce(string_agg(CASE WHEN high = 0 THEN run::VARCHAR END, ',' ORDER BY run), '') AS clean_runs FROM c GROUP BY stream"))
def _(s, d):
    c = log(s, d).groupBy("run", "stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 150).alias("high"))
    clean = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("high") == 0, F.col("run")))), lambda x: x.cast("string")), ",")
    return c.groupBy("stream").agg(F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("high").alias("high"), clean.alias("clean_runs"))


@register("a14_error_per_bucket", over(f"{NEAR}, {E}, f AS (SELECT run, t, e, min(t) OVER (PARTITION BY run) AS t0 FROM e)", f"SELECT run, (t - t0) // {5 * DAY} AS bucket, count(e) AS n, round(sqrt(avg(e * e)), 6) AS rmse FROM f GROUP BY ALL"))
def _(s, d):
    f = _errors(s, d).withColumn("bucket", F.floor((F.col("t") - F.min("t").over(Window.partitionBy("run"))) / F.lit(5 * DAY)))
    return f.groupBy("run", "bucket").agg(F.count("e").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"))


@register("a15_component_errors", over(f"{NEAR}, {E}, {PLANE}, l AS (SELECT run, unnest(['x', 'y', 'z']) AS part, unnest([ex, ey, ez]) AS e FROM pl)", "SELECT run, part, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max FROM l GROUP BY ALL"))
def _(s, d):
    p = _plane(s, d).select("run", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"))
    return rounded(p.unpivot(["run"], ["x", "y", "z"], "part", "e").groupBy("run", "part").agg(*agg.summary(F.col("e"))), "run", "part")


@register("a16_median_and_upper_spread", over("m AS (SELECT run, median(v) AS mid FROM s GROUP BY run), a AS (SELECT run, any_value(mid) AS mid, list_sort(list(abs(v - mid))) AS l FROM s JOIN m USING (run) GROUP BY run)", "SELECT run, round(mid, 6) AS mid, round(l[len(l) // 2 + 1], 6) AS spread FROM a"))
def _(s, d):
    x = log(s, d)
    m = x.groupBy("run").agg(F.median("v").alias("mid"))
    return rounded(x.join(m, "run").groupBy("run").agg(F.first("mid").alias("mid"), agg.upper_median(F.abs(F.col("v") - F.col("mid"))).alias("spread")), "run")


@register("a17_robust_sigma", over("m AS (SELECT run, median(v) AS mid FROM s GROUP BY run)", "SELECT run, round(1.4826 * median(abs(v - mid)), 6) AS sigma FROM s JOIN m USING (run) GROUP BY run"))
def _(s, d):
    return rounded(agg.robust_sigma(log(s, d), "run", "v"), "run")


@register("a18_trimmed_circular_mean", over("a AS (SELECT run, v / 60 AS w FROM s), m AS (SELECT run, atan2(sum(sin(w)), sum(cos(w))) AS m FROM a GROUP BY run), k AS (SELECT run, w, m, acos(least(1.0, greatest(-1.0, cos(w - m)))) <= radians(20) AS near FROM a JOIN m USING (run))", "SELECT run, round(coalesce(atan2(sum(CASE WHEN near THEN sin(w) END), sum(CASE WHEN near THEN cos(w) END)), any_value(m)), 6) AS mean_angle FROM k GROUP BY run"))
def _(s, d):
    return rounded(agg.trimmed_circular_mean(log(s, d).withColumn("w", F.col("v") / 60), "run", "w"), "run")


@register("a19_majority_vote", over("c AS (SELECT run, CASE WHEN v > 25 THEN 'fast' ELSE 'slow' END AS label, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT run, max((c, label)) AS b, sum(c) AS n FROM c GROUP BY run)", "SELECT run, CASE WHEN 2 * b[1] > n THEN b[2] END AS majority FROM m"))
def _(s, d):
    return agg.majority(log(s, d).withColumn("label", F.when(F.col("v") > 25, "fast").otherwise("slow")), "run", "label")


@register("a20_fingerprints", "SELECT doc_id, md5(text) AS fingerprint, min(doc_id) OVER (PARTITION BY md5(text)) AS first_holder FROM documents")
def _(s, d):
    x = read(s, d, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    first = x.groupBy("fingerprint").agg(F.min("doc_id").alias("first_holder"))
    return x.join(first, "fingerprint").select("doc_id", "fingerprint", "first_holder")


EDGES = [0, 10, 20, 40, 80, 160, 320, 640]


@register("a21_binned_mean", over(f"b AS (SELECT unnest(range({len(EDGES) - 1})) AS bin, unnest({EDGES[:-1]}) AS lo, unnest({EDGES[1:]}) AS hi)", "SELECT bin::INT AS bin, lo::DOUBLE AS lo, hi::DOUBLE AS hi, round(avg(seq % 100), 6) AS mean, count(v) AS n FROM b LEFT JOIN front ON v >= lo AND v < hi GROUP BY ALL"))
def _(s, d):
    x = front(s, d).withColumn("y", F.col("seq") % 100)
    return agg.binned_mean(x, "v", "y", EDGES).select("bin", "lo", "hi", F.round("mean", 6).alias("mean"), "n")


@register("a22_distribution_function", over("", "SELECT run, seq, round(cume_dist() OVER (PARTITION BY stream ORDER BY v), 6) AS share FROM s"))
def _(s, d):
    return log(s, d).select("run", "seq", F.round(F.cume_dist().over(Window.partitionBy("stream").orderBy("v")), 6).alias("share"))


@register("a23_median_and_quartiles", over("", "SELECT run, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3 FROM s GROUP BY run"))
def _(s, d):
    q = log(s, d).groupBy("run").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("run", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@register("a24_latency_percentiles", over(NEAR + ", l AS (SELECT run, t, abs(r_t - t) / 1e6 AS lat, min(t) OVER (PARTITION BY run) AS t0 FROM near)", f"SELECT run, round(quantile_cont(lat, 0.5), 3) AS p50, round(quantile_cont(lat, 0.99), 3) AS p99, round(max(lat), 3) AS max FROM l WHERE t > t0 + {DAY} GROUP BY run"))
def _(s, d):
    x = _errors(s, d).withColumn("lat", F.abs(F.col("r_t") - F.col("t")) / 1e6).withColumn("t0", F.min("t").over(Window.partitionBy("run"))).filter(F.col("t") > F.col("t0") + DAY)
    return x.groupBy("run").agg(F.round(F.percentile("lat", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("lat", F.lit(0.99)), 3).alias("p99"), F.round(F.max("lat"), 3).alias("max"))


@register("a25_grid_coverage", over(f"b AS (SELECT run, count(DISTINCT t // {DAY}) AS filled, max(t) // {DAY} - min(t) // {DAY} + 1 AS cells FROM front GROUP BY run)", "SELECT run, round(filled / cells, 6) AS coverage FROM b"))
def _(s, d):
    cell = F.floor(F.col("t") / F.lit(DAY))
    return front(s, d).groupBy("run").agg(F.round(F.count_distinct(cell) / (F.max(cell) - F.min(cell) + 1), 6).alias("coverage"))


@register("a26_log_histogram_quantile", over("b AS (SELECT run, floor(log10(v) * 40) AS bin, count(*) AS c FROM s WHERE v > 0 GROUP BY ALL), k AS (SELECT run, bin, sum(c) OVER (PARTITION BY run ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY run) AS n FROM b)", "SELECT run, round(pow(10, (min(bin) + 1) / 40), 6) AS q FROM k WHERE cum >= 0.9 * n GROUP BY run"))
def _(s, d):
    return rounded(agg.log_histogram_quantile(log(s, d), "run", "v", 0.9), "run")


@register("a27_nearest_rank", over("l AS (SELECT run, list_sort(list(v)) AS l FROM s GROUP BY run)", "SELECT run, l[least(len(l) - 1, floor(0.9 * len(l))::BIGINT) + 1] AS q FROM l"))
def _(s, d):
    return log(s, d).groupBy("run").agg(agg.nearest_rank(F.col("v"), 0.9).alias("q"))


@register("a28_median_per_bin", over("b AS (SELECT generate_series AS bin FROM generate_series(0, 40))", "SELECT bin, round(median(v), 6) AS median FROM b LEFT JOIN s ON floor(v / 20) = bin GROUP BY bin"))
def _(s, d):
    m = log(s, d).groupBy(F.floor(F.col("v") / 20).alias("bin")).agg(F.median("v").alias("median"))
    return s.range(0, 41).withColumnRenamed("id", "bin").join(m, "bin", "left").select("bin", *r6("median"))


@register("a29_scale_ratio", over(NEAR, "SELECT run, count(*) AS n, round(sum(v * r_v) / sum(r_v * r_v), 6) AS scale FROM near WHERE r_v > 5 GROUP BY run"))
def _(s, d):
    return _errors(s, d).filter("r_v > 5").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * F.col("r_v")) / F.sum(F.col("r_v") * F.col("r_v")), 6).alias("scale"))


@register("a30_normal_equations", over("x AS (SELECT 1.0 AS a, l_quantity AS b, l_discount AS c, l_extendedprice / 1000 AS y FROM lineitem), q AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy, sum(y * y) AS yy FROM x)", "SELECT unnest([0, 0, 0, 1, 1, 2, 0, 1, 2, -1])::INT AS i, unnest([0, 1, 2, 1, 2, 2, -1, -1, -1, -1])::INT AS j, round(unnest([aa, ab, ac, bb, bc, cc, ay, by_, cy, yy]), 2) AS value FROM q"))
def _(s, d):
    x = read(s, d, "lineitem").select(F.lit(1.0).alias("a"), F.col("l_quantity").alias("b"), F.col("l_discount").alias("c"), (F.col("l_extendedprice") / 1000).alias("y"))
    return agg.normal_equations(x, ["a", "b", "c"], "y").select("i", "j", F.round("value", 2).alias("value"))


@register("a31_spread_by_mode", over("r AS (SELECT stream, v - avg(v) OVER (PARTITION BY run) AS e FROM s), m AS (SELECT stream, median(e) AS mid FROM r GROUP BY stream)", "SELECT stream, round(stddev_pop(e), 6) AS std, round(1.4826 * median(abs(e - mid)), 6) AS robust FROM r JOIN m USING (stream) GROUP BY stream"))
def _(s, d):
    r = log(s, d).withColumn("e", F.col("v") - F.avg("v").over(Window.partitionBy("run")))
    return r.groupBy("stream").agg(F.round(F.stddev_pop("e"), 6).alias("std")).join(agg.robust_sigma(r, "stream", "e").select("stream", F.round("sigma", 6).alias("robust")), "stream")


LAGS = [-12, -6, 0, 6, 12]


@register("a32_lag_scan", over("lg AS (SELECT unnest([-12, -6, 0, 6, 12]) AS lag), p AS (SELECT run, seq, v, lag, t + lag * " + str(HOUR) + " AS tt FROM front, lg), b AS (SELECT p.run, p.seq, p.v, p.lag, r.v AS rv FROM p ASOF JOIN rear r ON p.run = r.run AND p.tt >= r.t), q AS (SELECT run, lag, avg((v - rv) * (v - rv)) AS sse FROM b GROUP BY ALL)", "SELECT run, arg_min(lag, (round(sse, 6), lag))::BIGINT AS best, round(min(sse), 4) AS sse FROM q GROUP BY run"))
def _(s, d):
    p = front(s, d).withColumn("lag", F.explode(F.array(*[F.lit(k).cast("long") for k in LAGS]))).withColumn("t", F.col("t") + F.col("lag") * HOUR)
    e = timeops.asof(p, rear(s, d)).filter("r_v is not null")
    q = e.groupBy("run", "lag").agg(F.avg((F.col("v") - F.col("r_v")) * (F.col("v") - F.col("r_v"))).alias("sse"))
    return q.groupBy("run").agg(F.min_by("lag", F.struct(F.round("sse", 6), "lag")).alias("best"), F.round(F.min("sse"), 4).alias("sse"))


@register("a33_autocorrelation", over("l AS (SELECT run, v, lag(v) OVER (PARTITION BY run ORDER BY t, seq) AS pv FROM s), z AS (SELECT run, corr(v, pv) AS r1, avg(CASE WHEN v * v / 2500 > 9 THEN 1.0 ELSE 0.0 END) AS over9, count(pv) AS n FROM l GROUP BY run)", "SELECT run, CASE WHEN NOT isnan(r1) THEN round(r1, 6) END AS r1, round(over9, 6) AS over9 FROM z WHERE n > 2"))
def _(s, d):
    x = log(s, d).withColumn("pv", F.lag("v").over(line()))
    z = x.groupBy("run").agg(F.round(F.corr("v", "pv"), 6).alias("r1"), F.round(F.avg((F.col("v") * F.col("v") / 2500 > 9).cast("double")), 6).alias("over9"), F.count("pv").alias("n"))
    return z.filter("n > 2").drop("n")


@register("a34_horizon_errors", over("h AS (SELECT unnest([1, 2, 5]) AS horizon), w AS (SELECT run, seq, v, lead(v, 1) OVER o AS v1, lead(v, 2) OVER o AS v2, lead(v, 5) OVER o AS v5 FROM front WINDOW o AS (PARTITION BY run ORDER BY t, seq)), e AS (SELECT horizon, CASE horizon WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v5 END - v AS e FROM w, h)", "SELECT horizon::INT AS horizon, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.9), 6) AS p90 FROM e GROUP BY horizon"))
def _(s, d):
    w = front(s, d).select(*[(F.lead("v", k).over(line()) - F.col("v")).alias(str(k)) for k in (1, 2, 5)])
    e = w.unpivot([], ["1", "2", "5"], "horizon", "e").withColumn("horizon", F.col("horizon").cast("int"))
    return rounded(e.groupBy("horizon").agg(F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.percentile(F.abs("e"), F.lit(0.9)).alias("p90")), "horizon")


@register("a35_lateness_distribution", over("l AS (SELECT run, seq, t + (seq * 7919 % 100) * 60000000 AS th FROM s), m AS (SELECT run, max(th) OVER (PARTITION BY run ORDER BY seq) - th AS late FROM l)", "SELECT run, round(quantile_cont(late, 0.99) / 1e6, 3) AS p99, max(late) AS worst FROM m GROUP BY run"))
def _(s, d):
    x = log(s, d).withColumn("th", F.col("t") + (F.col("seq") * 7919 % 100) * 60_000_000)
    late = F.max("th").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("th")
    return x.withColumn("late", late).groupBy("run").agg(F.round(F.percentile("late", F.lit(0.99)) / 1e6, 3).alias("p99"), F.max("late").alias("worst"))


LOGO = "x AS (SELECT run % 5 AS grp, k, abs(v - 30 * k) AS loss FROM s, (SELECT unnest([1, 2, 3]) AS k)), p AS (SELECT grp, k, sum(loss) AS s, count(*) AS c FROM x GROUP BY ALL), tt AS (SELECT k, sum(s) AS ts, sum(c) AS tc FROM p GROUP BY k), r AS (SELECT grp, k, round((ts - s) / (tc - c), 9) AS other, s / c AS own FROM p JOIN tt USING (k))"


@register("a36_leave_one_group_out", over(LOGO, "SELECT grp, arg_min(k, (other, k))::INT AS chosen, round(min(other), 6) AS train_loss, round(arg_min(own, (other, k)), 6) AS test_loss FROM r GROUP BY grp"))
def _(s, d):
    x = log(s, d).select((F.col("run") % 5).alias("grp"), "v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).withColumn("loss", F.abs(F.col("v") - 30 * F.col("k")))
    return rounded(agg.leave_one_group_out(x, "grp", "k", "loss"), "grp", "chosen")


@register("a38_flag_rates", over(ISLANDS + ", hh AS (SELECT run, (max(t) - min(t)) / " + str(DAY) + ".0 AS days FROM s GROUP BY run), c AS (SELECT run, count(*) AS n, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS long FROM ep GROUP BY run)", "SELECT run, n AS episodes, long::BIGINT AS long, round(n / days, 6) AS per_day FROM c JOIN hh USING (run)"))
def _(s, d):
    x = log(s, d)
    ep = episodes.islands(x.filter("v > 40"), gap=DAY).groupBy("run").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("n") >= 3).alias("long"))
    days = x.groupBy("run").agg(((F.max("t") - F.min("t")) / DAY).alias("days"))
    return ep.join(days, "run").select("run", "episodes", "long", F.round(F.col("episodes") / F.col("days"), 6).alias("per_day"))


@register("a39_state_shares", over("c AS (SELECT run, stream, count(*) AS c FROM s GROUP BY ALL)", "SELECT run, stream, round(c / sum(c) OVER (PARTITION BY run), 6) AS share FROM c"))
def _(s, d):
    c = log(s, d).groupBy("run", "stream").agg(F.count(F.lit(1)).alias("c"))
    return c.select("run", "stream", F.round(F.col("c") / F.sum("c").over(Window.partitionBy("run")), 6).alias("share"))


@register("a40_representative_run", over("m AS (SELECT run, avg(v) AS a, stddev_pop(v) AS b, count(*) AS n FROM s GROUP BY run), q AS (SELECT median(a) AS ma, median(b) AS mb, median(n) AS mn FROM m)", "SELECT arg_min(run, (round(abs(ln(a / ma)) + abs(ln(b / mb)), 9), run)) AS run, round(min(abs(ln(a / ma)) + abs(ln(b / mb))), 6) AS distance FROM m, q WHERE n >= 0.97 * mn"))
def _(s, d):
    m = log(s, d).groupBy("run").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"), F.count(F.lit(1)).alias("n"))
    q = m.agg(F.median("a").alias("ma"), F.median("b").alias("mb"), F.median("n").alias("mn"))  # one row
    x = m.join(F.broadcast(q), F.col("n") >= 0.97 * F.col("mn")).withColumn("distance", F.abs(F.log(F.col("a") / F.col("ma"))) + F.abs(F.log(F.col("b") / F.col("mb"))))
    return x.agg(F.min_by("run", F.struct(F.round("distance", 9), "run")).alias("run"), F.round(F.min("distance"), 6).alias("distance"))


@register("a41_counters", over("", "SELECT run, count(*) AS rows, sum(CASE WHEN v < 5 THEN 1 ELSE 0 END)::BIGINT AS low, sum(CASE WHEN v > 150 THEN 1 ELSE 0 END)::BIGINT AS spikes, sum(CASE WHEN stream = 'error' THEN 1 ELSE 0 END)::BIGINT AS other FROM s GROUP BY run"))
def _(s, d):
    return log(s, d).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v") < 5).alias("low"), F.count_if(F.col("v") > 150).alias("spikes"), F.count_if(F.col("stream") == "error").alias("other"))


@register("o3_top_values", over("r AS (SELECT run, seq, v, row_number() OVER (ORDER BY v DESC, seq) AS rank FROM s)", "SELECT run, seq, v FROM r WHERE rank <= 8"))
def _(s, d):
    return log(s, d).select("run", "seq", "v").orderBy(F.desc("v"), "seq").limit(8)


# --- experiments ------------------------------------------------------------------------------


@register("e3_run_index", over("i AS (SELECT run, run % 7 AS vehicle, min(t) // 86400000000 AS day, count(*) AS n, md5(string_agg(v::VARCHAR, ',' ORDER BY seq) FILTER (WHERE stream = 'view')) AS fp FROM s GROUP BY run)", "SELECT run, vehicle, day, dense_rank() OVER (ORDER BY vehicle) - 1 AS fold, min(run) OVER (PARTITION BY fp) <> run AS is_copy, n >= 60 AS usable FROM i"))
def _(s, d):
    fp = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stream") == "view", F.struct("seq", "v")))), lambda x: x["v"].cast("string")), ","))
    i = log(s, d).groupBy("run").agg((F.first("run") % 7).alias("vehicle"), F.floor(F.min("t") / F.lit(86_400_000_000)).alias("day"), F.count(F.lit(1)).alias("n"), fp.alias("fp"))
    folds = i.select("vehicle").distinct().withColumn("fold", (F.dense_rank().over(Window.orderBy("vehicle")) - 1).cast("long"))
    first = i.groupBy("fp").agg(F.min("run").alias("holder"))
    return i.join(first, "fp").join(folds, "vehicle").select("run", "vehicle", "day", "fold", (F.col("holder") != F.col("run")).alias("is_copy"), (F.col("n") >= 60).alias("usable"))


@register("e5_summary_and_comparison", over("a AS (SELECT run, avg(v) AS m, stddev_pop(v) AS sd FROM front GROUP BY run), b AS (SELECT run, avg(v) AS m, stddev_pop(v) AS sd FROM rear GROUP BY run), j AS (SELECT run, unnest(['mean', 'spread']) AS metric, unnest([a.m, a.sd]) AS va, unnest([b.m, b.sd]) AS vb FROM a JOIN b USING (run))", "SELECT metric, count(*) AS n, round(median(va), 6) AS a, round(median(vb), 6) AS b, round(median(vb - va), 6) AS change, sum(CASE WHEN vb < va THEN 1 ELSE 0 END)::BIGINT AS better FROM j GROUP BY metric"))
def _(s, d):
    m = lambda df: agg.unpivoted(df.groupBy("run").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")), ["run"], ["mean", "spread"])
    j = m(front(s, d)).withColumnRenamed("value", "va").join(m(rear(s, d)).withColumnRenamed("value", "vb"), ["run", "metric"])
    return rounded(j.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.median("va").alias("a"), F.median("vb").alias("b"), F.median(F.col("vb") - F.col("va")).alias("change"), F.count_if(F.col("vb") < F.col("va")).alias("better")), "metric")


@register("e7_parameter_sweep", over("x AS (SELECT k, run, avg(abs(v - 30 * k)) AS loss FROM s, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL)", "SELECT k::INT AS k, round(median(loss), 6) AS median, round(quantile_cont(loss, 0.9), 6) AS p90 FROM x GROUP BY k"))
def _(s, d):
    x = log(s, d).select("run", "v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).groupBy("k", "run").agg(F.avg(F.abs(F.col("v") - 30 * F.col("k"))).alias("loss"))
    return rounded(x.groupBy("k").agg(F.median("loss").alias("median"), F.percentile("loss", F.lit(0.9)).alias("p90")), "k")


@register("e8_mean_and_hold_estimate", over("m AS (SELECT run, seq, t FROM front UNION ALL SELECT run, seq, t FROM rear), f AS (SELECT m.run, m.seq, m.t, a.v AS fv, m.t - a.t AS fa FROM m ASOF LEFT JOIN front a ON m.run = a.run AND m.t >= a.t), r AS (SELECT m.seq, b.v AS rv, m.t - b.t AS ra FROM m ASOF LEFT JOIN rear b ON m.run = b.run AND m.t >= b.t), j AS (SELECT run, seq, t, CASE WHEN fa < " + str(DAY) + " THEN fv END AS fv, CASE WHEN ra < " + str(DAY) + " THEN rv END AS rv FROM f JOIN r USING (seq))", "SELECT run, seq, round(CASE WHEN fv IS NULL THEN rv WHEN rv IS NULL THEN fv ELSE (fv + rv) / 2 END, 6) AS v FROM j"))
def _(s, d):
    m = front(s, d).select("run", "seq", "t").unionByName(rear(s, d).select("run", "seq", "t"))
    a = timeops.asof(m, front(s, d), stale=DAY, strict=True).select("run", "seq", "t", F.col("r_v").alias("fv"))
    j = timeops.asof(a, rear(s, d), stale=DAY, strict=True)
    both = F.when(F.col("fv").isNull(), F.col("r_v")).when(F.col("r_v").isNull(), F.col("fv")).otherwise((F.col("fv") + F.col("r_v")) / 2)
    return j.select("run", "seq", F.round(both, 6).alias("v"))


@register("e9_difference_report", over(f"l AS (SELECT run, t // {HOUR} AS stamp, avg(v) AS v FROM front GROUP BY ALL), r AS (SELECT run, t // {HOUR} AS stamp, avg(v) AS v FROM rear GROUP BY ALL)", "SELECT stamp // 24 AS day, count(*) AS n, round(max(abs(l.v - r.v)), 6) AS largest FROM l JOIN r USING (run, stamp) GROUP BY ALL"))
def _(s, d):
    m = lambda df, n: df.groupBy("run", F.floor(F.col("t") / F.lit(HOUR)).alias("stamp")).agg(F.avg("v").alias(n))
    j = m(front(s, d), "a").join(m(rear(s, d), "b"), ["run", "stamp"])
    return j.groupBy(F.floor(F.col("stamp") / 24).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("largest"))


@register("e13_standstill_statistics", over("n AS (SELECT run, seq, t, v < 15 AS still, v FROM front), c AS (SELECT *, CASE WHEN still = lag(still) OVER w THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY run ORDER BY t, seq)), k AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY t, seq) AS no FROM c), g AS (SELECT run, no, max(t) - min(t) AS dur, count(*) AS n FROM k WHERE still GROUP BY run, no)", "SELECT run, count(*) AS stops, round(avg(dur) / 1e6, 3) AS mean_s, max(n) AS longest FROM g GROUP BY run"))
def _(s, d):
    r = episodes.runs(front(s, d), F.col("v") < 15).filter("label").groupBy("run", "run_no").agg((F.max("t") - F.min("t")).alias("dur"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("run").agg(F.count(F.lit(1)).alias("stops"), F.round(F.avg("dur") / 1e6, 3).alias("mean_s"), F.max("n").alias("longest"))


@register("e17_variant_report", over("v AS (SELECT run, unnest(['front', 'rear', 'mean']) AS variant, unnest([avg(CASE WHEN stream = 'view' THEN v END), avg(CASE WHEN stream = 'click' THEN v END), avg(v)]) AS x FROM s GROUP BY run)", "SELECT variant, count(x) AS n, round(median(x), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90 FROM v GROUP BY variant"))
def _(s, d):
    m = log(s, d).groupBy("run").agg(F.avg(F.when(F.col("stream") == "view", F.col("v"))).alias("front"), F.avg(F.when(F.col("stream") == "click", F.col("v"))).alias("rear"), F.avg("v").alias("mean"))
    x = m.unpivot(["run"], ["front", "rear", "mean"], "variant", "x")
    return rounded(x.groupBy("variant").agg(F.count("x").alias("n"), F.median("x").alias("median"), F.percentile("x", F.lit(0.9)).alias("p90")), "variant")


GRID = "ob AS (SELECT run, seq, v / 100 AS z, (seq % 50) / 50.0 AS s FROM front), gr AS (SELECT i, j, i * 0.1 AS shift, 0.8 + j * 0.1 AS scale FROM generate_series(0, 5) a(i), generate_series(0, 4) b(j)), ll AS (SELECT run, i, j, sum(greatest(-0.5 * (z - scale * sin(6 * (s + shift))) ** 2 / 0.04, -8)) AS l FROM ob, gr GROUP BY run, i, j)"


@register("st7_grid_posterior", over(GRID, "SELECT run, arg_max(i, (round(l, 6), -i, -j)) AS i, arg_max(j, (round(l, 6), -i, -j)) AS j, round(max(l), 4) AS best FROM ll GROUP BY run"))
def _(s, d):
    """Truncated log-likelihood of observations on a fixed grid of shift and scale; sums, so order does not matter."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(6) for j in range(5)]))
    ob = front(s, d).select("run", (F.col("v") / 100).alias("z"), ((F.col("seq") % 50) / 50.0).alias("s"), cells.alias("c"))
    r = F.col("z") - (0.8 + F.col("c.j") * 0.1) * F.sin(6 * (F.col("s") + F.col("c.i") * 0.1))
    ll = ob.groupBy("run", "c.i", "c.j").agg(F.sum(F.greatest(-0.5 * r * r / 0.04, F.lit(-8.0))).alias("l"))
    best = ll.groupBy("run").agg(F.max(F.struct(F.round("l", 6).alias("r"), (-F.col("i")).alias("a"), (-F.col("j")).alias("b"), "l", "i", "j")).alias("m"))
    return best.select("run", "m.i", "m.j", F.round("m.l", 4).alias("best"))


