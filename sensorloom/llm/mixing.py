"""Mixing sources to target weights: bounded entropy balancing, in DataFrame operations only.

Among document rates r between 0 and ``cap``, those nearest to 1 in entropy that meet each
source's token target are r = min(cap, exp(lambda * tokens)), one lambda a source.  The convex
dual is solved by Newton steps, safeguarded by a bracket; a step is one aggregation over the
histogram of (source, tokens), which is all that the dual depends on.  Rates become whole copies by
one threshold a source on a seeded hash of the record, found in rounds of binned sums, and a few
single records then take up what is left of the target.

Sums that decide are sums of whole numbers and lambda is rounded, so reruns agree.  Edge cases:
a null text has size 0; a null source is a source, last in order; a source without tokens has
target 0 and keeps its records once; rows equal in id and text are dealt alike; a document longer
than its source's target may be taken once, or not at all; an empty table gives an empty result.
Input columns stay as they are: an added column whose name is taken gets ``mix_`` before it
(``added_names``), and ``mixed_copies`` returns the input's own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import BROADCAST_ROWS, WORD_PATTERN, materialise

ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]
_BINS, _ROUNDS, _PICKS = 512, 4, 3


def word_count_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Targets are proportional to weights, dealt in code-point order, but for sources held at
    ``cap`` times their size, whose excess goes to the others: a fill to one common level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    upward = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("free", F.col("ratio") > F.col("level"))
    )
    # The first free source, going upward, sets the level for itself and all above it.
    level = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"]
    first = F.min(F.when(F.col("free"), F.col("ratio"))).over(everything)
    target = F.when(first.isNull() | (F.col("ratio") < first), F.col("most").cast("double")).otherwise(level * F.col("w"))
    return w.select("source", "source_size", target.alias("target"))


def _rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))


def _solve(hist: DataFrame, targets: DataFrame, cap: int, steps: int) -> DataFrame:
    """``source, source_size, target, scale, lam``: Newton's iteration on all sources at once."""
    spread = hist.filter("size > 0").groupBy("source").agg(F.max("size").cast("double").alias("scale"), F.min("size").alias("least"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    state = (
        targets.alias("a").join(spread.alias("b"), same, "left").select("a.*", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("least", F.lit(1)).alias("least"))
        # cap * size is met from `hi` on; at `lo` hardly a token is left
        .withColumn("hi", F.log(F.lit(float(cap))) * F.col("scale") / F.col("least"))
        .withColumn("lo", -45.0 * F.col("scale") / F.col("least"))
        .withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size"), F.col("hi")).otherwise(0.0))
        .withColumn("done", (F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0))
    )
    state = materialise(state, "mix-dual")
    for _ in range(steps):
        r = _rate(cap)
        x = F.col("size") / F.col("scale")
        sums = (
            hist.alias("h").join(state.filter(~F.col("done")).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .select(F.col("s.source").alias("source"), "n", "size", "scale", "lam")
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * r).alias("mass"), F.sum(F.when(r < cap, F.col("n") * F.col("size") * x * r)).alias("slope"))
        )
        gap = F.col("mass") - F.col("target")
        step = (
            state.alias("a").join(sums.alias("b"), same, "left").select("a.*", "mass", "slope")
            .withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("newton", F.col("lam") - gap / F.col("slope"))
            .withColumn("met", F.abs(gap) <= 1e-10 * F.col("target"))
            .withColumn("next", F.when(F.col("newton").between(F.col("lo"), F.col("hi")), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("lam", F.when(F.col("done") | F.col("met"), F.col("lam")).otherwise(F.col("next")))
            .withColumn("done", F.col("done") | F.col("met"))
        )
        state = materialise(step.select(state.columns), "mix-dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "scale", F.round("lam", 9).alias("lam"))


def _joined(rows: DataFrame, params: DataFrame, n_sources: int) -> DataFrame:
    """Each row with its source's parameters; the small side is broadcast while it is small."""
    params = params.withColumnRenamed("source", "__source")
    side = F.broadcast(params) if n_sources <= BROADCAST_ROWS else params
    return rows.join(side, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")


def _copies(cap: int) -> Column:
    r = _rate(cap)
    whole = F.floor(r)
    extra = (r < cap) & (F.col("u") - (r - whole) < F.col("theta"))
    return (whole + extra.cast("long")).cast("long")


def _threshold(slim: DataFrame, solved: DataFrame, cap: int, n_sources: int) -> DataFrame:
    """Adds ``theta``: the records with u - frac(rate) below it round up, the others down."""
    state = solved.withColumn("low", F.lit(-1.0)).withColumn("width", F.lit(2.0)).withColumn("below", F.lit(0).cast("long"))
    r = _rate(cap)
    rows = _joined(slim, solved, n_sources).select("source", "size", F.floor(r).cast("long").alias("whole"), F.when(r < cap, F.col("u") - (r - F.floor(r))).alias("v"))
    rows = materialise(rows, "mix-rates")
    base = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    state = state.alias("a").join(base.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "base")
    state = materialise(state, "mix-theta")
    for _ in range(_ROUNDS):
        step = F.col("width") / _BINS
        bins = (
            _joined(rows, state, n_sources)
            .filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("width")))
            .withColumn("bin", F.least(F.floor((F.col("v") - F.col("low")) / step), F.lit(_BINS - 1)).cast("long"))
            .groupBy("source", "bin")
            .agg(F.sum("size").alias("s"))
        )
        # at most _BINS entries a source, added up in order until the target is passed
        listed = bins.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bin", "s"))).alias("bins"))
        room = F.col("target") - F.col("base") - F.col("below")
        none = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("bin"))
        fill = lambda a, x: F.when(a["bin"].isNotNull() | (a["cum"] + x["s"] <= F.col("room")), F.struct(F.when(a["bin"].isNull(), a["cum"] + x["s"]).otherwise(a["cum"]).alias("cum"), a["bin"].alias("bin"))).otherwise(F.struct(a["cum"].alias("cum"), x["bin"].cast("long").alias("bin")))
        with_bins = state.alias("a").join(listed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "bins").withColumn("room", room)
        pick = with_bins.withColumn("fit", F.aggregate(F.coalesce("bins", F.array().cast("array<struct<bin:bigint,s:bigint>>")), none, fill)).withColumn("bin", F.col("fit.bin")).withColumn("cum", F.col("fit.cum"))
        # all of them fit: the threshold is the upper end, an empty range from here on
        step = F.col("width") / _BINS
        state = materialise(
            pick.select(
                "source", "source_size", "target", "scale", "lam",
                F.when(F.col("bin").isNull(), F.col("low") + F.col("width")).otherwise(F.col("low") + F.col("bin") * step).alias("low"),
                F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(step).alias("width"),
                (F.col("below") + F.col("cum")).alias("below"), "base",
            ),
            "mix-theta",
        )
    return state.select("source", "source_size", "target", "scale", "lam", F.col("low").alias("theta"))


def _top_up(slim: DataFrame, params: DataFrame, cap: int, n_sources: int) -> DataFrame:
    """Adds ``picks``: hashes of single records, each taken once more or once less."""
    params = params.withColumn("picks", F.array().cast("array<struct<u:double,more:long>>"))
    for _ in range(_PICKS):
        rows = _joined(slim, params, n_sources).withColumn("copies", _final(cap))
        taken = materialise(rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")), "mix-taken")
        with_gap = params.alias("a").join(taken.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", (F.col("target") - F.col("taken")).alias("gap"))
        more = F.when(F.col("gap") > 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        near = F.abs(F.abs(F.col("gap")) - F.col("size"))
        best = (
            _joined(slim, with_gap, n_sources)
            .withColumn("copies", _final(cap) + more)
            .filter((F.col("copies") >= 0) & (F.col("copies") <= cap) & (F.col("size") > 0) & (near < F.abs(F.col("gap"))) & ~F.exists("picks", lambda p: p["u"] == F.col("u")))
            .groupBy("source")
            .agg(F.min(F.struct(near.alias("near"), "u", more.alias("more"))).alias("best"))
        )
        params = (
            params.alias("a").join(best.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
            .select(*[F.col(f"a.{c}") for c in params.columns if c != "picks"], F.when(F.col("best").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct(F.col("best.u").alias("u"), F.col("best.more").alias("more"))))).alias("picks"))
        )
        params = materialise(params, "mix-picks")
    return params


def _final(cap: int) -> Column:
    mine = F.filter("picks", lambda p: p["u"] == F.col("u"))
    return _copies(cap) + F.aggregate(mine, F.lit(0).cast("long"), lambda a, p: a + p["more"])


def added_names(columns: list[str]) -> dict[str, str]:
    """Names of the added columns beside ``columns``."""
    taken, names = {c.lower() for c in columns}, {}
    for name in ADDED:
        names[name] = name
        while names[name] in taken:
            names[name] = f"mix_{names[name]}"
        taken.add(names[name])
    return names


def _mixed(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 7, steps: int = 60, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row``, the input's columns, beside the columns of ``ADDED``."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]), 11) / F.lit(float(1 << 53))
    slim = materialise(docs.select(docs[source_col].alias("source"), word_count_of(docs[text_col]).alias("size"), u.alias("u")), "mix-sizes")
    hist = materialise(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sizes = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = materialise(source_targets(sizes, weights=weights, share=share, cap=cap), "mix-targets")
    n_sources = targets.count()
    solved = materialise(_solve(hist, targets, cap, steps), "mix-solved")
    params = _top_up(slim, _threshold(slim, solved, cap, n_sources), cap, n_sources)

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), word_count_of(docs[text_col]).alias("size"), u.alias("u"))
    mixed = _joined(rows, params, n_sources)
    return mixed.select("row", "size", "source_size", "target", _rate(cap).alias("rate"), _final(cap).alias("copies"), (_final(cap) * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, rate, copies and taken.

    Options are those of ``mixed_copies``.
    """
    names = added_names(docs.columns)
    return _mixed(docs, **options).select("row.*", *[F.col(c).alias(n) for c, n in names.items()])


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """Each record as often as the mix takes it, with the columns of ``docs``.

    Options: ``weights`` and ``share`` of the targets, ``cap`` of copies, ``seed``, most ``steps`` of
    Newton's iteration, and the columns ``id_col``, ``text_col``, ``source_col``.
    """
    taken = _mixed(docs, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")
