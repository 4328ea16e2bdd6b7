"""One-dimensional maps: polylines, arc length, projection and curve construction.

A short polyline is an array constant of its segments, searched within each row.  A long one is an
index of blocks of neighbouring segments, held once by each Python worker and searched for a batch
of rows at a time.  Either way a projection is a map without join or shuffle.  A map comes as a Python
list, so it is of the driver's size.  Point sets of any size are joined by grid cell.

Where distances agree to nine decimals the first segment counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.storage import materialise

#: Segments up to which a polyline is an array constant.
FEW_SEGMENTS = 64
_FOOT = "dist double, i int, s double, lateral double"


def segments_of(points: Sequence[tuple[float, float]]) -> list[tuple[int, float, float, float, float, float, float]]:
    """(i, x, y, ux, uy, length, arc at start) without segments of no length."""
    out, arc = [], 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        n = hypot(x1 - x0, y1 - y0)
        if n > 0:
            out.append((len(out), float(x0), float(y0), (x1 - x0) / n, (y1 - y0) / n, n, arc))
            arc += n
    return out


class BlockIndex:
    """Segments in blocks of neighbours with a circle around each: a block further away than the
    surest block's far side cannot hold the nearest segment."""

    def __init__(self, segments: Sequence[tuple]):
        _, self.x, self.y, self.ux, self.uy, self.n, self.arc = (np.array(c, float) for c in zip(*segments, strict=True))
        count = len(self.x)
        self.width = max(16, int(count**0.5))
        first = np.arange(0, count, self.width)
        ends = np.c_[self.x, self.x + self.ux * self.n], np.c_[self.y, self.y + self.uy * self.n]
        low, high = ([f.reduceat(g(e, axis=1), first) for e in ends] for f, g in ((np.minimum, np.min), (np.maximum, np.max)))
        self.cx, self.cy = (low[0] + high[0]) / 2, (low[1] + high[1]) / 2
        self.radius = np.hypot(high[0] - low[0], high[1] - low[1]) / 2
        last = np.minimum(first + self.width, count) - 1
        self.from_arc, self.to_arc = self.arc[first], self.arc[last] + self.n[last]

    def nearest(self, px: np.ndarray, py: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, rows: int = 2048) -> tuple[np.ndarray, ...]:
        """Segment (-1: none within the window, or no number), its distance, and the unclipped way along it."""
        seg, dist, way = np.full(len(px), -1), np.full(len(px), np.nan), np.full(len(px), np.nan)
        for a in range(0, len(px), rows):
            part = slice(a, a + rows)
            window = None if lo is None else (lo[part], hi[part])
            seg[part], dist[part], way[part] = self._nearest(px[part], py[part], window)
        return seg, dist, way

    def _nearest(self, px, py, window):
        away = np.hypot(px[:, None] - self.cx, py[:, None] - self.cy)
        least, most = away - self.radius, away + self.radius
        if window is not None:
            out = (self.from_arc > window[1][:, None]) | (self.to_arc < window[0][:, None])
            least[out], most[out] = np.inf, np.inf
        sure = most.min(axis=1, keepdims=True)
        row, block = np.nonzero((least <= sure) & np.isfinite(least))
        seg, dist, way = np.full(len(px), -1), np.full(len(px), np.nan), np.full(len(px), np.nan)
        if len(row) == 0:
            return seg, dist, way
        s = block[:, None] * self.width + np.arange(self.width)
        inside = s < len(self.x)
        s = np.minimum(s, len(self.x) - 1)
        if window is not None:
            inside &= (self.arc[s] <= window[1][row, None]) & (self.arc[s] + self.n[s] >= window[0][row, None])
        rx, ry = px[row, None] - self.x[s], py[row, None] - self.y[s]
        along = rx * self.ux[s] + ry * self.uy[s]
        at = np.clip(along, 0.0, self.n[s])
        d = np.where(inside, np.round(np.hypot(rx - at * self.ux[s], ry - at * self.uy[s]), 9), np.inf)
        best = d.argmin(axis=1)  # the first of equal ones, as are blocks below
        pair = np.arange(len(row))
        order = np.lexsort((pair, d[pair, best], row))
        head = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        head = head[np.isfinite(d[head, best[head]])]
        found = s[head, best[head]]
        seg[row[head]], dist[row[head]], way[row[head]] = found, d[head, best[head]], along[head, best[head]]
        return seg, dist, way

    def feet(self, px: np.ndarray, py: np.ndarray, beyond: bool, lo=None, hi=None) -> pd.DataFrame:
        seg, dist, way = self.nearest(px, py, lo, hi)
        k = np.maximum(seg, 0)
        side = (py - self.y[k]) * self.ux[k] - (px - self.x[k]) * self.uy[k]
        outside = beyond & (((seg == 0) & (way < 0)) | ((seg == len(self.x) - 1) & (way > self.n[k])))
        s = self.arc[k] + np.where(outside, way, np.clip(way, 0.0, self.n[k]))
        out = pd.DataFrame({"dist": np.where(outside, np.abs(side), dist), "i": pd.array(seg, "Int32"), "s": s, "lateral": side})
        out.loc[seg < 0, :] = None
        return out


def _constant(segments: Sequence[tuple]) -> Column:
    names = ("i", "x", "y", "ux", "uy", "n", "arc")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, s, strict=True)]) for s in segments])


def _foot(x: Column, y: Column, s: Column) -> Column:
    """Distance and order of a segment, then the way along its line, its place and the side."""
    along = (x - s["x"]) * s["ux"] + (y - s["y"]) * s["uy"]
    side = (y - s["y"]) * s["ux"] - (x - s["x"]) * s["uy"]
    u = F.least(F.greatest(along, F.lit(0.0)), s["n"])
    dx, dy = x - s["x"] - u * s["ux"], y - s["y"] - u * s["uy"]
    return F.struct(F.round(F.sqrt(dx * dx + dy * dy), 9).alias("dist"), s["i"].alias("i"), along.alias("along"), s["arc"].alias("arc"), s["n"].alias("n"), side.alias("lateral"))


def _placed(hit: Column, last: int, beyond: bool) -> Column:
    """The foot on the nearest segment; past an end of the line it lies on the end's prolongation."""
    outside = ((hit["i"] == 0) & (hit["along"] < 0)) | ((hit["i"] == last) & (hit["along"] > hit["n"]))
    outside = outside if beyond else F.lit(False)
    u = F.least(F.greatest(hit["along"], F.lit(0.0)), hit["n"])
    return F.struct(F.when(outside, F.abs(hit["lateral"])).otherwise(hit["dist"]).alias("dist"), hit["i"].alias("i"), (hit["arc"] + F.when(outside, hit["along"]).otherwise(u)).alias("s"), hit["lateral"].alias("lateral"))


def _indexed(df: DataFrame, table: Sequence[tuple], x: str, y: str, beyond: bool, lo: Column | None, hi: Column | None) -> Column:
    index, windowed = df.sparkSession.sparkContext.broadcast(BlockIndex(table)), lo is not None

    @F.pandas_udf(_FOOT)
    def search(px: pd.Series, py: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        window = (a.to_numpy(float), b.to_numpy(float)) if windowed else ()
        return index.value.feet(px.to_numpy(float), py.to_numpy(float), beyond, *window)

    none = F.lit(0.0)
    return search(F.col(x).cast("double"), F.col(y).cast("double"), none if lo is None else lo.cast("double"), none if hi is None else hi.cast("double"))


def project(df: DataFrame, points: Sequence[tuple[float, float]], *, x: str = "x", y: str = "y", beyond: bool = True, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Adds ``foot`` (dist, i, s, lateral): the nearest point of the polyline, and ``beyond``.

    The nearest segment is that of least distance to the line itself.  With ``beyond`` a foot at an
    open end moves on to the end's prolongation.  ``lo`` and ``hi`` limit the search to segments that
    touch that range of arc length; ``foot`` is null if there is none.
    """
    table = segments_of(points)
    last, length = len(table) - 1, table[-1][5] + table[-1][6]
    windowed = lo is not None and hi is not None
    if len(table) > FEW_SEGMENTS:
        foot = _indexed(df, table, x, y, beyond, lo if windowed else None, hi if windowed else None)
        found = df.withColumn("foot", foot).withColumn("foot", F.when(F.col("foot.i").isNotNull(), F.col("foot")))
    else:
        searched = _constant(table)
        if windowed:
            searched = F.filter(searched, lambda s: (s["arc"] <= hi) & (s["arc"] + s["n"] >= lo))
        hit = F.array_min(F.transform(searched, lambda s: _foot(F.col(x), F.col(y), s)))
        found = df.withColumn("__hit", hit).withColumn("foot", F.when(F.col("__hit").isNotNull(), _placed(F.col("__hit"), last, beyond))).drop("__hit")
    return found.withColumn("beyond", (F.col("foot.s") < 0) | (F.col("foot.s") > length))


def project_by_vertex(df: DataFrame, points: Sequence[tuple[float, float]], *, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``foot``: the better of the two segments at the nearest ``vertex``, the first of two equal ones."""
    table = segments_of(points)
    if len(points) > FEW_SEGMENTS:
        index = df.sparkSession.sparkContext.broadcast((BlockIndex([(i, px, py, 0.0, 0.0, 0.0, 0.0) for i, (px, py) in enumerate(points)]), table))

        @F.pandas_udf(f"vertex int, {_FOOT}")
        def search(px: pd.Series, py: pd.Series) -> pd.DataFrame:
            vertices, segs = index.value
            a, b = px.to_numpy(float), py.to_numpy(float)
            v, _, _ = vertices.nearest(a, b)
            cols = np.array(segs, float)
            best = None
            for k in (np.clip(v - 1, 0, len(segs) - 1), np.clip(v, 0, len(segs) - 1)):
                _, sx, sy, ux, uy, n, arc = cols[k].T
                u = np.clip((a - sx) * ux + (b - sy) * uy, 0.0, n)
                new = np.c_[np.round(np.hypot(a - sx - u * ux, b - sy - u * uy), 9), k, arc + u, (b - sy) * ux - (a - sx) * uy]
                best = new if best is None else np.where((new[:, 0] < best[:, 0])[:, None], new, best)
            out = pd.DataFrame({"vertex": pd.array(v, "Int32"), "dist": best[:, 0], "i": pd.array(best[:, 1].astype(int), "Int32"), "s": best[:, 2], "lateral": best[:, 3]})
            out.loc[v < 0, :] = None
            return out

        found = df.withColumn("__f", search(F.col(x).cast("double"), F.col(y).cast("double")))
        return found.withColumn("vertex", F.col("__f.vertex")).withColumn("foot", F.struct(*[F.col(f"__f.{c}").alias(c) for c in ("dist", "i", "s", "lateral")])).drop("__f")
    vertices = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for i, (a, b) in enumerate(points)])
    square = lambda v: (F.col(x) - v["x"]) * (F.col(x) - v["x"]) + (F.col(y) - v["y"]) * (F.col(y) - v["y"])
    near = F.array_min(F.transform(vertices, lambda v: F.struct(F.round(square(v), 9).alias("d"), v["i"].alias("i"))))["i"]
    two = F.filter(_constant(table), lambda s: (s["i"] == F.col("__v")) | (s["i"] == F.col("__v") - 1))
    hit = F.array_min(F.transform(two, lambda s: _foot(F.col(x), F.col(y), s)))
    return df.withColumn("__v", near).withColumn("__hit", hit).withColumn("foot", _placed(F.col("__hit"), len(table) - 1, False)).drop("__hit").withColumnRenamed("__v", "vertex")


def nearest_point(df: DataFrame, points: DataFrame, *, radius: float | None = None, cell: float | None = None, x: str = "x", y: str = "y", point_id: str = "point", row_id: str = "row") -> DataFrame:
    """``row, point, dist`` of the nearest point for every row: equality joins on grid cells.

    Each point stands in its cell and the eight around it, so that a search is exact up to a cell's
    width.  Rows without a point so near are searched again with cells four times as wide.  With
    ``radius`` the first search is the last.  Null where no point is found or a coordinate is null.
    """
    width = cell or radius
    if not width or width <= 0:
        raise ValueError("give a radius, or the width of the first cells")
    if radius is not None:
        width = radius
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spots = points.select(F.col(point_id).alias("point"), F.col(x).alias("px"), F.col(y).alias("py")).filter("px is not null and py is not null")
    rows = df.select(F.col(row_id).alias("row"), F.col(x).alias("x"), F.col(y).alias("y"))
    bounds = [c for a, n in (("min", "lo"), ("max", "hi")) for c in (F.expr(f"{a}(x) {n}x"), F.expr(f"{a}(y) {n}y"))]
    ends = spots.select(F.col("px").alias("x"), F.col("py").alias("y")).union(rows.select("x", "y")).agg(*bounds).first()
    reach = 0.0 if ends["lox"] is None or ends["loy"] is None else hypot(ends["hix"] - ends["lox"], ends["hiy"] - ends["loy"])
    parts = []
    while True:
        at = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: B023, E731
        spread = spots.select("point", "px", "py", at("px").alias("cx"), at("py").alias("cy"), F.explode(around).alias("o"))
        spread = spread.select("point", "px", "py", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
        met = rows.join(spread.withColumnsRenamed({"cx": "__cx", "cy": "__cy"}), (at("x") == F.col("__cx")) & (at("y") == F.col("__cy")))
        found = met.withColumn("dist", F.round(d, 9)).filter(F.col("dist") <= width).groupBy("row").agg(F.min(F.struct("dist", "point")).alias("m"))
        found = materialise(found.select("row", F.col("m.point").alias("point"), F.col("m.dist").alias("dist")), "nearest-found")
        parts.append(found)
        rows = materialise(rows.join(found.select("row"), "row", "left_anti"), "nearest-left")
        if radius is not None or width > reach or rows.isEmpty():
            break
        width *= 4
    out = rows.select("row", F.lit(None).cast(points.schema[point_id].dataType).alias("point"), F.lit(None).cast("double").alias("dist"))
    for part in parts:
        out = out.unionByName(part)
    return out


def pose_at(df: DataFrame, points: Sequence[tuple[float, float]], *, s: str = "s") -> DataFrame:
    """Adds ``px, py`` at arc length ``s``, held at the ends."""
    table = segments_of(points)
    length = table[-1][5] + table[-1][6]
    at = F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(length))
    if len(table) > FEW_SEGMENTS:
        columns = df.sparkSession.sparkContext.broadcast(np.array(table, float))

        @F.pandas_udf("px double, py double")
        def look_up(way: pd.Series) -> pd.DataFrame:
            w = way.to_numpy(float)
            k = np.clip(np.searchsorted(columns.value[:, 6], w, side="right") - 1, 0, len(columns.value) - 1)
            _, gx, gy, ux, uy, _, arc = columns.value[k].T
            return pd.DataFrame({"px": gx + (w - arc) * ux, "py": gy + (w - arc) * uy})

        return df.withColumn("__p", look_up(at.cast("double"))).withColumn("px", F.col("__p.px")).withColumn("py", F.col("__p.py")).drop("__p")
    seg = F.element_at(F.filter(_constant(table), lambda g: g["arc"] <= F.col("__at")), -1)
    d = df.withColumn("__at", at).withColumn("__g", seg)
    u = F.col("__at") - F.col("__g.arc")
    return d.withColumn("px", F.col("__g.x") + u * F.col("__g.ux")).withColumn("py", F.col("__g.y") + u * F.col("__g.uy")).drop("__at", "__g")


def hermite(u: Column, p0: float, m0: float, p1: float, m1: float) -> Column:
    """Cubic with given ends and end slopes, u from 0 to 1."""
    return (2 * u * u * u - 3 * u * u + 1) * p0 + (u * u * u - 2 * u * u + u) * m0 + (3 * u * u - 2 * u * u * u) * p1 + (u * u * u - u * u) * m1
