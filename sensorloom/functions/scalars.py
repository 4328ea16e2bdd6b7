"""Column expressions of single rows: cleaning, unit scales, curves and classifications.

NaN becomes null on the way in (``finite``), since comparisons with NaN differ between engines.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null if it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def scaled(raw: Column, scale: float | Column) -> Column:
    return F.greatest(raw, F.lit(0.0)) / scale


def valid_sample(v: Column, *, low: float = -5.0, high: float = 100.0) -> Column:
    return F.coalesce(finite(v).between(low, high), F.lit(False))


def valid_fix(lat: Column, lon: Column, status: Column, t: Column) -> Column:
    inside = (F.abs(finite(lat)) <= 84) & (F.abs(finite(lon)) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce((status >= 0) & inside & (t > 0), F.lit(False))


def valid_stamp(t: Column) -> Column:
    return F.coalesce(t > 0, F.lit(False))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def yaw_quaternion(yaw: Column) -> tuple[Column, Column]:
    """z and w of the rotation about the vertical."""
    return F.sin(yaw / 2), F.cos(yaw / 2)


def rotated_covariance(va: Column, vc: Column, yaw: Column) -> tuple[Column, Column, Column]:
    """xx, xy, yy of a covariance given along and across; negative counts as 0, unknown as 1e6."""
    clean = lambda v: F.when(finite(v).isNull(), 1e6).otherwise(F.greatest(v, F.lit(0.0)))
    a, b, c, s = clean(va), clean(vc), F.cos(yaw), F.sin(yaw)
    return a * c * c + b * s * s, (a - b) * c * s, a * s * s + b * c * c


def traction(v: Column, notch: Column, *, b0: float, a0: float, v1: float, va: float, top: float, vb: float, power: float, r0: float) -> Column:
    rising = b0 + a0 * notch / (1 + F.greatest(v - v1, F.lit(0.0)) / va)
    limit = top * F.pow(F.when(v > vb, vb / v).otherwise(1.0), F.lit(power))
    return F.least(rising, limit) - r0


def braking(v: Column, notch: Column, *, d0: float, d1: float, fade: float, vf: float, cap: float, r0: float, hold_notch: int = -8, hold_speed: float = 2.5, hold_accel: float = -0.85) -> Column:
    usual = F.greatest(-(d0 + d1 * F.abs(notch)) * (1 - fade * F.exp(-v / vf)), F.lit(cap)) - r0
    return F.when(notch == hold_notch, F.when(v > hold_speed, 0.0).otherwise(hold_accel)).otherwise(usual)


def drive_mode(notch: Column, v: Column, *, still: float = 0.05, hold_notch: int = -8) -> Column:
    return (
        F.when(notch.isNull(), "nocmd").when((v < still) & (notch <= 0), "standstill").when(notch > 0, "traction")
        .when(notch == hold_notch, "hold").when(notch < 0, "brake").otherwise("coast")
    )


def model_sigma(notch: Column, *, usual: float = 0.15, hard: float = 0.3, unknown: float = 0.5, hard_notch: int = -9) -> Column:
    return F.when(notch.isNull(), unknown).when(notch <= hard_notch, hard).otherwise(usual)


def regime(accel: Column, speed: Column, *, edge: float = 0.15, still: float = 0.1) -> Column:
    """Standing still is tested first."""
    return F.when(speed < still, "stopped").when(accel > edge, "accel").when(accel < -edge, "brake").otherwise("cruise")


def smoothstep(x: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return u * u * (3 - 2 * u)


def hat_weights(x: Column, step: float) -> Column:
    """Two (node, weight) structs whose weights add up to 1."""
    k = F.floor(x / step)
    w = x / step - k
    return F.array(F.struct(k.alias("node"), (1 - w).alias("weight")), F.struct((k + 1).alias("node"), w.alias("weight")))


def arc_point(s: Column, yaw: Column, curvature: Column) -> tuple[Column, Column]:
    """Offset after ``s`` along a circle (a straight line for tiny curvature)."""
    bent = F.abs(curvature) > 1e-9
    x = F.when(bent, (F.sin(yaw + curvature * s) - F.sin(yaw)) / curvature).otherwise(s * F.cos(yaw))
    y = F.when(bent, (F.cos(yaw) - F.cos(yaw + curvature * s)) / curvature).otherwise(s * F.sin(yaw))
    return x, y


def headings_agree(a: Column, b: Column, limit_deg: float = 60.0) -> Column:
    return F.cos(a - b) > F.cos(F.radians(F.lit(limit_deg)))


def slip_ratio(front: Column, rear: Column, v: Column, floor: float = 1.0) -> tuple[Column, Column, Column]:
    d = F.greatest(v, F.lit(floor))
    return (front - v) / d, (rear - v) / d, (front - rear) / d


def adhesion(accel: Column) -> Column:
    return F.abs(accel) / 9.81
