"""Map projections and frames as column expressions, so that they stay in generated code.

Fixed values: the WGS 84 ellipsoid and the UTM scale, false easting and false northing.
"""

from __future__ import annotations

from math import cos, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INV_F, K0, E0 = 6378137.0, 298.257223563, 0.9996, 500000.0
_F = 1 / INV_F
E2 = _F * (2 - _F)
_N = _F / (2 - _F)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
C0 = 2 * sqrt(_N) / (1 + _N)


def utm(lat: Column, lon: Column, meridian: float) -> tuple[Column, Column]:
    """Easting and northing on the northern hemisphere (Krueger's series, third order)."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - C0 * F.atanh(C0 * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return E0 + K0 * _RADIUS * east, K0 * _RADIUS * north


def utm_inverse(east: Column, north: Column, meridian: float) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi0, eta0 = north / (K0 * _RADIUS), (east - E0) / (K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    r = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (r + alt) * F.cos(phi) * F.cos(lam), (r + alt) * F.cos(phi) * F.sin(lam), (r * (1 - E2) + alt) * F.sin(phi)


def local_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> tuple[Column, Column, Column]:
    """East, north and up from an origin."""
    x, y, z = ecef(lat, lon, alt)
    p, q = radians(lat0), radians(lon0)
    r0 = A / sqrt(1 - E2 * sin(p) ** 2)
    dx, dy, dz = x - (r0 + alt0) * cos(p) * cos(q), y - (r0 + alt0) * cos(p) * sin(q), z - (r0 * (1 - E2) + alt0) * sin(p)
    return (
        -sin(q) * dx + cos(q) * dy,
        -sin(p) * cos(q) * dx - sin(p) * sin(q) * dy + cos(p) * dz,
        cos(p) * cos(q) * dx + cos(p) * sin(q) * dy + sin(p) * dz,
    )


def in_frame(mode: str, x: Column, y: Column, z: Column, *, x0: Column, y0: Column, z0: Column, yaw0: Column) -> tuple[Column, Column, Column]:
    """Position in the ``map`` frame, or in the ``start`` frame of a run's first pose."""
    if mode == "map":
        return x, y, z
    if mode == "start":
        dx, dy = x - x0, y - y0
        return F.cos(yaw0) * dx + F.sin(yaw0) * dy, F.cos(yaw0) * dy - F.sin(yaw0) * dx, z - z0
    raise ValueError(f"unknown frame {mode!r}; map and start are known")


def utm_sql(lat: str, lon: str, meridian: float) -> tuple[str, str]:
    """The same as SQL text, for checks by another engine."""
    t = f"sinh(atanh(sin(radians({lat}))) - {C0!r} * atanh({C0!r} * sin(radians({lat}))))"
    lam = f"radians({lon} - {meridian!r})"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *(f"({a!r}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    north = " + ".join([xi, *(f"({a!r}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    return f"{E0!r} + {K0 * _RADIUS!r} * ({east})", f"{K0 * _RADIUS!r} * ({north})"


