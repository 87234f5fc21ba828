"""Map projections and their inverses as column expressions, from the published formulas (Snyder, USGS PP 1395)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ellipsoid (a, e): WGS84, and a sphere of 6 370 000 m (fixed values).
WGS84, SPHERE = (6378137.0, 0.0818191908426215), (6370000.0, 0.0)


def _t(lat, e: float, m=math):
    s = m.sin(lat)
    if e == 0:
        return m.tan(math.pi / 4 - lat / 2)
    ratio = (1 - e * s) / (1 + e * s)
    return m.tan(math.pi / 4 - lat / 2) / (m.pow(ratio, e / 2))


def _m(lat: float, e: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)


class _Columns:
    sin, cos, tan = staticmethod(F.sin), staticmethod(F.cos), staticmethod(F.tan)
    pow = staticmethod(lambda b, p: F.pow(b, F.lit(float(p))))


def _xy(rho: Column, theta: Column, rho0: float = 0.0) -> tuple[Column, Column]:
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def polar_stereographic(lon: Column, lat: Column, lat_ts: float, lon_0: float, ellipsoid=WGS84) -> tuple[Column, Column]:
    """(x, y) in metres around a pole, true to scale at lat_ts (its sign gives the pole)."""
    a, e = ellipsoid
    south = lat_ts < 0
    phi_c = math.radians(abs(lat_ts))
    phi, lam = F.radians(-lat if south else lat), F.radians(lon - lon_0)
    t = _t(phi, e, _Columns)
    if abs(abs(lat_ts) - 90) < 1e-12:
        rho = 2 * a * t / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        rho = a * _m(phi_c, e) * t / _t(phi_c, e)
    return rho * F.sin(lam), (rho if south else -rho) * F.cos(lam)


def lambert_conformal(lon: Column, lat: Column, lat_1: float, lat_2: float, lat_0: float, lon_0: float, ellipsoid=SPHERE) -> tuple[Column, Column]:
    """(x, y) in metres; equal parallels make the one-parallel form."""
    a, e = ellipsoid
    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(_m(p1, e) / _m(p2, e)) / math.log(_t(p1, e) / _t(p2, e))
    f = _m(p1, e) / (n * _t(p1, e) ** n)
    rho = a * f * F.pow(_t(F.radians(lat), e, _Columns), F.lit(n))
    return _xy(rho, n * F.radians(_turned(lon - lon_0)), a * f * _t(p0, e) ** n)


def albers(lon: Column, lat: Column, lat_1: float, lat_2: float, lat_0: float, lon_0: float, ellipsoid=WGS84) -> tuple[Column, Column]:
    """(x, y) in metres of the equal-area conic."""
    a, e = ellipsoid

    def q(p, m=math, log=math.log):
        s = m.sin(p)
        return 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (_m(p1, e) ** 2 - _m(p2, e) ** 2) / (q(p2) - q(p1))
    c = _m(p1, e) ** 2 + n * q(p1)
    rho = a * F.sqrt(c - n * q(F.radians(lat), _Columns, F.log)) / n
    return _xy(rho, n * F.radians(_turned(lon - lon_0)), a * math.sqrt(c - n * q(p0)) / n)


#: Steps of the fixed-point iterations; a step gains two digits of a conformal latitude or more.
STEPS = 9


def _iterated(first: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` applied STEPS times, as one expression that does not grow with the steps."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, lambda p, _: step(p))


def _latitude_of_t(t: Column, e: float) -> Column:
    """The latitude in radians whose isometric value is t (7-9)."""
    first = math.pi / 2 - 2 * F.atan(t)
    if e == 0:
        return first

    def step(p: Column) -> Column:
        s = F.sin(p) * e
        return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))

    return _iterated(first, step)


def _latitude_of_q(q: Column, e: float) -> Column:
    """The latitude in radians of an authalic value (3-16); beyond a pole there is none."""
    if e == 0:
        return F.asin(q / 2)
    pole = 1 - (1 - e * e) / (2 * e) * math.log((1 - e) / (1 + e))

    def step(p: Column) -> Column:
        s = F.sin(p)
        u = 1 - e * e * s * s
        change = u * u / (2 * F.cos(p)) * (q / (1 - e * e) - s / u + F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        return F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), p + change))

    ends = F.when(F.abs(F.abs(q) - pole) < 1e-12, F.signum(q) * math.pi / 2)
    return ends.when(F.abs(q) < pole, _iterated(F.asin(q / 2), step))


def _turned(degrees: Column) -> Column:
    """Degrees between -180 and 180."""
    return degrees - 360 * F.floor((degrees + 180) / 360)


def polar_stereographic_inverse(x: Column, y: Column, lat_ts: float, lon_0: float, ellipsoid=WGS84) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a point of ``polar_stereographic``."""
    a, e = ellipsoid
    south, phi_c = lat_ts < 0, math.radians(abs(lat_ts))
    if abs(abs(lat_ts) - 90) < 1e-12:
        scale = 2 * a / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        scale = a * _m(phi_c, e) / _t(phi_c, e)
    rho = F.sqrt(x * x + y * y)
    lat = F.degrees(_latitude_of_t(rho / scale, e))
    lon = F.when(rho == 0, F.lit(float(lon_0))).otherwise(lon_0 + F.degrees(F.atan2(x, y if south else -y)))
    return _turned(lon), (-lat if south else lat)


def lambert_conformal_inverse(x: Column, y: Column, lat_1: float, lat_2: float, lat_0: float, lon_0: float, ellipsoid=SPHERE) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a point of ``lambert_conformal``."""
    a, e = ellipsoid
    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(_m(p1, e) / _m(p2, e)) / math.log(_t(p1, e) / _t(p2, e))
    f = _m(p1, e) / (n * _t(p1, e) ** n)
    sign, down = (1.0 if n > 0 else -1.0), a * f * _t(p0, e) ** n - y
    rho = sign * F.sqrt(x * x + down * down)
    lat = F.degrees(_latitude_of_t(F.pow(rho / (a * f), F.lit(1 / n)), e))
    return _turned(lon_0 + F.degrees(F.atan2(sign * x, sign * down)) / n), lat


def albers_inverse(x: Column, y: Column, lat_1: float, lat_2: float, lat_0: float, lon_0: float, ellipsoid=WGS84) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a point of ``albers``; null where no latitude gives the point."""
    a, e = ellipsoid
    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))

    def q(p: float) -> float:
        s = math.sin(p)
        return 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (_m(p1, e) ** 2 - _m(p2, e) ** 2) / (q(p2) - q(p1))
    c = _m(p1, e) ** 2 + n * q(p1)
    sign, down = (1.0 if n > 0 else -1.0), a * math.sqrt(c - n * q(p0)) / n - y
    rho2 = x * x + down * down
    lat = F.degrees(_latitude_of_q((c - rho2 * n * n / (a * a)) / n, e))
    return _turned(lon_0 + F.degrees(F.atan2(sign * x, sign * down)) / n), lat


_FORWARD = {"stere": polar_stereographic, "lcc": lambert_conformal, "aea": albers}
_INVERSE = {"stere": polar_stereographic_inverse, "lcc": lambert_conformal_inverse, "aea": albers_inverse}


@dataclass(frozen=True)
class Projection:
    """A coordinate system: ``kind`` longlat, stere (polar), lcc or aea with the parameters of its functions,
    false origin and metres of a unit (for longlat: degrees of a unit)."""

    kind: str
    parameters: tuple[float, ...] = ()
    ellipsoid: tuple[float, float] = WGS84
    x_0: float = 0.0
    y_0: float = 0.0
    unit: float = 1.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) of degrees."""
        if self.kind == "longlat":
            return (lon, lat) if self.unit == 1 else (lon / self.unit, lat / self.unit)
        x, y = _FORWARD[self.kind](lon, lat, *self.parameters, ellipsoid=self.ellipsoid)
        return (x / self.unit + self.x_0, y / self.unit + self.y_0)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees."""
        if self.kind == "longlat":
            return (x, y) if self.unit == 1 else (x * self.unit, y * self.unit)
        return _INVERSE[self.kind]((x - self.x_0) * self.unit, (y - self.y_0) * self.unit, *self.parameters, ellipsoid=self.ellipsoid)


def transformer(source: Projection, target: Projection) -> Callable[[Column, Column], tuple[Column, Column]]:
    """(x, y) of one system -> (x, y) of another; the identity where they are the same.

    Longitudes and latitudes pass from one ellipsoid to the other as they are (no shift of datum).
    """
    if source == target:
        return lambda x, y: (x, y)
    return lambda x, y: target.forward(*source.inverse(x, y))
