"""Closed-form map projections as column expressions: transverse Mercator and Lambert's conformal conic with two parallels.

Both directions use the ellipsoid's conformal latitude; longitudes and latitudes are degrees.  Series end with the
fourth power of the third flattening, far below a millimetre inside a zone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.operators.geometry import from_web_mercator, require_one_srid, to_web_mercator

#: Semi-major axis and inverse flattening of the two ellipsoids.
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)


def _eccentricity(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return math.sqrt(f * (2 - f))


def _isometric(phi: Column, e: float) -> Column:
    """asinh of the tangent of the conformal latitude."""
    s = F.sin(phi)
    return F.atanh(s) - F.atanh(s * e) * e


def _latitude(psi: Column, e: float) -> Column:
    """Latitude in radians of an isometric latitude; each of the fixed steps gains two digits or more."""
    phi = F.atan(F.sinh(psi))
    for _ in range(6):
        phi = F.atan(F.sinh(psi + F.atanh(F.sin(phi) * e) * e))
    return phi


@dataclass(frozen=True)
class TransverseMercator:
    """A zone of the transverse Mercator projection, in metres."""

    meridian: float
    scale: float = 0.9996
    false_x: float = 500_000.0
    false_y: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _series(self) -> tuple[float, float, list[float], list[float]]:
        a, inverse = self.ellipsoid
        n = 1 / (2 * inverse - 1)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # fixed values: the coefficients of Krueger's series
        to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return radius, _eccentricity(self.ellipsoid), to, back

    def forward(self, lon: Column, lat: Column) -> Column:
        """Struct (x, y)."""
        radius, e, to, _ = self._series()
        away, t = F.radians(lon - self.meridian), F.sinh(_isometric(F.radians(lat), e))
        xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))
        north, east = xi, eta
        for j, c in enumerate(to, 1):
            north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * c
            east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * c
        return F.struct((east * (self.scale * radius) + self.false_x).alias("x"), (north * (self.scale * radius) + self.false_y).alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        """Struct (lon, lat)."""
        radius, e, _, back = self._series()
        xi, eta = (y - self.false_y) / (self.scale * radius), (x - self.false_x) / (self.scale * radius)
        north, east = xi, eta
        for j, c in enumerate(back, 1):
            north = north - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * c
            east = east - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * c
        away = F.atan2(F.sinh(east), F.cos(north))
        psi = F.asinh(F.sin(north) / F.sqrt(F.sinh(east) * F.sinh(east) + F.cos(north) * F.cos(north)))
        return F.struct((F.degrees(away) + self.meridian).alias("lon"), F.degrees(_latitude(psi, e)).alias("lat"))


@dataclass(frozen=True)
class ConformalConic:
    """Lambert's conformal conic projection with two standard parallels; ``unit`` is its length in metres."""

    meridian: float
    origin: float
    first: float
    second: float
    false_x: float
    false_y: float = 0.0
    unit: float = 1.0
    ellipsoid: tuple[float, float] = GRS80

    def _cone(self) -> tuple[float, float, float, float]:
        a, e = self.ellipsoid[0], _eccentricity(self.ellipsoid)
        psi = lambda d: math.atanh(math.sin(math.radians(d))) - e * math.atanh(e * math.sin(math.radians(d)))
        radius = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
        n = math.log(radius(self.first) / radius(self.second)) / (psi(self.second) - psi(self.first))
        size = a * radius(self.first) * math.exp(n * psi(self.first)) / n
        return n, size, size * math.exp(-n * psi(self.origin)), e

    def forward(self, lon: Column, lat: Column) -> Column:
        """Struct (x, y)."""
        n, size, middle, e = self._cone()
        rho, turn = F.exp(_isometric(F.radians(lat), e) * -n) * size, F.radians(lon - self.meridian) * n
        return F.struct(((rho * F.sin(turn) + self.false_x) / self.unit).alias("x"), ((F.lit(middle) - rho * F.cos(turn) + self.false_y) / self.unit).alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        """Struct (lon, lat)."""
        n, size, middle, e = self._cone()
        dx, dy = x * self.unit - self.false_x, F.lit(middle) - (y * self.unit - self.false_y)
        psi = F.log(F.sqrt(dx * dx + dy * dy) / size) / -n
        return F.struct((F.degrees(F.atan2(dx, dy)) / n + self.meridian).alias("lon"), F.degrees(_latitude(psi, e)).alias("lat"))


#: UTM zone 17 north, and the southern Michigan zone of the state plane in international feet.
UTM_17N = TransverseMercator(-81.0)
MICHIGAN_SOUTH_FEET = ConformalConic(-(84 + 22 / 60), 41.5, 42.1, 43 + 40 / 60, 4_000_000.0, 0.0, 0.3048)


class Geographic:
    """Longitude and latitude themselves."""

    def forward(self, lon: Column, lat: Column) -> Column:
        return F.struct(lon.alias("x"), lat.alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat"))


class WebMercator:
    def forward(self, lon: Column, lat: Column) -> Column:
        return to_web_mercator(lon, lat)

    def inverse(self, x: Column, y: Column) -> Column:
        return from_web_mercator(x, y)


#: Reference systems by their registered numbers; others are one entry each.
SYSTEMS = {4326: Geographic(), 3857: WebMercator(), 32617: UTM_17N, 2898: MICHIGAN_SOUTH_FEET}


def align(left: DataFrame, right: DataFrame, x: str = "x", y: str = "y", srid: str = "srid") -> DataFrame:
    """The right table with its coordinates in the left table's system; each side must be of a single one that is known."""
    to, of = require_one_srid(left, srid), require_one_srid(right, srid)
    if unknown := {to, of} - set(SYSTEMS):
        raise ValueError(f"unknown reference systems: {sorted(unknown)}")
    if to == of:
        return right
    globe = SYSTEMS[of].inverse(F.col(x), F.col(y))
    there = SYSTEMS[to].forward(globe["lon"], globe["lat"])
    return right.withColumn("_there", there).withColumns({x: F.col("_there.x"), y: F.col("_there.y"), srid: F.lit(to).cast(right.schema[srid].dataType)}).drop("_there")
