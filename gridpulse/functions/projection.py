"""Inverse transverse Mercator as column arithmetic (the usual series in the literature on map projections)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Projection constants; the defaults are those published for EPSG:3115 on the GRS80 ellipsoid."""

    latitude: float = 4.596200416666666
    longitude: float = -77.07750791666666
    scale: float = 1.0
    east: float = 1_000_000.0
    north: float = 1_000_000.0
    axis: float = 6_378_137.0
    inverse_flattening: float = 298.257222101

    @property
    def ecc(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def arc(self, phi: float) -> float:
        """Meridian arc from the equator to ``phi`` (radians)."""
        from math import sin

        e = self.ecc
        return self.axis * (
            (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * phi
            - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * sin(2 * phi)
            + (15 * e**2 / 256 + 45 * e**3 / 1024) * sin(4 * phi)
            - (35 * e**3 / 3072) * sin(6 * phi)
        )


def to_lon_lat(x: Column, y: Column, crs: TransverseMercator = TransverseMercator()) -> tuple[Column, Column]:
    """Longitude and latitude in degrees from projected easting and northing."""
    from math import radians, sqrt

    e = crs.ecc
    ep = e / (1 - e)
    e1 = (1 - sqrt(1 - e)) / (1 + sqrt(1 - e))
    arc = F.lit(crs.arc(radians(crs.latitude))) + (y - crs.north) / crs.scale
    mu = arc / (crs.axis * (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256))
    foot = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    sine2 = F.pow(F.sin(foot), 2)
    c = ep * F.pow(F.cos(foot), 2)
    t = F.pow(F.tan(foot), 2)
    n = crs.axis / F.sqrt(1 - e * sine2)
    r = crs.axis * (1 - e) / F.pow(1 - e * sine2, 1.5)
    d = (x - crs.east) / (n * crs.scale)
    lat = foot - (n * F.tan(foot) / r) * (
        F.pow(d, 2) / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(d, 6) / 720
    )
    lon = (
        d - (1 + 2 * t + c) * F.pow(d, 3) / 6
        + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(d, 5) / 120
    ) / F.cos(foot)
    return F.degrees(lon) + crs.longitude, F.degrees(lat)
