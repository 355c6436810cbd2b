"""Angles, compass words, national grid and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def circular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def compass_bin(theta: Column) -> Column:
    """Nearest of eight directions."""
    at = F.pmod(F.floor(F.pmod(theta, F.lit(360.0)) / 45.0 + 0.5).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(w) for w in COMPASS]), at + 1)


def compass_set(theta: Column, margin: float) -> Column:
    """The nearest direction, and its neighbour too within `margin` degrees of the boundary."""
    near = F.pmod(theta, F.lit(360.0)) / 45.0
    at = F.floor(near + 0.5)
    off = (near - at) * 45.0
    words = F.array(*[F.lit(w) for w in COMPASS])
    own = F.element_at(words, F.pmod(at.cast("int"), F.lit(8)) + 1)
    side = F.pmod((at + F.when(off >= 0, 1).otherwise(-1)).cast("int"), F.lit(8)) + 1
    return F.when(F.abs(off) > 22.5 - margin, F.array_sort(F.array(own, F.element_at(words, side)))).otherwise(F.array(own))


def facing_matches(value: str, col: Column) -> Column:
    """A cardinal includes its compounds; a compound matches itself only."""
    if value in ("north", "south"):
        return (col == value) | col.startswith(value + "-")
    if value in ("east", "west"):
        return (col == value) | col.endswith("-" + value)
    return col == value


def facings_agree(stated: Column, derived: Column) -> Column:
    """Stated word and any derived word within 45 degrees of each other; NULL if either is missing."""
    words = F.split(stated, "-")

    def close(w: Column) -> Column:
        other = F.split(w, "-")
        either = (F.size(words) == 1) & F.array_contains(other, stated) | (F.size(other) == 1) & F.array_contains(words, w)
        return (w == stated) | either

    return F.when(stated.isNotNull() & (F.size(derived) > 0), F.exists(derived, close))


def square_box(lat: Column, lng: Column, side_km: float = 1.0) -> Column:
    """Corners of a square around a point."""
    dlat = side_km / 2 / 111.0
    dlng = F.lit(side_km / 2) / (F.lit(111.0) * F.cos(F.radians(lat)))
    return F.struct((lat - dlat).alias("south"), (lng - dlng).alias("west"), (lat + dlat).alias("north"), (lng + dlng).alias("east"))


# Airy 1830 ellipsoid and national-grid projection.
AIRY_A, AIRY_B, SCALE = 6377563.396, 6356256.909, 0.9996012717
LAT0, LON0, NORTH0, EAST0 = math.radians(49), math.radians(-2), -100000.0, 400000.0


def grid_to_lonlat(easting: Column, northing: Column, rounds: int = 5) -> Column:
    """Struct (lat, lon) of a grid reference. The latitude series converges below a millimetre in five rounds."""
    e2 = 1 - AIRY_B**2 / AIRY_A**2
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    c = (1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * (n**2 + n**3), 35 / 24 * n**3)

    def arc(lat: Column) -> Column:
        d, s = lat - LAT0, lat + LAT0
        return F.lit(AIRY_B * SCALE) * (
            c[0] * d - c[1] * F.sin(d) * F.cos(s) + c[2] * F.sin(2 * d) * F.cos(2 * s) - c[3] * F.sin(3 * d) * F.cos(3 * s)
        )

    # transform over a one-element array names each step once, so the expression stays linear in size
    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def refine(lat: Column) -> Column:
        return bind(lat, lambda x: x + (northing - NORTH0 - arc(x)) / (AIRY_A * SCALE))

    lat = (northing - NORTH0) / (AIRY_A * SCALE) + LAT0
    for _ in range(rounds):
        lat = refine(lat)

    def finish(phi: Column) -> Column:
        w = 1 - e2 * F.pow(F.sin(phi), 2)
        nu = F.lit(AIRY_A * SCALE) / F.sqrt(w)
        rho = F.lit(AIRY_A * SCALE * (1 - e2)) / F.pow(w, 1.5)
        eta2, t, sec, d = nu / rho - 1, F.tan(phi), 1 / F.cos(phi), easting - EAST0
        lat_out = (
            phi - t / (2 * rho * nu) * F.pow(d, 2)
            + t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t * t + eta2 - 9 * t * t * eta2) * F.pow(d, 4)
            - t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t * t + 45 * F.pow(t, 4)) * F.pow(d, 6)
        )
        lon_out = (
            LON0 + sec / nu * d - sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t * t) * F.pow(d, 3)
            + sec / (120 * F.pow(nu, 5)) * (5 + 28 * t * t + 24 * F.pow(t, 4)) * F.pow(d, 5)
            - sec / (5040 * F.pow(nu, 7)) * (61 + 662 * t * t + 1320 * F.pow(t, 4) + 720 * F.pow(t, 6)) * F.pow(d, 7)
        )
        return F.struct(F.degrees(lat_out).alias("lat"), F.degrees(lon_out).alias("lon"))

    return bind(lat, finish)
