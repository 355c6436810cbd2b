"""Distance joins as equi-joins on grid cells.

A plain distance condition would be a nested loop. Here one side is copied to the 3 x 3 cells
around it, both sides meet on the cell, and the exact distance decides. Inputs are distinct
places (postcodes, stations), so a crowded cell holds few rows whatever the sales in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspan.functions.rank import first_k

KM_LAT = 110.574
KM_LNG = 111.320


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the unit of `radius` (6371 or 6371.0088 km, 3958.8 miles)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance with the longitude scale taken at the first point."""
    dy = (lat2 - lat1) * KM_LAT
    dx = (lon2 - lon1) * (F.lit(KM_LNG) * F.cos(F.radians(lat1)))
    return F.sqrt(dy * dy + dx * dx)


def walk_minutes(km: Column, detour: float = 1.3, kmh: float = 5.0) -> Column:
    return km * detour / kmh * 60


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def _cell_sizes(km: float, max_lat: float) -> tuple[float, float]:
    """Degrees of a cell at least `km` high and, up to `max_lat`, wide."""
    return km / KM_LAT * 1.01, km / (KM_LNG * math.cos(math.radians(max_lat))) * 1.01


def grid(lat: Column, lon: Column, km: float, max_lat: float = 60.0) -> tuple[Column, Column]:
    """The cell of a point: what is within `km` of it lies there or in one of the eight cells around."""
    lat_size, lng_size = _cell_sizes(km, max_lat)
    return _cell(lat, lat_size), _cell(lon, lng_size)


def near(left: DataFrame, right: DataFrame, lat_size: float, lng_size: float) -> DataFrame:
    """Candidate pairs: right rows in the cell of a left row or one of its eight neighbours.

    left has lat, lon; right has r_lat, r_lon. The right side is copied nine times, so give the
    smaller table on the right.
    """
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    spread = (
        right.withColumn("_dy", F.explode(steps))
        .withColumn("_dx", F.explode(steps))
        .withColumn("_cy", _cell(F.col("r_lat"), lat_size) + F.col("_dy"))
        .withColumn("_cx", _cell(F.col("r_lon"), lng_size) + F.col("_dx"))
        .drop("_dy", "_dx")
    )
    placed = left.withColumn("_cy", _cell(F.col("lat"), lat_size)).withColumn("_cx", _cell(F.col("lon"), lng_size))
    return placed.join(spread, ["_cy", "_cx"]).drop("_cy", "_cx")


def within_km(left: DataFrame, right: DataFrame, km: float, distance=planar_km, max_lat: float = 60.0) -> DataFrame:
    """All (left, right) pairs no further apart than `km`, with the distance."""
    pairs = near(left, right, *_cell_sizes(km, max_lat))
    pairs = pairs.withColumn("km", distance(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return pairs.where(F.col("km") <= km)


def within_box(left: DataFrame, right: DataFrame, lat_half: float, lng_half: float) -> DataFrame:
    """Pairs whose coordinates differ by no more than the half sides."""
    pairs = near(left, right, lat_half * 1.01, lng_half * 1.01)
    return pairs.where((F.abs(F.col("lat") - F.col("r_lat")) <= lat_half) & (F.abs(F.col("lon") - F.col("r_lon")) <= lng_half))


def k_nearest_places(left: DataFrame, right: DataFrame, keys: list[str], k: int, km: float, tie: list[str]) -> DataFrame:
    """k nearest right rows of each left row within `km`."""
    return first_k(within_km(left, right, km), keys, ["km", *tie], k)
