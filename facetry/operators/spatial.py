"""Points on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine


def _box(lat: float, lon: float, km: float) -> Column:
    """A latitude band (and longitude band away from the poles) that holds the circle; reaches the scan as a filter."""
    d = math.degrees(km / EARTH_KM)
    keep = F.col("lat").between(lat - d, lat + d)
    if abs(lat) + d < 89:
        w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat)))))
        if lon - w >= -180 and lon + w <= 180:
            keep &= F.col("lon").between(lon - w, lon + w)
    return keep


def _from(lat: float, lon: float) -> Column:
    return haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))


def within_radius(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    if km <= 0:
        raise ValueError("a radius must be over 0")
    return points.where(_box(lat, lon, km)).withColumn("km", _from(lat, lon)).where(F.col("km") <= km)


def within_bounds(points: DataFrame, lat0: float, lon0: float, lat1: float, lon1: float) -> DataFrame:
    """Inclusive; km is the distance from the middle of the box."""
    if lat0 > lat1 or lon0 > lon1:
        raise ValueError("bounds must be in order")
    return points.where(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)).withColumn("km", _from((lat0 + lat1) / 2, (lon0 + lon1) / 2))


def nearest(points: DataFrame, lat: float, lon: float, k: int = 50) -> DataFrame:
    return points.withColumn("km", _from(lat, lon)).orderBy("km", "entity_id").limit(k)


def in_polygon(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points inside a ring of (lat, lon), by crossings; points on the ring itself are not inside."""
    crossings, on_ring = F.lit(0), F.lit(False)
    lat, lon = F.col("lat"), F.col("lon")
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        side = F.lit(d - b) * (lat - a) - (lon - b) * F.lit(c - a)  # 0 on the edge's line, else its sign tells the side
        on_ring |= (side == 0) & lat.between(min(a, c), max(a, c)) & lon.between(min(b, d), max(b, d))
        if a != c:
            hit = ((F.lit(a) > lat) != (F.lit(c) > lat)) & ((side > 0) if c > a else (side < 0))
            crossings = crossings + hit.cast("int")
    return points.where((crossings % 2 == 1) & ~on_ring)


def distance_join(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """(left, right, km) of points at most so far apart.

    Points meet by cells: latitude bands as high as the radius, each cut around the globe into cells at least as wide as a
    circle within it reaches to either side (one cell near the poles). A row of a lies in one cell; a row of b in the cells
    of three bands, and to both sides, that can hold its partners: at most nine. The exact distance follows. Cells are
    plain keys of a shuffle, so AQE can split a crowded one.
    """
    step = math.degrees(km / EARTH_KM)
    band = lambda lat: F.floor((lat + 90) / step)

    def around(band: Column) -> Column:
        """Cells of a band."""
        far = F.least(F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)), F.lit(90.0))
        width = F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(step, 90.0)))) / F.cos(F.radians(far)), F.lit(1.0))))
        return F.when(far + step >= 90, F.lit(1).cast("long")).otherwise(F.greatest(F.floor(360 / width), F.lit(1).cast("long")))

    def cell(lon: Column, band: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * around(band)), around(band))

    x = a.select(F.col("entity_id").alias("left"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), band(F.col("lat")).alias("band"))
    x = x.withColumn("cell", cell(F.col("lon1"), F.col("band")))
    y = b.select(F.col("entity_id").alias("right"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(*(band(F.col("lat")) + k for k in (-1, 0, 1)))).alias("band"))
    sides = F.array_distinct(F.array(*(F.pmod(cell(F.col("lon2"), F.col("band")) + k, around(F.col("band"))) for k in (-1, 0, 1))))
    y = y.withColumn("cell", F.explode(sides))
    d = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return x.join(y, ["band", "cell"]).where(d <= km).select("left", "right", d.alias("km"))
