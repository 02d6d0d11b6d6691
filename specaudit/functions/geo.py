"""Geometry on a sphere and small order statistics, as Column expressions.  Points are ``struct<lat, lon>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def distance_m(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    h = F.pow(F.sin(F.radians(b_lat - a_lat) / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(F.sin(F.radians(b_lon - a_lon) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(b_lon - a_lon)
    y = F.sin(d) * F.cos(F.radians(b_lat))
    x = F.cos(F.radians(a_lat)) * F.sin(F.radians(b_lat)) - F.sin(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, metres: Column) -> Column:
    """Point reached from a start along a heading."""
    d, h, a = metres / EARTH_M, F.radians(heading), F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(h))
    over = F.radians(lon) + F.atan2(F.sin(h) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(over).alias("lon"))


def heading_difference(a: Column, b: Column) -> Column:
    """0 to 180 degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def undirected_difference(a: Column, b: Column) -> Column:
    d = heading_difference(a, b)
    return F.least(d, F.abs(180.0 - d))


def segments(points: Column) -> Column:
    """Consecutive pairs of a polyline."""
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polyline_distance_m(lat: Column, lon: Column, points: Column) -> Column:
    """Distance of a point to a polyline on a local plane; a lone vertex counts as a point."""
    kx, ky = F.cos(F.radians(lat)) * F.radians(F.lit(1.0)) * EARTH_M, F.radians(F.lit(1.0)) * EARTH_M

    def to_segment(s: Column) -> Column:
        ax, ay = (s["a"]["lon"] - lon) * kx, (s["a"]["lat"] - lat) * ky
        bx, by = (s["b"]["lon"] - lon) * kx, (s["b"]["lat"] - lat) * ky
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    first = F.get(points, F.lit(0))
    return F.coalesce(F.array_min(F.transform(segments(points), lambda s: to_segment(s))), distance_m(lat, lon, first["lat"], first["lon"]))


def upper_median(name: str) -> Column:
    """Aggregate: the element at position n // 2 of the sorted values; merges counts of values, not lists."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def nearest_rank(name: str, share: float) -> Column:
    """Aggregate: the value at rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{name}`)")


def terrain(cross_slope_percent: Column) -> Column:
    return F.when(cross_slope_percent < 10, "plain").when(cross_slope_percent < 25, "rolling").when(cross_slope_percent < 40, "mountainous").when(cross_slope_percent.isNotNull(), "steep").otherwise("unknown")
