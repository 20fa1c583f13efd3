"""Points, boxes and polygons over coordinate cells such as "51.5, -0.12"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.columns import GEO


def point(c: Column) -> Column:
    """struct<lat, lng> of a coordinate text; null if it is none."""
    part = lambda k: F.regexp_extract(c, GEO, k).try_cast("double")
    return F.when(c.rlike(GEO), F.struct(part(1).alias("lat"), part(2).alias("lng")))


def is_point(c: Column) -> Column:
    p = point(c)
    return F.coalesce(p["lat"].between(-90, 90) & p["lng"].between(-180, 180), F.lit(False))


def in_box(p: Column, min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> Column:
    """Inclusive; boxes over the antimeridian are not supported."""
    return F.coalesce(p["lat"].between(min_lat, max_lat) & p["lng"].between(min_lng, max_lng), F.lit(False))


def in_polygon(p: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lat, lng); false for fewer than three vertices.

    The ring is unrolled into one expression: an edge counts if the point's longitude is between its ends' and the
    point lies below it. Edges along a meridian never count.
    """
    if len(ring) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (a_lat, a_lng), (b_lat, b_lng) in zip(ring, [ring[-1], *ring[:-1]]):
        if a_lng == b_lng:
            continue
        between = (F.lit(float(a_lng)) > p["lng"]) != (F.lit(float(b_lng)) > p["lng"])
        slope = (b_lat - a_lat) / (b_lng - a_lng)
        inside = inside != (between & (p["lat"] < (p["lng"] - float(a_lng)) * slope + float(a_lat)))
    return F.coalesce(inside, F.lit(False))


def matches(points: Column, box: Sequence[float] | None = None, ring: Sequence[tuple[float, float]] | None = None) -> Column:
    """Whether any point of an array of coordinate texts lies in the box or in the polygon."""

    def one(x: Column) -> Column:
        p = point(x)
        tests = ([in_box(p, *box)] if box else []) + ([in_polygon(p, ring)] if ring else [])
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    return F.exists(points, one)
