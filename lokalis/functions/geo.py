"""Distances, local planes, screen geometry and quadtree cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lokalis.operators.spatial import great_circle_m

# Two radii and two planar scales, used in different places.
EARTH_KM = 6371.0088
EARTH_ROUND_M = 6_371_000.0
M_PER_DEG_LAT, M_PER_DEG_LNG = 110_540.0, 111_320.0
# The captured screen.
MAP_CENTRE = (450, 750)
HALF_WIDTH, HALF_HEIGHT = 450, 662
OVERLAP = 0.15


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    return great_circle_m(lat1, lng1, lat2, lng2, EARTH_KM)


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """With the round radius that distance checks of matched pages use."""
    return great_circle_m(lat1, lng1, lat2, lng2, EARTH_ROUND_M)


def planar_offset(lat1, lng1, lat2, lng2) -> Column:
    """(east, north) metres from the first point to the second, one scale on both axes."""
    return F.struct(((lng2 - lng1) * M_PER_DEG_LNG * F.cos(F.radians(lat1))).alias("east"), ((lat2 - lat1) * M_PER_DEG_LNG).alias("north"))


def to_local(lat, lng, lat0, lng0) -> Column:
    """(e, n) metres in the plane at an origin."""
    return F.struct(((lng - lng0) * M_PER_DEG_LNG * F.cos(F.radians(lat0))).alias("e"), ((lat - lat0) * M_PER_DEG_LAT).alias("n"))


def from_local(e, n, lat0, lng0) -> Column:
    return F.struct((lat0 + n / M_PER_DEG_LAT).alias("lat"), (lng0 + e / (M_PER_DEG_LNG * F.cos(F.radians(lat0)))).alias("lng"))


def degrees_lat(pixels, m_per_px) -> Column:
    return pixels * m_per_px / M_PER_DEG_LAT


def degrees_lng(pixels, m_per_px, at_lat) -> Column:
    return pixels * m_per_px / (M_PER_DEG_LNG * F.cos(F.radians(at_lat)))


def pixel_to_point(x, y, lat0, lng0, m_per_px) -> Column:
    """A screen position as (lat, lng); the screen's y grows downwards."""
    return F.struct((lat0 - degrees_lat(y - MAP_CENTRE[1], m_per_px)).alias("lat"), (lng0 + degrees_lng(x - MAP_CENTRE[0], m_per_px, lat0)).alias("lng"))


def viewport_cell(lat0, lng0, m_per_px) -> Column:
    """The rectangle that the screen shows."""
    w, h = degrees_lng(F.lit(HALF_WIDTH), m_per_px, lat0), degrees_lat(F.lit(HALF_HEIGHT), m_per_px)
    return F.struct((lng0 - w).alias("left"), (lng0 + w).alias("right"), (lat0 - h).alias("bottom"), (lat0 + h).alias("top"))


def quarters(cell: Column, overlap: float = OVERLAP) -> Column:
    """The four quarters of a cell, each grown over the middle lines by a share of its side; to be exploded."""
    l, r, b, t = (cell[k] for k in ("left", "right", "bottom", "top"))
    mx, my, ox, oy = (l + r) / 2, (b + t) / 2, (r - l) / 2 * overlap, (t - b) / 2 * overlap
    box = lambda x0, x1, y0, y1: F.struct(x0.alias("left"), x1.alias("right"), y0.alias("bottom"), y1.alias("top"))
    return F.array(box(l, mx + ox, b, my + oy), box(mx - ox, r, b, my + oy), box(l, mx + ox, my - oy, t), box(mx - ox, r, my - oy, t))


def in_box(lat, lng, south, north, west, east) -> Column:
    """Whether a point is inside; an unknown box holds everything."""
    unknown = south.isNull() | north.isNull() | west.isNull() | east.isNull()
    return unknown | F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def radius_side(lat, lng, lat0, lng0, radius: float) -> Column:
    """`kept`, `dropped` or `unplaceable` (no point: never dropped); the border counts as inside."""
    if radius <= 0:
        raise ValueError("a radius must be above 0")
    km = haversine_km(lat, lng, lat0, lng0)
    return F.when(km.isNull(), "unplaceable").when(km <= radius, "kept").otherwise("dropped")


def apply_similarity(lat, lng, lat0, lng0, a_re, a_im, b_e, b_n) -> Column:
    """A point moved by the similarity z -> a z + b of the plane at an origin."""
    p = to_local(lat, lng, lat0, lng0)
    return from_local(a_re * p["e"] - a_im * p["n"] + b_e, a_im * p["e"] + a_re * p["n"] + b_n, lat0, lng0)
