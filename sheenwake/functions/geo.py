"""Distances, bearings and local projections as Column expressions."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius (km), km per degree of latitude, km per nautical mile.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEG = 111.32
KM_PER_NM = 1.852


def col(x) -> Column:
    """A Column from a name, a number or a Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x, lo, hi) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(x)))


def wrap(x, period: float) -> Column:
    """Floored modulo, so that the result lies in [0, period)."""
    return F.pmod(col(x), F.lit(float(period)))


def km_per_deg_lon(lat) -> Column:
    return F.lit(KM_PER_DEG) * F.cos(F.radians(col(lat)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    sin_lat = F.sin((p2 - p1) / 2)
    sin_lon = F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    a = sin_lat * sin_lat + F.cos(p1) * F.cos(p2) * sin_lon * sin_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamp(a, 0, 1)))


def np_haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    """``haversine_km`` of arrays; from or to an unknown place it is half the way round, as there."""
    p1, p2 = np.deg2rad(lat1), np.deg2rad(lat2)
    sin_lat, sin_lon = np.sin((p2 - p1) / 2), np.sin(np.deg2rad(lon2 - lon1) / 2)
    a = sin_lat * sin_lat + np.cos(p1) * np.cos(p2) * sin_lon * sin_lon
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.fmax(0.0, np.fmin(1.0, a))))


def local_km(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """(east, north) km about a reference point."""
    return ((col(lon) - col(lon0)) * km_per_deg_lon(lat0),
            (col(lat) - col(lat0)) * KM_PER_DEG)


def from_local_km(east, north, lat0, lon0) -> tuple[Column, Column]:
    """(lat, lon) of a point given in km about a reference point."""
    return (col(lat0) + col(north) / KM_PER_DEG,
            col(lon0) + col(east) / km_per_deg_lon(lat0))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return wrap(F.degrees(F.atan2(east, north)), 360)


def destination(lat, lon, bearing, dist_km) -> tuple[Column, Column]:
    """(lat, lon) reached on a bearing after a distance; lon in [-180, 180)."""
    d, b = col(dist_km) / EARTH_RADIUS_KM, F.radians(col(bearing))
    p1 = F.radians(col(lat))
    sin_p2 = F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b)
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * sin_p2)
    lon2 = F.degrees(F.radians(col(lon)) + turn)
    return F.degrees(F.asin(sin_p2)), wrap(lon2 + 540, 360) - 180


def angdiff_deg(a, b) -> Column:
    """Signed difference a - b wrapped to [-180, 180)."""
    return wrap(col(a) - col(b) + 180, 360) - 180


def axis_alignment(course, axis) -> Column:
    """cos² of the angle between a course and an undirected axis."""
    c = F.cos(F.radians(angdiff_deg(course, axis)))
    return c * c


def circular_variance(angle, where: Column | None = None) -> Column:
    """Aggregate: 1 - mean resultant length of the angles; 0 when there are none."""
    a = F.radians(col(angle))
    if where is not None:
        a = F.when(where, a)
    x, y = F.avg(F.cos(a)), F.avg(F.sin(a))
    return F.coalesce(1 - F.sqrt(x * x + y * y), F.lit(0.0))
