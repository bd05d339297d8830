"""Distances, cells and coordinate systems as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere radius, grid origin, grid scale and bounds.
EARTH_RADIUS_M = 6371000.0
CELL_M = 100.0
LAT_ORIGIN = 37.40
LNG_ORIGIN = 126.75
LAT_M_PER_DEG = 111000.0
LNG_M_PER_DEG = 88800.0
CITY_BOUNDS = (37.40, 37.72, 126.76, 127.19)
POI_MARGIN_DEG = 0.035

METRES_PER_DEG = math.pi * EARTH_RADIUS_M / 180
D_LAT = CELL_M / LAT_M_PER_DEG
D_LNG = CELL_M / LNG_M_PER_DEG


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Squared half-chord on the unit sphere between two points, as SQL text."""
    return (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(radians({lng2} - {lng1}) / 2), 2))"
    )


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres, unrounded."""
    lat1, lng1, lat2, lng2 = map(col, (lat1, lng1, lat2, lng2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.lit(EARTH_RADIUS_M * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def whole_metres(distance) -> Column:
    """Half-even whole metres."""
    return F.rint(col(distance)).cast("int")


def half_even(value, digits: int = 0) -> Column:
    """Half-to-even rounding of a double to ``digits`` decimals, as double."""
    value = col(value).cast("double")
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def cell_i(lat) -> Column:
    return F.floor((col(lat) - LAT_ORIGIN) / D_LAT).cast("int")


def cell_j(lng) -> Column:
    return F.floor((col(lng) - LNG_ORIGIN) / D_LNG).cast("int")


def centre_lat(i) -> Column:
    return F.lit(LAT_ORIGIN) + (col(i) + 0.5) * F.lit(D_LAT)


def centre_lng(j) -> Column:
    return F.lit(LNG_ORIGIN) + (col(j) + 0.5) * F.lit(D_LNG)


def coarse(index, factor: int) -> Column:
    """Cell index at a coarser level; floors, so it also nests below the origin."""
    return col(index) if factor == 1 else F.floor(col(index) / factor).cast("int")


def bbox_cells(min_lat, min_lng, max_lat, max_lng) -> tuple[int, int, int, int]:
    """Inclusive cell range ``(i0, i1, j0, j1)`` of a bounding box."""
    return (
        math.floor((min_lat - LAT_ORIGIN) / D_LAT),
        math.floor((max_lat - LAT_ORIGIN) / D_LAT),
        math.floor((min_lng - LNG_ORIGIN) / D_LNG),
        math.floor((max_lng - LNG_ORIGIN) / D_LNG),
    )


def in_bounds(lat, lng, bounds=CITY_BOUNDS, margin: float = 0.0) -> Column:
    """Closed bounding box; NULL coordinates are outside."""
    low_lat, high_lat, low_lng, high_lng = bounds
    inside = col(lat).between(low_lat - margin, high_lat + margin) & col(lng).between(
        low_lng - margin, high_lng + margin
    )
    return F.coalesce(inside, F.lit(False))


def has_coordinates(lat, lng) -> Column:
    return F.coalesce((col(lat) != 0) & (col(lng) != 0), F.lit(False))


# Ellipsoids and the three projected systems (latitude and longitude of
# origin, scale, false easting and northing); the datum shift is geocentric, 7 parameters.
BESSEL = (6377397.155, 1 / 299.1528128)
GRS80 = (6378137.0, 1 / 298.257222101)
PROJECTIONS = {
    5174: (BESSEL, 38.0, 127.0028902777778, 1.0, 200000.0, 500000.0),
    5181: (GRS80, 38.0, 127.0, 1.0, 200000.0, 500000.0),
    5186: (GRS80, 38.0, 127.0, 1.0, 200000.0, 600000.0),
}
BESSEL_TO_WGS84 = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)
WGS84 = (6378137.0, 1 / 298.257223563)


def _meridian(e2: float) -> tuple[float, float, float, float]:
    return (
        1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256,
        3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024,
        15 * e2**2 / 256 + 45 * e2**3 / 1024,
        35 * e2**3 / 3072,
    )


def projected_to_wgs84(df: DataFrame, x: str, y: str, epsg: int, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Adds ``lat`` and ``lng`` in degrees from projected metres (inverse transverse Mercator series).

    Every step is a projection over the columns of the step before, so each term is written and
    computed once.
    """
    keep = df.columns
    for step in projection_steps(x, y, epsg):
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    return df.select(*keep, F.degrees("_lat").alias(lat), F.degrees("_lng").alias(lng))


def projection_steps(x: str, y: str, epsg: int) -> list[dict[str, str]]:
    """The columns of each step as SQL; the last ones are ``_lat`` and ``_lng`` in radians."""
    (a, f), lat0, lng0, k0, east, north = PROJECTIONS[epsg]
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    c0, c2, c4, c6 = _meridian(e2)
    p0 = math.radians(lat0)
    m0 = a * (c0 * p0 - c2 * math.sin(2 * p0) + c4 * math.sin(4 * p0) - c6 * math.sin(6 * p0))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    n = lambda value: f"{value!r}D"
    steps = [
        {"_mu": f"({n(m0)} + (cast({y} AS double) - {n(north)}) / {n(k0)}) / {n(a * c0)}"},
        {
            "_f": f"_mu + {n(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * _mu) + {n(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * _mu)"
            f" + {n(151 * e1**3 / 96)} * sin(6 * _mu) + {n(1097 * e1**4 / 512)} * sin(8 * _mu)"
        },
        {"_c": f"{n(ep2)} * power(cos(_f), 2)", "_t": "power(tan(_f), 2)", "_w": f"1 - {n(e2)} * power(sin(_f), 2)"},
        {"_n": f"{n(a)} / sqrt(_w)", "_r": f"{n(a * (1 - e2))} / power(_w, 1.5D)"},
        {"_d": f"(cast({x} AS double) - {n(east)}) / (_n * {n(k0)})"},
        {
            "_lat": "_f - _n * tan(_f) / _r * (power(_d, 2) / 2"
            f" - (5 + 3 * _t + 10 * _c - 4 * _c * _c - {n(9 * ep2)}) * power(_d, 4) / 24"
            f" + (61 + 90 * _t + 298 * _c + 45 * _t * _t - {n(252 * ep2)} - 3 * _c * _c) * power(_d, 6) / 720)",
            "_lng": f"{n(math.radians(lng0))} + (_d - (1 + 2 * _t + _c) * power(_d, 3) / 6"
            f" + (5 - 2 * _c + 28 * _t - 3 * _c * _c + {n(8 * ep2)} + 24 * _t * _t) * power(_d, 5) / 120) / cos(_f)",
        },
    ]
    if epsg == 5174:
        steps += _bessel_to_wgs84(n)
    return steps


def _bessel_to_wgs84(n) -> list[dict[str, str]]:
    """Datum shift through geocentric coordinates (position-vector rotation)."""
    a, f = BESSEL
    e2 = f * (2 - f)
    tx, ty, tz, rx, ry, rz, ppm = BESSEL_TO_WGS84
    arc = math.pi / (180 * 3600)
    rx, ry, rz, s = rx * arc, ry * arc, rz * arc, 1 + ppm * 1e-6
    b_a, b_f = WGS84
    b_e2, b_b = b_f * (2 - b_f), b_a * (1 - b_f)
    return [
        {"_n": f"{n(a)} / sqrt(1 - {n(e2)} * power(sin(_lat), 2))"},
        {
            "_gx": "_n * cos(_lat) * cos(_lng)",
            "_gy": "_n * cos(_lat) * sin(_lng)",
            "_gz": f"_n * {n(1 - e2)} * sin(_lat)",
        },
        {
            "_wx": f"{n(tx)} + {n(s)} * (_gx - {n(rz)} * _gy + {n(ry)} * _gz)",
            "_wy": f"{n(ty)} + {n(s)} * ({n(rz)} * _gx + _gy - {n(rx)} * _gz)",
            "_wz": f"{n(tz)} + {n(s)} * ({n(-ry)} * _gx + {n(rx)} * _gy + _gz)",
        },
        {"_p": "sqrt(_wx * _wx + _wy * _wy)"},
        {"_th": f"atan2(_wz * {n(b_a)}, _p * {n(b_b)})"},
        {
            "_lat": f"atan2(_wz + {n(b_e2 / (1 - b_e2) * b_b)} * power(sin(_th), 3), _p - {n(b_e2 * b_a)} * power(cos(_th), 3))",
            "_lng": "atan2(_wy, _wx)",
        },
    ]
