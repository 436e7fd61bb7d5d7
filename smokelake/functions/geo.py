"""Column functions on ground coordinates, camera poses and maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import _c, projected

#: Ellipsoid and grid of TWD97 zone 121 (fixed values).
A, B, LON0, K0, DX = 6378137.0, 6356752.3142451, math.radians(121), 0.9999, 250000.0
E2 = 1 - (B / A) ** 2
EP2 = E2 / (1 - E2)
#: Meridian arc: factors of the latitude and of the sines of 2, 4 and 6 times it.
ARC = [
    (0, 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256),
    (2, -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024)),
    (4, 15 * E2**2 / 256 + 45 * E2**3 / 1024),
    (6, -35 * E2**3 / 3072),
]
#: Footpoint latitude: factors of the sines of 2, 4, 6 and 8 times the rectified latitude.
E1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
FOOT = [(2, 3 * E1 / 2 - 27 * E1**3 / 32), (4, 21 * E1**2 / 16 - 55 * E1**4 / 32), (6, 151 * E1**3 / 96), (8, 1097 * E1**4 / 512)]
#: Radius of the sphere for local metres and distances (fixed value).
EARTH = 6378137.0
#: Calibration raster and focal length of the static camera, in pixels and in mm over mm a pixel (fixed values).
CALIBRATION, FOCAL_PX = 2840.0, 4.5 / 0.00274


def dms_to_decimal(d, m, s, ref) -> Column:
    """Degrees, minutes, seconds to degrees; negative for S and W."""
    v = _c(d) + _c(m) / 60 + _c(s) / 3600
    return F.when(F.upper(_c(ref)).isin("S", "W"), -v).otherwise(v)


def _poly(x: Column, terms: list) -> Column:
    """terms[0] * x + terms[1] * x**3 + ... by Horner's rule."""
    out = terms[-1] if isinstance(terms[-1], Column) else F.lit(terms[-1])
    for t in reversed(terms[:-1]):
        out = out * x * x + t
    return out * x


def _grid(lon, lat) -> tuple[Column, Column]:
    lon, phi = _c(lon), F.radians(_c(lat))
    sin, cos = F.sin(phi), F.cos(phi)
    nu = A / F.sqrt(1 - E2 * sin * sin)
    t, c = F.tan(phi) * F.tan(phi), EP2 * cos * cos
    w = (F.radians(lon - 360 * F.floor((lon + 180) / 360)) - LON0) * cos
    arc = A * sum((k * (phi if m == 0 else F.sin(m * phi)) for m, k in ARC), F.lit(0.0))
    east = _poly(w, [1, (1 - t + c) / 6, (5 - 18 * t + t * t + 72 * c - 58 * EP2) / 120])
    north = _poly(w, [F.lit(0.5), (5 - t + 9 * c + 4 * c * c) / 24, (61 - 58 * t + t * t + 600 * c - 330 * EP2) / 720]) * w
    return DX + K0 * nu * east, K0 * (arc + nu * F.tan(phi) * north)


def wgs84_to_twd97(lon, lat) -> Column:
    """Easting and northing by the transverse Mercator series to the sixth order."""
    easting, northing = _grid(lon, lat)
    return F.struct(easting.alias("easting"), northing.alias("northing"))


def twd97_to_wgs84(easting, northing) -> Column:
    """Longitude and latitude by the inverse series."""
    mu = _c(northing) / (K0 * A * ARC[0][1])
    phi = sum((k * F.sin(m * mu) for m, k in FOOT), mu)
    sin, cos = F.sin(phi), F.cos(phi)
    c, t = EP2 * cos * cos, F.tan(phi) * F.tan(phi)
    w = 1 - E2 * sin * sin
    nu, rho = A / F.sqrt(w), A * (1 - E2) / (w * F.sqrt(w))
    d = (_c(easting) - DX) / (nu * K0)
    up = _poly(d, [F.lit(0.5), -(5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) / 24, (61 + 90 * t + 298 * c + 45 * t * t - 3 * c * c - 252 * EP2) / 720]) * d
    across = _poly(d, [1, -(1 + 2 * t + c) / 6, (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) / 120])
    return F.struct(F.degrees(LON0 + across / cos).alias("lon"), F.degrees(phi - nu * F.tan(phi) / rho * up).alias("lat"))


def camera_rotation(yaw, pitch, roll) -> Column:
    """World (east, north, up) to camera (right, down, forward), 3x3 row-major, from degrees."""
    y, p, r = F.radians(_c(yaw)), F.radians(_c(pitch)), F.radians(_c(roll))
    forward = [F.sin(y) * F.cos(p), F.cos(y) * F.cos(p), F.sin(p)]
    right0 = [F.cos(y), -F.sin(y), F.lit(0.0)]
    down0 = [F.sin(y) * F.sin(p), F.cos(y) * F.sin(p), -F.cos(p)]
    right = [a * F.cos(r) + b * F.sin(r) for a, b in zip(right0, down0, strict=True)]
    down = [b * F.cos(r) - a * F.sin(r) for a, b in zip(right0, down0, strict=True)]
    return F.array(*right, *down, *forward)


#: Diagonal of the 35 mm frame (fixed value).
DIAGONAL_35 = math.hypot(36, 24)


def camera_matrix(focal35, width, height, raster_width=None, raster_height=None) -> Column:
    """Row-major K: the 35 mm focal length over the 35 mm diagonal, times the photo's diagonal in pixels.

    For another raster the focal length follows the width, and the principal point is that raster's own centre: a video has
    the photo's horizontal field of view, but may be cropped in height.
    """
    w, h = _c(width).cast("double"), _c(height).cast("double")
    rw = w if raster_width is None else _c(raster_width).cast("double")
    rh = h * rw / w if raster_height is None else _c(raster_height).cast("double")
    f = _c(focal35) / DIAGONAL_35 * F.hypot(w, h) * rw / w
    zero = F.lit(0.0)
    return F.array(f, zero, rw / 2, zero, f, rh / 2, zero, zero, F.lit(1.0))


def _m(a: Column) -> list[Column]:
    return [F.get(a, F.lit(k)) for k in range(9)]


def matmul3(a, b) -> Column:
    p, q = _m(_c(a)), _m(_c(b))
    return F.array(*[p[3 * i] * q[j] + p[3 * i + 1] * q[3 + j] + p[3 * i + 2] * q[6 + j] for i in range(3) for j in range(3)])


def det3(a) -> Column:
    m = _m(_c(a))
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def invert3(a) -> Column:
    """Adjugate over determinant; null for singular matrices."""
    m, d = _m(_c(a)), det3(a)
    adj = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return F.when(F.abs(d) > 1e-12, F.array(*[x / d for x in adj]))


def plane_homography(k, r, x, y, z) -> Column:
    """Ground plane to image: K [r1 r2 -R c] for a camera at (x, y, z)."""
    m, c = _m(_c(r)), list(map(_c, (x, y, z)))
    t = [-(m[3 * i] * c[0] + m[3 * i + 1] * c[1] + m[3 * i + 2] * c[2]) for i in range(3)]
    return matmul3(k, F.array(*[v for i in range(3) for v in (m[3 * i], m[3 * i + 1], t[i])]))


def camera_heading(r) -> Column:
    """Compass degrees of the viewing direction; null where it is nearly straight down or up."""
    m = _m(_c(r))
    return F.when(F.hypot(m[6], m[7]) >= 1e-5, F.pmod(F.degrees(F.atan2(m[6], m[7])), F.lit(360.0)))


def to_en(lon, lat, lon0, lat0) -> Column:
    """Local metres east and north of an origin."""
    east = F.radians(_c(lon) - _c(lon0)) * EARTH * F.cos(F.radians(_c(lat0)))
    return F.struct(east.alias("e"), (F.radians(_c(lat) - _c(lat0)) * EARTH).alias("n"))


def to_gps(e, n, lon0, lat0) -> Column:
    lon = _c(lon0) + F.degrees(_c(e) / (EARTH * F.cos(F.radians(_c(lat0)))))
    return F.struct(lon.alias("lon"), (_c(lat0) + F.degrees(_c(n) / EARTH)).alias("lat"))


#: Metres of a degree of latitude, and of longitude at the equator, of the flat distance (fixed values).
METRES_LAT, METRES_LON = 111132.954, 111412.84


def geo_distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two points by the flat form at their mean latitude."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    return F.hypot((lon1 - lon2) * METRES_LON * F.cos(F.radians((lat1 + lat2) / 2)), (lat1 - lat2) * METRES_LAT)


#: What envelopes are wider than the circle they hold, against rounding (no result depends on it).
WIDER = 1.000001


def half_sides(lat, radius) -> tuple[Column, Column]:
    """Half the height and width in degrees of an envelope that holds every point whose geo_distance is within the radius; 361 where that is every longitude."""
    lat, r = _c(lat), _c(radius)
    dlat = r / METRES_LAT * WIDER
    # the distance takes the mean latitude of both points
    worst = F.abs(lat) + dlat / 2
    return dlat, F.when(worst < 89.9, F.least(r / (METRES_LON * F.cos(F.radians(worst))) * WIDER, F.lit(361.0))).otherwise(F.lit(361.0))


def gps_envelope(lon, lat, radius) -> Column:
    """west, south, east, north of an envelope that holds all within the radius, and why there is none: position (null, not finite, out of range or a latitude of 85 and more), radius (not finite or not above 0), antimeridian, polar (it would reach 85 degrees)."""
    lon, lat, r = map(_c, (lon, lat, radius))
    dlat, dlon = half_sides(lat, r)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    reason = (
        F.when(bad(lon.cast("double")) | bad(lat.cast("double")) | (F.abs(lon) > 180) | (F.abs(lat) >= 85), "position").when(bad(r.cast("double")) | (r <= 0), "radius")
        .when((lat - dlat <= -85) | (lat + dlat >= 85), "polar").when((lon - dlon < -180) | (lon + dlon > 180), "antimeridian")
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, lon - dlon).alias("west"), F.when(ok, lat - dlat).alias("south"), F.when(ok, lon + dlon).alias("east"), F.when(ok, lat + dlat).alias("north"), reason.alias("reason"))


def _pixel_ray(yaw, pitch, roll, px, py, width, height) -> list[Column]:
    """Ray of a pixel in east, north and up, for a camera whose axis points down at pitch 0.

    The pixel is scaled to the calibration raster. Its distance from the centre over the focal length is the angle of the
    ray to the axis.
    """
    u = _c(px) * CALIBRATION / F.greatest(_c(width).cast("double"), F.lit(1.0)) - CALIBRATION / 2
    v = CALIBRATION / 2 - _c(py) * CALIBRATION / F.greatest(_c(height).cast("double"), F.lit(1.0))
    span = F.when(F.hypot(u, v) == 0, F.lit(1e-6)).otherwise(F.hypot(u, v))
    out = F.tan(span / FOCAL_PX) / span
    m = _m(camera_rotation(yaw, pitch, roll))
    return [m[k] * u * out + m[6 + k] * v * out + m[3 + k] for k in range(3)]


def pixel_ray_depth(yaw, pitch, roll, px, py, width, height) -> Column:
    """Upward part of a pixel's ray; below 0 where it meets the ground."""
    return _pixel_ray(yaw, pitch, roll, px, py, width, height)[2]


def pixel_to_ground(lon, lat, alt, yaw, pitch, roll, px, py, width, height) -> Column:
    """Easting and northing where the ray of a pixel of a static camera meets the ground. above_horizon tells rays that don't go down; their coordinates are those of the ray carried on backwards."""
    ray = _pixel_ray(yaw, pitch, roll, px, py, width, height)
    easting, northing = _grid(lon, lat)
    reach = -_c(alt) / ray[2]
    return F.struct((easting + reach * ray[0]).alias("easting"), (northing + reach * ray[1]).alias("northing"), (ray[2] >= 0).alias("above_horizon"))


def match_pixel_to_geo(h, u, v, frame_w, frame_h, roi_w, roi_h, west, north, step_x, step_y, mask=None) -> Column:
    """Longitude and latitude of an image pixel through a homography to a map window; null outside the image, the window or its mask, or near depth 0. Pixel centres lie at .5.

    mask: array of the window's rows, each an array of what the map covers; the nearest cell (halves to the even one) counts.
    """
    u, v = _c(u), _c(v)
    x, y, _ = projected(h, u, v)
    ok = (u >= 0) & (v >= 0) & (u < _c(frame_w)) & (v < _c(frame_h)) & (x >= 0) & (y >= 0) & (x < _c(roi_w)) & (y < _c(roi_h))
    if mask is not None:
        at = lambda z, n: F.least(F.rint(z), _c(n) - 1).cast("int")
        ok = ok & F.coalesce(F.get(F.get(_c(mask), at(y, roi_h)), at(x, roi_w)), F.lit(False))
    return F.when(ok, F.struct((_c(west) + (x + 0.5) * _c(step_x)).alias("lon"), (_c(north) - (y + 0.5) * _c(step_y)).alias("lat")))
