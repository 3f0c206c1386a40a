"""Scalar expressions: every function takes and returns columns, so plans stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null (least and greatest would skip it)."""
    x = _col(x)
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def normalise(x, low, high) -> Column:
    """Place of x between low and high, clamped; a range without width gives 0."""
    x, low, high = _col(x), _col(low), _col(high)
    return F.when(low == high, F.lit(0.0)).otherwise(clamp((x - low) / (high - low)))


def safe_divide(a, b, fallback: float = 0.0) -> Column:
    """A / b, or the fallback where b is 0."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, F.lit(fallback)).otherwise(F.try_divide(a, b))


def three_classes(mean) -> Column:
    """struct(low, medium, high) of probabilities around a mean in [0, 1]; they add up to 1."""
    m = _col(mean)
    first, second = m < 0.33, m < 0.67
    low = F.when(first, 0.7 + (0.33 - m) / 2).when(second, 0.15 + 0.4 * (0.5 - m)).otherwise(F.lit(0.05))
    medium = F.when(first, 0.25 - 0.3 * (0.33 - m)).when(second, 0.7 - 0.6 * F.abs(m - 0.5)).otherwise(0.25 - 0.3 * (m - 0.67))
    high = F.when(first, F.lit(0.05)).when(second, 0.15 + 0.4 * (m - 0.5)).otherwise(0.7 + 0.5 * (m - 0.67))
    raw = F.struct(low.alias("low"), medium.alias("medium"), high.alias("high"))

    def scaled(r: Column) -> Column:
        total = r["low"] + r["medium"] + r["high"]
        return F.struct(*((r[k] / total).alias(k) for k in ("low", "medium", "high")))

    return F.when(m.isNotNull(), F.transform(F.array(raw), scaled)[0])


def confidence(present, ideal: int) -> Column:
    """Share of the wanted features that are there, within [0.3, 1]; 1 when none is wanted."""
    return F.lit(1.0) if ideal == 0 else clamp(_col(present) / F.lit(float(ideal)), 0.3, 1.0)


def inflated_variance(base: float, missing) -> Column:
    """Half as much again for each missing feature."""
    return F.lit(base) * (1 + 0.5 * _col(missing))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    dlat, dlon = b - a, F.radians(_col(lon2)) - F.radians(_col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def path_length_m(path) -> Column:
    """Length of array<struct<lat, lon>>; fewer than two vertices give 0, null gives null."""
    path = _col(path)
    legs = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment in the coordinates' own unit; a segment of no length is a point."""
    px, py, ax, ay, bx, by = map(_col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / size))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def finite_difference_slope(west, east, south, north, lat, step_deg: float = 1 / 3600) -> Column:
    """Slope in degrees from four elevations step_deg around a point."""
    dx = (_col(east) - _col(west)) / (F.lit(2 * step_deg * METRES_PER_DEGREE) * F.cos(F.radians(_col(lat))))
    dy = (_col(north) - _col(south)) / F.lit(2 * step_deg * METRES_PER_DEGREE)
    return F.degrees(F.atan(F.hypot(dx, dy)))


def elevation_tile(lat, lon) -> Column:
    """P10: name of the one-degree tile, such as N46_00_E011_00."""
    lat, lon = F.floor(_col(lat)), F.floor(_col(lon))
    two = lambda v, n: F.lpad(F.abs(v).cast("string"), n, "0")
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), two(lat, 2), F.lit("_00_"), F.when(lon >= 0, "E").otherwise("W"), two(lon, 3), F.lit("_00"))


def mercator_tile_bounds(z, x, y) -> Column:
    """struct(west, south, east, north) in degrees of a web-map tile."""
    z, x, y = _col(z), _col(x), _col(y)
    n = F.pow(F.lit(2.0), z)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * v / n))))
    return F.struct(lon(x).alias("west"), lat(y + 1).alias("south"), lon(x + 1).alias("east"), lat(y).alias("north"))


def zoom_resolution(zoom) -> Column:
    """Cell resolution shown at a zoom."""
    z = _col(zoom)
    return F.when(z < 5, 2).when(z < 7, 3).when(z < 9, 4).when(z < 11, 5).otherwise(6)


def floor_slot(ts, seconds: int = 1800) -> Column:
    """Start of the UTC slot a timestamp is in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(_col(ts)) / seconds) * seconds)


def rate_to_amount(rate, hours: float = 0.5) -> Column:
    """mm/h over a slot to mm; negative and non-finite rates are missing, zero is not."""
    r = _col(rate)
    return F.when((r >= 0) & ~F.isnan(r) & (r < float("inf")), r * hours)


def quantise(x, low, high, log: bool = False) -> Column:
    """0..254 between low and high, 255 for no data; half rounds up."""
    x, low, high = _col(x), _col(low), _col(high)
    if log:
        x, low, high = F.log1p(x), F.log1p(low), F.log1p(high)
    return F.coalesce(F.when(high > low, F.floor(clamp((x - low) / (high - low)) * 254 + 0.5)).when(x.isNotNull(), F.lit(0)), F.lit(255)).cast("int")


def grid_reference_bounds(ref) -> Column:
    """struct(x0, y0, x1, y1) in metres of a reference such as NY1234 (1 km), letters in the 100 km lattice."""
    ref = F.upper(_col(ref))
    letter = lambda i: F.ascii(F.substring(ref, i, 1)) - 65 - F.when(F.substring(ref, i, 1) > "I", 1).otherwise(0)
    a, b = letter(1), letter(2)
    east, north = F.pmod(a - 2, F.lit(5)) * 5 + F.pmod(b, F.lit(5)), 19 - F.floor(a / 5) * 5 - F.floor(b / 5)
    n = F.length(ref) - 2
    size = F.pow(F.lit(10.0), 5 - n / 2).cast("long")
    x = east * 100_000 + F.substring(ref, F.lit(3), (n / 2).cast("int")).cast("long") * size
    y = north * 100_000 + F.substring(ref, (3 + n / 2).cast("int"), (n / 2).cast("int")).cast("long") * size
    return F.when(ref.rlike("^[A-HJ-Z]{2}([0-9]{2}|[0-9]{4}|[0-9]{6}|[0-9]{8}|[0-9]{10})$"), F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1")))


def parse_date(text) -> Column:
    """dd/mm/yyyy, or yyyymmdd at the start of digits; anything else is null."""
    t = F.trim(_col(text).cast("string"))
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy"))).when(t.rlike(r"^\d{8}"), F.try_to_timestamp(F.substring(t, 1, 8), F.lit("yyyyMMdd"))).cast("date")


def failure_status(http, message) -> Column:
    """Evidence status of a failed request, by its code (null: none) and by codes and words within its message."""
    text = F.lower(F.concat_ws(" ", _col(http).cast("string"), _col(message)))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    # What stands for each status, in this order
    return (
        F.when(has("401", "403", "unauthorized", "forbidden"), "auth_required").when(has("429", "rate limit"), "rate_limited")
        .when(has("404", "enoent", "not found"), "missing").otherwise("upstream_error")
    )


# The 44 land-cover codes in the order of their palette.
LAND_COVER_CODES = (
    111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142, 211, 212, 213, 221, 222, 223, 231, 241, 242, 243, 244, 311, 312, 313,
    321, 322, 323, 324, 331, 332, 333, 334, 335, 411, 412, 421, 422, 423, 511, 512, 521, 522, 523,
)


def land_cover_code(raw) -> Column:
    """A three-digit code as it is, 1..44 as the palette's entry, anything else null."""
    v = _col(raw)
    codes = F.array(*map(F.lit, LAND_COVER_CODES))
    whole = v == F.floor(v)
    return F.when(whole & v.isin(*LAND_COVER_CODES), v.cast("int")).when(whole & v.between(1, len(LAND_COVER_CODES)), F.element_at(codes, v.cast("int")))


def node_type(text) -> Column:
    """Outfall, inlet, manhole or junction from a source's own word."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
    return F.when(has("uitlaat", "overstort", "outfall", "lozing"), "outfall").when(has("kolk", "inlet", "inlaat"), "inlet").when(has("put", "manhole"), "manhole").otherwise("junction")


def crs_to_utm(lat, lon, zone: int) -> Column:
    """struct(east, north) of the transverse Mercator projection on WGS84, as a series to the sixth order of the
    longitude difference (millimetres within a zone)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon) - (zone * 6 - 183))
    s, c = F.sin(phi), F.cos(phi)
    n = a / F.sqrt(1 - e2 * s * s)
    t, g, q = F.pow(F.tan(phi), 2), ep2 * c * c, lam * c
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = 500000 + k0 * n * (q + (1 - t + g) * F.pow(q, 3) / 6 + (5 - 18 * t + t * t + 72 * g - 58 * ep2) * F.pow(q, 5) / 120)
    north = k0 * (m + n * F.tan(phi) * (q * q / 2 + (5 - t + 9 * g + 4 * g * g) * F.pow(q, 4) / 24 + (61 - 58 * t + t * t + 600 * g - 330 * ep2) * F.pow(q, 6) / 720))
    return F.struct(east.alias("east"), north.alias("north"))
