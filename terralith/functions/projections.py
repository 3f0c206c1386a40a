"""Coordinates between WGS84 and the projected systems of the sources, JVM-side in stages that stay in generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoids (a, 1/f), and each system as its definition has it: kind, ellipsoid, origin in degrees, scale,
# false easting and northing, and the seven parameters to WGS84 (metres, arc seconds, millionths).
ELLIPSOIDS = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128), "airy": (6377563.396, 299.3249753150316)}
SYSTEMS = {
    3035: ("laea", "grs80", 52.0, 10.0, 1.0, 4321000.0, 3210000.0, None),
    27700: ("tmerc", "airy", 49.0, -2.0, 0.9996012717, 400000.0, -100000.0, (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)),
    28992: ("sterea", "bessel", 52.15616055555555, 5.38763888888889, 0.9999079, 155000.0, 463000.0, (565.4171, 50.3319, 465.5524, -0.398957, 0.343988, -1.8774, 4.0725)),
    32632: ("tmerc", "wgs84", 0.0, 9.0, 0.9996, 500000.0, 0.0, None),
}


@dataclass(frozen=True)
class System:
    kind: str
    ellipsoid: str
    lat: float
    lon: float
    scale: float
    east: float
    north: float
    shift: tuple[float, ...] | None

    @property
    def a(self) -> float:
        return ELLIPSOIDS[self.ellipsoid][0]

    @property
    def f(self) -> float:
        return 1 / ELLIPSOIDS[self.ellipsoid][1]

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


def system(epsg: int) -> System:
    if epsg not in SYSTEMS:
        raise ValueError(f"EPSG:{epsg} is not among {sorted(SYSTEMS)}")
    kind, ellipsoid, lat, lon, *rest = SYSTEMS[epsg]
    return System(kind, ellipsoid, math.radians(lat), math.radians(lon), *rest)


def _c(name: str) -> Column:
    return F.col(f"__{name}")


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({f"__{k}": v for k, v in columns.items()})


# Datums -----------------------------------------------------------------------------------


def _shifted(df: DataFrame, source: tuple[float, float], target: tuple[float, float], shift: tuple[float, ...], back: bool) -> DataFrame:
    """__lat, __lon on another ellipsoid, at height 0, by the seven parameters (back: from WGS84 to the system)."""
    (a, e2), (b, q2) = source, target
    dx, dy, dz = shift[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in shift[3:6])
    m = 1 + shift[6] / 1e6
    df = _staged(df, n=a / F.sqrt(1 - e2 * F.pow(F.sin(_c("lat")), 2)))
    df = _staged(df, gx=_c("n") * F.cos(_c("lat")) * F.cos(_c("lon")), gy=_c("n") * F.cos(_c("lat")) * F.sin(_c("lon")), gz=_c("n") * (1 - e2) * F.sin(_c("lat")))
    x, y, z = _c("gx"), _c("gy"), _c("gz")
    if back:
        df = _staged(df, gx=(x - dx) / m, gy=(y - dy) / m, gz=(z - dz) / m)
        df = _staged(df, gx=x + rz * y - ry * z, gy=y - rz * x + rx * z, gz=z + ry * x - rx * y)
    else:
        df = _staged(df, gx=m * (x - rz * y + ry * z) + dx, gy=m * (rz * x + y - rx * z) + dy, gz=m * (rx * y - ry * x + z) + dz)
    b_minor = b * math.sqrt(1 - q2)
    df = _staged(df, p=F.sqrt(x * x + y * y))
    df = _staged(df, t=F.atan2(z * b, _c("p") * b_minor))
    lat = lambda t: F.atan2(z + q2 / (1 - q2) * b_minor * F.pow(F.sin(t), 3), _c("p") - q2 * b * F.pow(F.cos(t), 3))
    df = _staged(df, lat=lat(_c("t")))
    df = _staged(df, t=F.atan2(b_minor / b * F.sin(_c("lat")), F.cos(_c("lat"))))  # once more: exact near the surface
    return _staged(df, lat=lat(_c("t")), lon=F.atan2(y, x))


# Projections: __lat, __lon in radians to __x, __y in metres and back ----------------------


def _series(s: System) -> tuple[float, list[float], list[float], list[float]]:
    """Radius of the rectifying sphere, and the coefficients of Krueger's series: to the projection, back, and to latitudes."""
    n = s.f / (2 - s.f)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return s.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), alpha, beta, delta


def _tmerc_north(s: System) -> float:
    """Of the origin's latitude, on the central meridian."""
    radius, alpha, _, _ = _series(s)
    e = math.sqrt(s.e2)
    xi = math.atan(math.sinh(math.atanh(math.sin(s.lat)) - e * math.atanh(e * math.sin(s.lat))))
    return radius * (xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(alpha, 1)))


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _tmerc(df: DataFrame, s: System) -> DataFrame:
    radius, alpha, _, _ = _series(s)
    e = math.sqrt(s.e2)
    df = _staged(df, dl=_c("lon") - s.lon, t=F.sinh(F.atanh(F.sin(_c("lat"))) - e * F.atanh(e * F.sin(_c("lat")))))
    df = _staged(df, xi=F.atan2(_c("t"), F.cos(_c("dl"))), eta=F.atanh(F.sin(_c("dl")) / F.sqrt(1 + _c("t") * _c("t"))))
    east = _total([_c("eta"), *(c * F.cos(2 * j * _c("xi")) * F.sinh(2 * j * _c("eta")) for j, c in enumerate(alpha, 1))])
    north = _total([_c("xi"), *(c * F.sin(2 * j * _c("xi")) * F.cosh(2 * j * _c("eta")) for j, c in enumerate(alpha, 1))])
    return _staged(df, x=s.east + s.scale * radius * east, y=s.north + s.scale * (radius * north - _tmerc_north(s)))


def _tmerc_back(df: DataFrame, s: System) -> DataFrame:
    radius, _, beta, delta = _series(s)
    df = _staged(df, xi=((_c("y") - s.north) / s.scale + _tmerc_north(s)) / radius, eta=(_c("x") - s.east) / (s.scale * radius))
    df = _staged(
        df, xi=_c("xi") - _total([c * F.sin(2 * j * _c("xi")) * F.cosh(2 * j * _c("eta")) for j, c in enumerate(beta, 1)]),
        eta=_c("eta") - _total([c * F.cos(2 * j * _c("xi")) * F.sinh(2 * j * _c("eta")) for j, c in enumerate(beta, 1)]),
    )
    df = _staged(df, chi=F.asin(F.sin(_c("xi")) / F.cosh(_c("eta"))))
    lat = _total([_c("chi"), *(c * F.sin(2 * j * _c("chi")) for j, c in enumerate(delta, 1))])
    return _staged(df, lat=lat, lon=s.lon + F.atan2(F.sinh(_c("eta")), F.cos(_c("xi"))))


def _authalic(e2: float, sine):
    """q of a sine of latitude; log and sine may be a number's or a column's."""
    e = math.sqrt(e2)
    log = math.log if isinstance(sine, float) else F.log
    return (1 - e2) * (sine / (1 - e2 * sine * sine) - log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _laea_parts(s: System) -> tuple[float, float, float, float]:
    qp = _authalic(s.e2, 1.0)
    rq = s.a * math.sqrt(qp / 2)
    beta = math.asin(_authalic(s.e2, math.sin(s.lat)) / qp)
    return qp, rq, beta, s.a * math.cos(s.lat) / math.sqrt(1 - s.e2 * math.sin(s.lat) ** 2) / (rq * math.cos(beta))


def _laea(df: DataFrame, s: System) -> DataFrame:
    qp, rq, b0, d = _laea_parts(s)
    df = _staged(df, dl=_c("lon") - s.lon, s=F.sin(_c("lat")))
    df = _staged(df, beta=F.asin(_authalic(s.e2, _c("s")) / qp))
    df = _staged(df, k=rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(_c("beta")) + math.cos(b0) * F.cos(_c("beta")) * F.cos(_c("dl")))))
    return _staged(df, x=s.east + _c("k") * d * F.cos(_c("beta")) * F.sin(_c("dl")), y=s.north + _c("k") / d * (math.cos(b0) * F.sin(_c("beta")) - math.sin(b0) * F.cos(_c("beta")) * F.cos(_c("dl"))))


def _laea_back(df: DataFrame, s: System) -> DataFrame:
    qp, rq, b0, d = _laea_parts(s)
    e2 = s.e2
    df = _staged(df, u=_c("x") - s.east, v=_c("y") - s.north)
    df = _staged(df, rho=F.sqrt(F.pow(_c("u") / d, 2) + F.pow(_c("v") * d, 2)))
    df = _staged(df, c=2 * F.asin(_c("rho") / (2 * rq)))
    origin = _c("rho") == 0
    df = _staged(df, beta=F.when(origin, b0).otherwise(F.asin(F.cos(_c("c")) * math.sin(b0) + d * _c("v") * F.sin(_c("c")) * math.cos(b0) / _c("rho"))))
    lat = (
        _c("beta") + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * _c("beta")) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * _c("beta")) + 761 * e2**3 / 45360 * F.sin(6 * _c("beta"))
    )
    turn = F.atan2(_c("u") * F.sin(_c("c")), d * _c("rho") * math.cos(b0) * F.cos(_c("c")) - d * d * _c("v") * math.sin(b0) * F.sin(_c("c")))
    return _staged(df, lat=lat, lon=s.lon + F.when(origin, 0.0).otherwise(turn))


def _sphere(s: System) -> tuple[float, float, float, float]:
    """The conformal sphere of a double stereographic projection: its radius, exponent, factor, and the origin's latitude on it."""
    e, sine = math.sqrt(s.e2), math.sin(s.lat)
    radius = math.sqrt(1 - s.e2) / (1 - s.e2 * sine**2)
    n = math.sqrt(1 + s.e2 * math.cos(s.lat) ** 4 / (1 - s.e2))
    chi = math.asin(sine / n)
    factor = math.tan(chi / 2 + math.pi / 4) / (math.tan(s.lat / 2 + math.pi / 4) ** n * ((1 - e * sine) / (1 + e * sine)) ** (n * e / 2))
    return radius, n, factor, chi


def _sterea(df: DataFrame, s: System) -> DataFrame:
    radius, n, factor, chi0 = _sphere(s)
    e = math.sqrt(s.e2)
    df = _staged(df, s=e * F.sin(_c("lat")), dl=n * (_c("lon") - s.lon))
    df = _staged(df, chi=2 * F.atan(factor * F.pow(F.tan(_c("lat") / 2 + math.pi / 4), n) * F.pow((1 - _c("s")) / (1 + _c("s")), n * e / 2)) - math.pi / 2)
    df = _staged(df, k=2 * radius * s.scale * s.a / (1 + math.sin(chi0) * F.sin(_c("chi")) + math.cos(chi0) * F.cos(_c("chi")) * F.cos(_c("dl"))))
    return _staged(df, x=s.east + _c("k") * F.cos(_c("chi")) * F.sin(_c("dl")), y=s.north + _c("k") * (math.cos(chi0) * F.sin(_c("chi")) - math.sin(chi0) * F.cos(_c("chi")) * F.cos(_c("dl"))))


def _sterea_back(df: DataFrame, s: System) -> DataFrame:
    radius, n, factor, chi0 = _sphere(s)
    e = math.sqrt(s.e2)
    df = _staged(df, u=(_c("x") - s.east) / (s.a * s.scale), v=(_c("y") - s.north) / (s.a * s.scale))
    df = _staged(df, rho=F.sqrt(_c("u") * _c("u") + _c("v") * _c("v")))
    df = _staged(df, c=2 * F.atan2(_c("rho"), F.lit(2 * radius)))
    origin = _c("rho") == 0
    df = _staged(df, chi=F.when(origin, chi0).otherwise(F.asin(F.cos(_c("c")) * math.sin(chi0) + _c("v") * F.sin(_c("c")) * math.cos(chi0) / _c("rho"))))
    turn = F.atan2(_c("u") * F.sin(_c("c")), _c("rho") * math.cos(chi0) * F.cos(_c("c")) - _c("v") * math.sin(chi0) * F.sin(_c("c")))
    df = _staged(df, t=F.pow(F.tan(_c("chi") / 2 + math.pi / 4) / factor, 1 / n), lon=s.lon + F.when(origin, 0.0).otherwise(turn) / n, lat=_c("chi"))
    for _ in range(6):  # each is nearer by the square of the eccentricity
        df = _staged(df, s=e * F.sin(_c("lat")))
        df = _staged(df, lat=2 * F.atan(_c("t") * F.pow((1 - _c("s")) / (1 + _c("s")), -e / 2)) - math.pi / 2)
    return df


_THERE = {"tmerc": _tmerc, "laea": _laea, "sterea": _sterea}
_BACK = {"tmerc": _tmerc_back, "laea": _laea_back, "sterea": _sterea_back}


def projected(df: DataFrame, epsg: int, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y", shift: bool = True) -> DataFrame:
    """df with x and y, metres in the system, of WGS84 degrees. Latitudes beyond 90 degrees, infinities and nulls give
    nulls. Without shift the degrees are the system's own."""
    s = system(epsg)
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-360, 360)
    out = _staged(df, lat=F.radians(F.when(ok, F.col(lat))), lon=F.radians(F.when(ok, F.col(lon))))
    if s.shift and shift:
        out = _shifted(out, (ELLIPSOIDS["wgs84"][0], 1 - (1 - 1 / ELLIPSOIDS["wgs84"][1]) ** 2), (s.a, s.e2), s.shift, back=True)
    out = _THERE[s.kind](out, s)
    rest = [c for c in df.columns if c not in (x, y)]
    return out.select(*rest, _c("x").alias(x), _c("y").alias(y))


def unprojected(df: DataFrame, epsg: int, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon", shift: bool = True) -> DataFrame:
    """df with lat and lon, WGS84 degrees, of metres in the system. Without shift they are the system's own degrees."""
    s = system(epsg)
    out = _BACK[s.kind](_staged(df, x=F.col(x).cast("double"), y=F.col(y).cast("double")), s)
    if s.shift and shift:
        out = _shifted(out, (s.a, s.e2), (ELLIPSOIDS["wgs84"][0], 1 - (1 - 1 / ELLIPSOIDS["wgs84"][1]) ** 2), s.shift, back=False)
    rest = [c for c in df.columns if c not in (lat, lon)]
    return out.select(*rest, F.degrees(_c("lat")).alias(lat), F.degrees(_c("lon")).alias(lon))


def reprojected(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """df with x and y of another system, by way of WGS84."""
    own = unprojected(df, source, x, y, "__wlat", "__wlon")
    return projected(own, target, "__wlat", "__wlon", x, y).select(*df.columns)
