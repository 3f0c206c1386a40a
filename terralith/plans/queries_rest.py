"""Registered queries: recorded files, cells, shapes, hashes and the default feature keys over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections
from ..functions import scalars as S
from ..operators import cells as C
from ..operators import cube, gates, geometry, grid, runoff
from ..sources import readers
from ..sources.intermediate import shared_dir
from .adapters import points, r6, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _recorded(spark: SparkSession, kind: str) -> str:
    """A path for a recorded file in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/terralith/recorded-{kind}-{uuid.uuid4().hex}"


# The default feature keys -------------------------------------------------------------------

_KEYS = [("DEM", "elevation"), ("ELSUS", "elsus_class"), ("PGA", "pga_475yr"), ("SEISMIC", "pga"), ("PGV", "pgv"), ("LANDCOVER", "class"), ("RAIN", "rain_24h"), ("WEATHER", "rain_24h"), ("WEATHER", "rain_72h"), ("GEOLOGY", "permeability"), ("OTHER", "thing")]


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}:{b}')" for i, (a, b) in enumerate(_KEYS))}) v(i, key)),
e AS (SELECT user_id, key, value, ts, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) AS rn FROM events JOIN k ON i = event_id % {len(_KEYS)}),
l AS (SELECT * FROM e WHERE rn = 1),
m AS (SELECT user_id, ts, value, key, CASE key WHEN 'DEM:elevation' THEN 'elevation' WHEN 'ELSUS:elsus_class' THEN 'elsus_class' WHEN 'PGA:pga_475yr' THEN 'hazard_pga' WHEN 'SEISMIC:pga' THEN 'hazard_pga' WHEN 'PGV:pgv' THEN 'hazard_pgv'
  WHEN 'LANDCOVER:class' THEN 'clc_class' WHEN 'RAIN:rain_24h' THEN 'rain24h' WHEN 'WEATHER:rain_24h' THEN 'rain24h' WHEN 'WEATHER:rain_72h' THEN 'rain72h' WHEN 'GEOLOGY:permeability' THEN 'permeability' END AS field,
  CASE key WHEN 'SEISMIC:pga' THEN 0 WHEN 'WEATHER:rain_24h' THEN 0 ELSE 1 END AS first FROM l)
SELECT user_id::VARCHAR AS cell, {", ".join(f"arg_max(value, struct_pack(t := ts, r := first)) FILTER (WHERE field = '{f}') AS {f}" for f in ("elevation", "elsus_class", "hazard_pga", "hazard_pgv", "clc_class", "rain24h", "rain72h", "permeability"))},
  max(value) FILTER (WHERE key = 'OTHER:thing') AS other FROM m GROUP BY 1""")
def p05_default_keys(spark, d):
    """X01 with the keys that a user's cube has."""
    place = (F.col("ingest_seq") % len(_KEYS) + 1).cast("int")
    pick = lambda at: F.element_at(F.array(*(F.lit(k[at]) for k in _KEYS)), place)
    wide = cube.features(cube.latest(points(spark, d).withColumns({"layer": pick(0), "variable": pick(1)})))
    return wide.select("cell", "elevation", "elsus_class", "hazard_pga", "hazard_pgv", "clc_class", "rain24h", "rain72h", "permeability", F.try_element_at("extra", F.lit("OTHER:thing")).cast("double").alias("other"))


# Recorded files -----------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(c_acctbal), 4) AS water, round(min(-60 + c_custkey % 120 + 0.5e0), 6) AS south, sum(c_custkey) AS keys FROM customer WHERE c_custkey % 9 <> 0")
def s06_point_csv(spark, d):
    """A CSV of points whose every ninth line is broken, written from customer and read back."""
    k, path = F.col("c_custkey"), _recorded(spark, "points")
    line = F.concat_ws(",", (k % 120 - 59.5).cast("string"), F.lit("7.5"), F.col("c_acctbal").cast("string"), *[F.lit("0.5")] * 3, k.cast("string"))
    table(spark, d, "customer").select(F.when(k % 9 == 0, F.concat(F.lit("broken,"), line)).otherwise(line).alias("lat,lon,water_score,landslide_score,seismic_score,mineral_score,elevation")).write.option("header", True).option("quote", "").csv(path)
    got = readers.read_points_csv(spark, path)
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("water_score").cast("decimal(20,4)")), 4).cast("double").alias("water"), r6(F.min("lat")).alias("south"), F.sum("elevation").cast("long").alias("keys"))


@query("SELECT s_suppkey::VARCHAR AS code, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS balance, NULL::DOUBLE AS absent FROM supplier")
def s07_keyed_csv(spark, d):
    k, path = F.col("s_suppkey"), _recorded(spark, "keyed")
    table(spark, d, "supplier").select(k.alias("code"), F.when(k % 5 != 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("balance"), F.lit("more").alias("ignored")).write.option("header", True).csv(path)
    return readers.read_keyed_csv(spark, path, "code", ["balance", "absent"])


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS name, p_retailprice AS price FROM part")
def s08_json_sink(spark, d):
    path = _recorded(spark, "json")
    readers.write_json(table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price")), path)
    return spark.read.schema("p_partkey long, name string, price double").json(path)


# Cells --------------------------------------------------------------------------------------

_PLACES = """p AS (SELECT c_custkey AS point_id, -80e0 + c_custkey * 7 % 160 AS lat, -180e0 + c_custkey * 13 % 360 AS lon FROM customer),
n AS (SELECT s_suppkey AS node_id, -75e0 + s_suppkey * 37 % 150 AS lat, -179.5e0 + s_suppkey * 91 % 359 AS lon FROM supplier)"""


@query(f"""WITH {_PLACES}, q AS (SELECT point_id, node_id, pow(sin(radians(n.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - p.lon) / 2), 2) AS h FROM p, n)
SELECT point_id, round(min(2 * 6371000e0 * atan2(sqrt(h), sqrt(1 - h))), 2) AS distance_m FROM q GROUP BY 1""")
def j07_nearest_node(spark, d):
    """Nodes far apart, poles and the date line included."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table(spark, d, "customer").select(k.alias("point_id"), (-80.0 + k * 7 % 160).alias("lat"), (-180.0 + k * 13 % 360).alias("lon"))
    n = table(spark, d, "supplier").select(s.alias("node_id"), (-75.0 + s * 37 % 150).alias("lat"), (-179.5 + s * 91 % 359).alias("lon"))
    return C.nearest_node(p, n, 100_000.0).select("point_id", F.round("distance_m", 2).alias("distance_m"))


@query("SELECT 'q5_' || i || '_' || j AS cell FROM (SELECT unnest(range(0, 720)) AS i), (SELECT unnest(range(0, 1440)) AS j) WHERE (i + 0.5e0) * 0.25e0 - 90 BETWEEN 40.1 AND 45.3 AND (j + 0.5e0) * 0.25e0 - 180 BETWEEN 5.2 AND 12.7")
def p04_cells_in_box(spark, d):
    return C.cells_in_box(spark, 40.1, 5.2, 45.3, 12.7, 5)


@query("""WITH c AS (SELECT DISTINCT c_custkey // 40 AS i, c_custkey % 40 AS j FROM customer), o AS (SELECT unnest(range(-1, 2)) AS a), r AS (SELECT DISTINCT i + o.a AS i, j + q.a AS j FROM c, o, o q)
SELECT 'q9_' || (r.i + 2000) || '_' || (r.j + 100) AS cell, c.i IS NULL AS halo FROM r LEFT JOIN c ON c.i = r.i AND c.j = r.j""")
def r20_halo(spark, d):
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(F.concat_ws("_", F.lit("q9"), (F.floor(k / 40) + 2000).cast("string"), (k % 40 + 100).cast("string")).alias("cell"))
    return C.halo(own, 9)


@query("""WITH c AS (SELECT c_custkey // 40 + 2000 AS i, c_custkey % 40 + 100 AS j FROM customer)
SELECT min(i) * 0.015625e0 - 90 AS south, (max(i) + 1) * 0.015625e0 - 90 AS north, min(j) * 0.015625e0 - 180 AS west, (max(j) + 1) * 0.015625e0 - 180 AS east, 'available' AS status FROM c""")
def a29_sampling_bounds(spark, d):
    k = F.col("c_custkey")
    return C.sampling_bounds(table(spark, d, "customer").select(F.concat_ws("_", F.lit("q9"), (F.floor(k / 40) + 2000).cast("string"), (k % 40 + 100).cast("string")).alias("cell")))


@query("""SELECT l_orderkey AS catchment_id, count(*) AS n_cells, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, count(DISTINCT l_linenumber % 3) AS n_resolutions, count(DISTINCT l_partkey) < count(*) AS repeats FROM lineitem GROUP BY 1""")
def a32_catchment_metadata(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("catchment_id"), F.col("l_partkey").alias("cell"), F.col("l_linestatus").alias("volume_status"), (F.col("l_linenumber") % 3).alias("res"))
    return runoff.catchment_metadata(li).select("catchment_id", "n_cells", F.array_join("statuses", ",").alias("statuses"), F.size("resolutions").cast("long").alias("n_resolutions"), "repeats")


# Shapes -------------------------------------------------------------------------------------


def _boxes(spark, d):
    """part as rectangles and windows that clip them."""
    k = F.col("p_partkey")
    c = lambda x: x.cast("double")
    return table(spark, d, "part").select(k, c(k % 13).alias("x0"), c(k % 7).alias("y0"), c(k % 13 + 1 + F.col("p_size")).alias("x1"), c(k % 7 + 4).alias("y1"), c(k % 5 + 2).alias("wx"), c(k % 3 + 1).alias("wy"))


_BOXES = "b AS (SELECT p_partkey, (p_partkey % 13)::DOUBLE AS x0, (p_partkey % 7)::DOUBLE AS y0, (p_partkey % 13 + 1 + p_size)::DOUBLE AS x1, (p_partkey % 7 + 4)::DOUBLE AS y1, (p_partkey % 5 + 2)::DOUBLE AS wx, (p_partkey % 3 + 1)::DOUBLE AS wy FROM part)"


@query(f"WITH {_BOXES} SELECT p_partkey, round(greatest(0, least(x1, wx + 9) - greatest(x0, wx)) * greatest(0, least(y1, wy + 5) - greatest(y0, wy)), 6) AS area FROM b")
def r10_clipped_area(spark, d):
    """Rings clipped to a rectangle, and their areas."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    b = _boxes(spark, d).withColumn("ring", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")))
    ring = geometry.clipped(F.col("ring"), F.col("wx"), F.col("wy"), F.col("wx") + 9, F.col("wy") + 5)
    return b.select("p_partkey", r6(F.coalesce(F.abs(geometry.ring_area(ring)), F.lit(0.0))).alias("area"))


@query("""WITH b AS (SELECT s_suppkey % 23 + 0.1e0 AS x0, s_suppkey % 19 + 0.1e0 AS y0, s_suppkey % 23 + 1.1e0 + s_suppkey % 4 AS x1, s_suppkey % 19 + 2.1e0 AS y1 FROM supplier),
f AS (SELECT DISTINCT i, j FROM b, LATERAL (SELECT unnest(range(0, 200)) AS i), LATERAL (SELECT unnest(range(0, 200)) AS j) WHERE (j + 0.5e0) / 4 BETWEEN x0 AND x1 AND (i + 0.5e0) / 4 BETWEEN y0 AND y1)
SELECT i // 4 AS row, j // 4 AS col, count(*) / 16e0 AS fraction FROM f GROUP BY 1, 2""")
def r09_subcell_coverage(spark, d):
    """Distinct sub-cells that any of overlapping rectangles covers."""
    s = F.col("s_suppkey")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = s % 23 + 0.1, s % 19 + 0.1, s % 23 + 1.1 + s % 4, s % 19 + 2.1
    boxes = table(spark, d, "supplier").select(s.alias("polygon_id"), F.array(F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))).alias("rings"))
    return geometry.subcell_coverage(boxes, 1.0).select("row", "col", "fraction")


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity * CASE WHEN l_suppkey % 17 = 0 THEN 1000 ELSE 10 END END AS v FROM lineitem),
a AS (SELECT l_orderkey, count(v) / count(*)::DOUBLE AS q, avg(v) AS m, coalesce(bool_or(v > 9000), false) AS odd FROM v GROUP BY 1)
SELECT l_orderkey AS polygon_id, CASE WHEN 1 - q > 0.6 THEN 'missing' WHEN odd THEN 'invalid_response' ELSE 'available' END AS status, CASE WHEN 1 - q <= 0.6 AND NOT odd THEN round(m, 6) END AS value, round(q, 6) AS quality FROM a""")
def a15_polygon_pixel_mean(spark, d):
    px = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("polygon_id"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") * F.when(F.col("l_suppkey") % 17 == 0, 1000).otherwise(10)).cast("double").alias("value"))
    return geometry.polygon_pixel_mean(px).select("polygon_id", "status", r6("value").alias("value"), r6("quality").alias("quality"))


@query("""WITH a AS (SELECT n_nationkey AS i, n_nationkey * (n_nationkey + 3) / 2e0 AS x FROM nation)
SELECT i, coalesce((lag(x) OVER w + x) / 2, x - (lead(x) OVER w - x) / 2) AS lower, coalesce((x + lead(x) OVER w) / 2, x + (x - lag(x) OVER w) / 2) AS upper FROM a WINDOW w AS (ORDER BY i)""")
def r12_centre_edges(spark, d):
    k = F.col("n_nationkey")
    return geometry.centre_edges(table(spark, d, "nation").select(k.alias("i"), (k * (k + 3) / 2.0).alias("x"))).select("i", "lower", "upper")


@query("""SELECT c_custkey AS path_id, round(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 * 6371000e0 * (atan2(sqrt(h1), sqrt(1 - h1)) + atan2(sqrt(h2), sqrt(1 - h2))) END, 3) AS length_m FROM (
  SELECT c_custkey, pow(sin(radians(0.01e0) / 2), 2) AS h1, pow(sin(radians(0.02e0) / 2), 2) * pow(cos(radians(lat + 0.01e0)), 2) AS h2 FROM (SELECT c_custkey, -60e0 + c_custkey % 120 AS lat FROM customer))""")
def p32_path_length(spark, d):
    k = F.col("c_custkey")
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    lat, lon = -60.0 + k % 120, (k % 170).cast("double")
    path = F.array(at(lat, lon), at(lat + 0.01, lon), at(lat + 0.01, lon + 0.02))
    return table(spark, d, "customer").select(k.alias("path_id"), F.round(S.path_length_m(F.when(k % 5 == 0, F.slice(path, 1, 1)).otherwise(path)), 3).alias("length_m"))


# Gates and routing --------------------------------------------------------------------------


@query("SELECT p_partkey, p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 AS ok FROM part")
def v03_grid_consistency(spark, d):
    k = F.col("p_partkey")
    w, h = F.col("p_size").cast("double"), (k % 30 + 1).cast("double")
    x1 = w * 10 + F.when(k % 4 == 0, 5.0).otherwise(0.0)
    y1 = h * 10 - F.when(k % 6 == 0, 0.01).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", gates.grid_consistent(w, h, F.lit(10.0), F.lit(0.0), F.lit(0.0), x1, y1).alias("ok"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"size":' || CASE WHEN n_regionkey > 2 THEN n_regionkey::VARCHAR ELSE 'null' END || '}') AS address FROM nation""")
def p45_content_address(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("size"))
    return n.select("n_nationkey", gates.content_address(F.col("size"), F.col("n_nationkey"), F.col("n_name")).alias("address"))


@query("SELECT p_partkey AS idx, round(sum(p_retailprice) OVER (PARTITION BY p_partkey // 32 ORDER BY p_partkey DESC), 2) AS volume FROM part")
def g14_volumes(spark, d):
    """Chains of 32 cells, each draining into the one before it."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    out = grid.volumes(p.select(k.alias("idx"), F.when(k % 32 != 0, k - 1).alias("down")), p.select(k.alias("idx"), F.col("p_retailprice").alias("volume")))
    return out.select(F.col("node_id").alias("idx"), F.round("total", 2).alias("volume"))


# Projections --------------------------------------------------------------------------------

_PLACES = "p AS (SELECT c_custkey AS k, radians(lat) AS la, radians(lon) AS lo, lat, lon FROM (SELECT c_custkey, 44e0 + c_custkey % 1400 / 100e0 AS lat, -5e0 + (c_custkey * 7) % 1900 / 100e0 AS lon FROM customer))"


def _places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), (44.0 + k % 1400 / 100.0).alias("lat"), (-5.0 + (k * 7) % 1900 / 100.0).alias("lon"))


@query(f"""WITH {_PLACES},
c AS (SELECT sqrt(e2) AS e, e2, 6378137e0 AS a FROM (SELECT f * (2 - f) AS e2 FROM (SELECT 1 / 298.257222101e0 AS f))),
q AS (SELECT c.*, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, sin(radians(52e0)) AS s0, cos(radians(52e0)) AS c0 FROM c),
o AS (SELECT q.*, a * sqrt(qp / 2) AS rq, asin((1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) / qp) AS b0 FROM q),
g AS (SELECT o.*, a * c0 / sqrt(1 - e2 * s0 * s0) / (rq * cos(b0)) AS d, k, lat, lon, lo - radians(10e0) AS dl, asin((1 - e2) * (sin(la) / (1 - e2 * sin(la) * sin(la)) - ln((1 - e * sin(la)) / (1 + e * sin(la))) / (2 * e)) / qp) AS b FROM o, p),
w AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(dl))) AS m FROM g)
SELECT k, round(4321000 + m * d * cos(b) * sin(dl), 3) AS x, round(3210000 + m / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(dl)), 3) AS y, round(lat, 6) AS lat_back, round(lon, 6) AS lon_back FROM w""")
def p41_equal_area(spark, d):
    """EPSG:3035 and back."""
    out = projections.unprojected(projections.projected(_places(spark, d), 3035), 3035, lat="lat_back", lon="lon_back")
    return out.select("k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6("lat_back").alias("lat_back"), r6("lon_back").alias("lon_back"))


def _geocentric_sql(a: float, inverse_f: float, shift: tuple[float, ...]) -> str:
    """Latitude and longitude h.la, h.lo of places p on another ellipsoid, by seven parameters from WGS84."""
    dx, dy, dz, rx, ry, rz, ppm = shift
    return f"""v AS (SELECT 6378137e0 AS a, 0.0066943799901413165e0 AS e2, {a!r}::DOUBLE AS b, (2 - 1 / {inverse_f!r}::DOUBLE) / {inverse_f!r}::DOUBLE AS q2),
x0 AS (SELECT k, b, q2, a / sqrt(1 - e2 * pow(sin(la), 2)) AS n, la, lo, e2 FROM p, v),
x1 AS (SELECT k, b, q2, (n * cos(la) * cos(lo) - {dx}) / (1 + {ppm} / 1e6) AS x, (n * cos(la) * sin(lo) - {dy}) / (1 + {ppm} / 1e6) AS y, (n * (1 - e2) * sin(la) - {dz}) / (1 + {ppm} / 1e6) AS z FROM x0),
r AS (SELECT radians({rx} / 3600e0) AS rx, radians({ry} / 3600e0) AS ry, radians({rz} / 3600e0) AS rz),
x2 AS (SELECT k, b, q2, b * sqrt(1 - q2) AS bm, x + rz * y - ry * z AS x, y - rz * x + rx * z AS y, z + ry * x - rx * y AS z FROM x1, r),
x3 AS (SELECT *, sqrt(x * x + y * y) AS pp, atan2(z * b, sqrt(x * x + y * y) * bm) AS t FROM x2),
x4 AS (SELECT *, atan2(z + q2 / (1 - q2) * bm * pow(sin(t), 3), pp - q2 * b * pow(cos(t), 3)) AS l1 FROM x3),
x5 AS (SELECT *, atan2(bm / b * sin(l1), cos(l1)) AS t2 FROM x4),
h AS (SELECT k, b AS a, q2 AS e2, sqrt(q2) AS e, atan2(z + q2 / (1 - q2) * bm * pow(sin(t2), 3), pp - q2 * b * pow(cos(t2), 3)) AS la, atan2(y, x) AS lo FROM x5)"""


@query(f"""WITH {_PLACES}, {_geocentric_sql(6377397.155, 299.1528128, (565.4171, 50.3319, 465.5524, -0.398957, 0.343988, -1.8774, 4.0725))},
s AS (SELECT radians(52.15616055555555e0) AS l0, radians(5.38763888888889e0) AS o0),
g AS (SELECT h.*, o0, l0, sqrt(1 - e2) / (1 - e2 * pow(sin(l0), 2)) AS rad, sqrt(1 + e2 * pow(cos(l0), 4) / (1 - e2)) AS n FROM h, s),
u AS (SELECT *, asin(sin(l0) / n) AS c0 FROM g),
w AS (SELECT *, tan(c0 / 2 + pi() / 4) / (pow(tan(l0 / 2 + pi() / 4), n) * pow((1 - e * sin(l0)) / (1 + e * sin(l0)), n * e / 2)) AS fac, n * (lo - o0) AS dl FROM u),
x AS (SELECT *, 2 * atan(fac * pow(tan(la / 2 + pi() / 4), n) * pow((1 - e * sin(la)) / (1 + e * sin(la)), n * e / 2)) - pi() / 2 AS chi FROM w),
y AS (SELECT *, 2 * rad * 0.9999079e0 * a / (1 + sin(c0) * sin(chi) + cos(c0) * cos(chi) * cos(dl)) AS m FROM x)
SELECT y.k, round(155000 + m * cos(chi) * sin(dl), 3) AS x, round(463000 + m * (cos(c0) * sin(chi) - sin(c0) * cos(chi) * cos(dl)), 3) AS y, round(lat, 4) AS lat_back, round(lon, 4) AS lon_back FROM y JOIN p ON p.k = y.k""")
def p41_double_stereographic(spark, d):
    """EPSG:28992 and back, by way of its own ellipsoid."""
    out = projections.unprojected(projections.projected(_places(spark, d), 28992), 28992, lat="lat_back", lon="lon_back")
    return out.select("k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lat_back", 4).alias("lat_back"), F.round("lon_back", 4).alias("lon_back"))


@query(f"""WITH {_PLACES}, {_geocentric_sql(6377563.396, 299.3249753150316, (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894))},
s AS (SELECT *, a / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS rad, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2,
  61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM (SELECT k, a, e, la, lo + radians(2e0) AS dl, f / (2 - f) AS n, radians(49e0) AS l0 FROM (SELECT *, 1 / 299.3249753150316e0 AS f FROM h))),
t AS (SELECT *, sinh(atanh(sin(la)) - e * atanh(e * sin(la))) AS t, atan(sinh(atanh(sin(l0)) - e * atanh(e * sin(l0)))) AS x0 FROM s),
u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT k, round(400000 + 0.9996012717e0 * rad * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS x,
  round(-100000 + 0.9996012717e0 * rad * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta) - x0 - a1 * sin(2 * x0) - a2 * sin(4 * x0) - a3 * sin(6 * x0) - a4 * sin(8 * x0)), 3) AS y,
  round(lat, 4) AS lat_back, round(lon, 4) AS lon_back FROM u JOIN p USING (k)""")
def p41_transverse_mercator(spark, d):
    """EPSG:27700 and back, by way of its own ellipsoid."""
    out = projections.unprojected(projections.projected(_places(spark, d), 27700), 27700, lat="lat_back", lon="lon_back")
    return out.select("k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lat_back", 4).alias("lat_back"), F.round("lon_back", 4).alias("lon_back"))
