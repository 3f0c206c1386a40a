"""Registered queries: outfall connectivity, surface flow to outlets, terrain samples, windows and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, gates, geometry, grid, network
from . import pipelines as P
from .adapters import RECTANGLES_SQL, part_grid, r6, rectangles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Outfalls ---------------------------------------------------------------------------------

_OUTFALLS = """nodes AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 37 <> 0 THEN 100e0 + 2 * length(c_custkey::VARCHAR) END AS level FROM customer
  UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 50e0 WHEN 2 THEN 1000e0 END FROM supplier),
pipes AS (SELECT 'u' || c_custkey AS id, 'c' || c_custkey AS a, 'c' || (c_custkey // 10) AS b FROM customer WHERE c_custkey >= 10
  UNION ALL SELECT 'x' || s_suppkey, 'c' || s_suppkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 3),
sided AS (SELECT p.*, x.level AS la, y.level AS lb FROM pipes p JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b),
e AS (SELECT id, CASE WHEN la > lb THEN a ELSE b END AS f, CASE WHEN la > lb THEN b ELSE a END AS t FROM sided WHERE la IS NOT NULL AND lb IS NOT NULL),
u AS (SELECT id, unnest([a, b]) AS node FROM sided WHERE la IS NULL OR lb IS NULL),
r AS (SELECT 's' || s_suppkey AS outfall_id, 's' || s_suppkey AS node FROM supplier UNION SELECT outfall_id, f FROM r JOIN e ON t = r.node),
paths AS (SELECT outfall_id, 'known_upstream_node' AS kind, node AS ident FROM r WHERE node <> outfall_id UNION SELECT outfall_id, 'known_upstream_pipe', e.id FROM r JOIN e ON t = node
  UNION SELECT outfall_id, 'unresolved_boundary_pipe', u.id FROM r JOIN u ON u.node = r.node UNION SELECT 's' || s_suppkey, 'outward_known_pipe', e.id FROM supplier JOIN e ON f = 's' || s_suppkey),
states AS (SELECT 's' || s_suppkey AS outfall_id, count(ident) FILTER (WHERE kind = 'known_upstream_node') AS n_known_upstream_nodes, count(ident) FILTER (WHERE kind = 'known_upstream_pipe') AS n_known_upstream_pipes,
  count(ident) FILTER (WHERE kind = 'unresolved_boundary_pipe') AS n_unresolved_boundary_pipes, count(ident) FILTER (WHERE kind = 'outward_known_pipe') AS n_outward_known_pipes
  FROM supplier LEFT JOIN paths ON outfall_id = 's' || s_suppkey GROUP BY s_suppkey),
named AS (SELECT *, CASE WHEN n_outward_known_pipes > 0 THEN 'direction_conflict' WHEN n_known_upstream_pipes > 0 THEN 'known_upstream_path' WHEN n_unresolved_boundary_pipes > 0 THEN 'blocked_by_unresolved_direction' ELSE 'isolated' END AS status FROM states)"""


def _outfalls(spark, d):
    """Customers drain into the one a tenth as large; suppliers are outfalls below, above and beside them, some without a level or a pipe."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    k, o = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    nodes = c.select(name("c", k).alias("node_id"), F.lit("manhole").alias("type"), F.when(k % 37 != 0, 100.0 + 2 * F.length(k.cast("string"))).alias("level"))
    nodes = nodes.unionByName(s.select(name("s", o).alias("node_id"), F.lit("outfall").alias("type"), F.when(o % 4 == 0, 50.0).when(o % 4 == 2, 1000.0).alias("level")))
    pipes = c.where(k >= 10).select(name("u", k).alias("pipe_id"), name("c", k).alias("node_a"), name("c", F.floor(k / 10)).alias("node_b"), F.lit(10.0).alias("length_m"))
    pipes = pipes.unionByName(s.where(o % 4 != 3).select(name("x", o).alias("pipe_id"), name("c", o).alias("node_a"), name("s", o).alias("node_b"), F.lit(10.0).alias("length_m")))
    return network.outfall_paths(network.oriented(pipes, nodes, min_drop=1.0), nodes), nodes


@query(f"WITH RECURSIVE {_OUTFALLS} SELECT * FROM named")
def g03_outfall_connectivity(spark, d):
    return network.outfall_connectivity(*_outfalls(spark, d))


@query(f"""WITH RECURSIVE {_OUTFALLS} SELECT 'outfalls ' || status AS what, count(*) AS n FROM named GROUP BY 1
UNION ALL SELECT 'n_nodes', (SELECT count(DISTINCT i) FROM (SELECT ident AS i FROM paths WHERE kind = 'known_upstream_node' UNION SELECT outfall_id FROM named WHERE n_known_upstream_pipes > 0))
UNION ALL SELECT 'n_pipes', count(DISTINCT ident) FROM paths WHERE kind = 'known_upstream_pipe' UNION ALL SELECT 'n_boundary_pipes', count(DISTINCT ident) FROM paths WHERE kind = 'unresolved_boundary_pipe'""")
def g03_connectivity_counts(spark, d):
    paths, nodes = _outfalls(spark, d)
    return network.connectivity_counts(paths, network.outfall_connectivity(paths, nodes))


# Surface flow -----------------------------------------------------------------------------

_FLOW = """c AS (SELECT p_partkey AS cell, CASE WHEN p_partkey % 41 <> 0 THEN (p_partkey * 7919 % 1009)::DOUBLE END AS elevation FROM part),
adj AS (SELECT cell, cell + o AS nbr, 50e0 + (cell + cell + o) % 7 AS dist_m FROM c, (VALUES (-10), (-1), (1), (10)) v(o)),
g AS (SELECT a.cell, a.nbr, y.elevation AS below, (x.elevation - y.elevation) / dist_m AS grade FROM adj a JOIN c x ON x.cell = a.cell LEFT JOIN c y ON y.cell = a.nbr),
f AS (SELECT cell, bool_or(below IS NULL) AS gap, arg_min(nbr, struct_pack(a := -grade, b := nbr)) FILTER (WHERE grade > 0) AS down FROM g GROUP BY cell),
st AS (SELECT c.cell, down, CASE WHEN elevation IS NULL THEN 'incomplete_elevation' WHEN c.cell % 17 = 0 THEN 'outlet' WHEN gap THEN 'incomplete_elevation' WHEN down IS NULL THEN 'depression' END AS ends FROM c JOIN f USING (cell)),
r AS (SELECT cell, cell AS here, 0 AS steps FROM st UNION ALL SELECT r.cell, st.down, steps + 1 FROM r JOIN st ON st.cell = r.here WHERE st.ends IS NULL),
paths AS (SELECT r.cell, here AS terminal, steps::BIGINT AS n_steps, st.ends AS ends_at FROM r JOIN st ON st.cell = r.here WHERE st.ends IS NOT NULL)"""


def _paths(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    cells = part.select(k.alias("cell"), F.when(k % 41 != 0, (k * 7919 % 1009).cast("double")).alias("elevation"))
    adjacency = part.select(k.alias("cell"), F.explode(F.array(k - 10, k - 1, k + 1, k + 10)).alias("nbr")).withColumn("dist_m", 50.0 + (F.col("cell") + F.col("nbr")) % 7)
    return P.surface_paths(cells, adjacency, cells.where("cell % 17 = 0"))


@query(f"""WITH RECURSIVE {_FLOW} SELECT p.cell, terminal, n_steps, (SELECT count(*) FROM r WHERE r.here = p.cell) AS n_cells, ends_at, CASE ends_at WHEN 'outlet' THEN true WHEN 'depression' THEN false END AS contributes FROM paths p""")
def g09_surface_paths(spark, d):
    return _paths(spark, d)


@query(f"""WITH RECURSIVE {_FLOW},
k AS (SELECT *, row_number() OVER (PARTITION BY terminal ORDER BY n_steps, cell) AS rn, 50e0 + cell % 7 AS area, cell % 29 = 0 AS gone FROM paths WHERE ends_at = 'outlet'),
v AS (SELECT *, (cell % 50) * least(1e0, CASE cell % 5 WHEN 0 THEN 0.80e0 WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.20e0 WHEN 3 THEN 0.30e0 ELSE 1.00e0 END + least(cell % 40, 30) / 30e0 * 0.1e0) / 1000 * area AS vol FROM k WHERE rn <= 3)
SELECT terminal, (SELECT count(*) FROM k WHERE k.terminal = v.terminal) AS n_candidates, count(*) AS n_selected, count(*) = (SELECT count(*) FROM k WHERE k.terminal = v.terminal) AS covers_all, sum(area) AS area_m2,
  CASE WHEN NOT bool_or(gone) THEN round(sum(vol), 6) END AS value, CASE WHEN bool_or(gone) THEN 'stale' ELSE 'available' END AS status, round(sum(vol) FILTER (WHERE NOT gone), 6) AS partial FROM v GROUP BY terminal""")
def x07_conditioned_runoff(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    layer = lambda v, gone: part.select(k.alias("cell"), F.when(~gone, v).cast("double").alias("value"), F.when(gone, "stale").otherwise("available").alias("status"), F.when(gone, "old").alias("reason"))
    layers = {"rain": layer(k % 50, k % 29 == 0), "slope": layer(k % 40, F.lit(False)), "land_cover": layer(100 * (1 + k % 5) + 11, F.lit(False))}
    out = P.conditioned_runoff(_paths(spark, d), part.select(k.alias("cell"), (50.0 + k % 7).alias("area_m2")), layers, most=3)
    return out.select("terminal", "n_candidates", "n_selected", "covers_all", "area_m2", r6("value").alias("value"), "status", r6("partial").alias("partial"))


@query("""WITH v AS (SELECT p_partkey AS idx, ((p_partkey % 10) * 7 + p_partkey % 7)::DOUBLE AS rain, least(1e0, CASE p_partkey % 5 WHEN 0 THEN 0.80e0 WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.20e0 WHEN 3 THEN 0.30e0 ELSE 1.00e0 END + least(p_partkey % 40, 30) / 30e0 * 0.1e0) AS c FROM part)
SELECT idx, rain AS rain_mm, round(rain * c, 6) AS runoff_mm, round(rain * c / 1000 * 900, 6) AS volume, round(sum(rain * c / 1000 * 900) OVER (PARTITION BY idx // 32 ORDER BY idx DESC), 5) AS accumulated FROM v""")
def r18_event_runoff(spark, d):
    """Chains of 32 cells under a rain grid of ten latitudes and seven longitudes."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    cells = part.select(k.alias("idx"), (44.01 + (k % 10) * 0.1).alias("lat"), (10.99 + (k % 7) * 0.1).alias("lon"), (k % 40).cast("double").alias("slope"), (100 * (1 + k % 5) + 11).cast("double").alias("land_cover"), F.when(k % 32 != 0, k - 1).alias("down"))
    rain = part.select((k % 10).cast("int").alias("i"), (k % 7).cast("int").alias("j"), ((k % 10) * 7 + k % 7).cast("double").alias("value")).distinct()
    out = P.event_runoff(cells, rain, [44 + i * 0.1 for i in range(10)], [11 + i * 0.1 for i in range(7)], 900.0)
    return out.select("idx", "rain_mm", r6("runoff_mm").alias("runoff_mm"), r6("volume").alias("volume"), F.round("accumulated", 5).alias("accumulated"))


@query(f"""WITH {RECTANGLES_SQL}, par AS (SELECT r_regionkey + CASE WHEN r_regionkey = 3 THEN 10 ELSE 0 END AS category, 0.1e0 + 0.2e0 * r_regionkey AS coefficient, 0.01e0 * (r_regionkey + 1) AS manning FROM region),
per AS (SELECT target, category, sum(round(area, 9)) AS area FROM pairs GROUP BY ALL),
m AS (SELECT target, sum(area) AS mapped, bool_and(manning IS NOT NULL) AS known, count(*) AS n_classes, arg_min(per.category, struct_pack(a := -round(area, 6), b := per.category)) AS dominant, sum(coefficient * area) / sum(area) AS coefficient, sum(manning * area) / sum(area) AS manning
  FROM per LEFT JOIN par ON par.category = per.category GROUP BY target), ok AS (SELECT t.target, m.* EXCLUDE (target), coalesce(known AND abs(mapped - 100) <= 60.0007, false) AS valid FROM tgt t LEFT JOIN m ON m.target = t.target)
SELECT target, valid, CASE WHEN valid THEN dominant END AS dominant, CASE WHEN valid THEN n_classes END AS n_classes, CASE WHEN valid THEN round(coefficient, 6) END AS coefficient, CASE WHEN valid THEN round(manning, 6) END AS manning FROM ok""")
def r17_footprint_parameters(spark, d):
    t, s = rectangles(spark, d)
    r = F.col("r_regionkey")
    parameters = table(spark, d, "region").select(F.when(r == 3, 13).otherwise(r).cast("long").alias("category"), (0.1 + 0.2 * r).alias("coefficient"), (0.01 * (r + 1)).alias("manning"))
    pieces = geometry.overlaps(t, s, 20.0).join(s.select(F.col("id").alias("source"), "category"), "source").withColumn("area", F.round("area", 9))
    out = P.footprint_parameters(pieces, parameters, t.select(F.col("id").alias("target"), F.lit(100.0).alias("area_m2")), tolerance=0.600007)
    return out.select("target", "valid", "dominant", "n_classes", r6("coefficient").alias("coefficient"), r6("manning").alias("manning"))


# Terrain samples and windows ----------------------------------------------------------------


@query("""WITH g AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 83 <> 0 THEN round(p_retailprice + p_size * 7.25e0, 2) END AS z FROM part),
p AS (SELECT c_custkey AS id, c_custkey % 45 AS row, c_custkey % 50 AS col FROM customer),
x AS (SELECT id, p.row AS row, o.z AS z, o.row IS NULL AS z_out, n.z AS n, s.z AS s, e.z AS e, w.z AS w, n.row IS NULL OR s.row IS NULL OR e.row IS NULL OR w.row IS NULL AS off
  FROM p LEFT JOIN g o ON o.row = p.row AND o.col = p.col LEFT JOIN g n ON n.row = p.row - 1 AND n.col = p.col LEFT JOIN g s ON s.row = p.row + 1 AND s.col = p.col LEFT JOIN g e ON e.row = p.row AND e.col = p.col + 1 LEFT JOIN g w ON w.row = p.row AND w.col = p.col - 1)
SELECT id AS point_id, z AS elevation, CASE WHEN z_out THEN 'out_of_coverage' WHEN z IS NULL THEN 'missing' ELSE 'available' END AS elevation_status,
  round(degrees(atan(sqrt(pow((w - e) / (2 * 0.01e0 * 111320e0 * cos(radians(47 - 0.005e0 - row * 0.01e0))), 2) + pow((n - s) / (2 * 0.01e0 * 111320e0), 2)))), 6) AS slope,
  CASE WHEN off THEN 'out_of_coverage' WHEN n + s + e + w IS NULL THEN 'missing' ELSE 'available' END AS slope_status FROM x""")
def r06_terrain_samples(spark, d):
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("point_id"), (46.995 - (k % 45) * 0.01).alias("lat"), (11.005 + (k % 50) * 0.01).alias("lon"))
    out = grid.terrain_samples(points, part_grid(spark, d), 11.0, 47.0, 0.01, "elevation", offset=0.01)
    return out.select("point_id", "elevation", "elevation_status", r6("slope").alias("slope"), "slope_status")


@query("""WITH b AS (SELECT s_suppkey AS id, s_suppkey * 37.5e0 AS x0, s_suppkey * 12.25e0 AS y0, s_suppkey * 37.5e0 + 120.5e0 AS x1, s_suppkey * 12.25e0 + 80 AS y1 FROM supplier),
a AS (SELECT *, 10 + floor((x0 - 10) / 25) * 25 AS ax, 20 + floor((y0 - 20) / 25) * 25 AS ay, 10 + ceil((x1 - 10) / 25) * 25 AS bx, 20 + ceil((y1 - 20) / 25) * 25 AS by_ FROM b),
i AS (SELECT *, CASE WHEN id % 2 = 0 THEN ax ELSE x0 END AS ix0, CASE WHEN id % 2 = 0 THEN ay ELSE y0 END AS iy0, CASE WHEN id % 2 = 0 THEN bx ELSE x1 END AS ix1, CASE WHEN id % 2 = 0 THEN by_ ELSE y1 END AS iy1 FROM a),
w AS (SELECT *, (ix0 - 10) / 25 AS l, (2520 - iy1) / 25 AS t, (ix1 - 10) / 25 AS r, (2520 - iy0) / 25 AS b FROM i), ok AS (SELECT *, l = floor(l) AND t = floor(t) AND r = floor(r) AND b = floor(b) AND l >= 0 AND t >= 0 AND r <= 100 AND b <= 100 AS ok FROM w)
SELECT id, ax AS x0, ay AS y0, bx AS x1, by_ AS y1, round((bx - ax) / 25)::BIGINT AS width, round((by_ - ay) / 25)::BIGINT AS height, CASE WHEN ok THEN l::BIGINT END AS "left", CASE WHEN ok THEN t::BIGINT END AS top, CASE WHEN ok THEN r::BIGINT END AS "right",
  CASE WHEN ok THEN b::BIGINT END AS bottom, CASE WHEN ok THEN 'available' ELSE 'invalid' END AS status FROM ok""")
def r03_windows(spark, d):
    k = F.col("s_suppkey")
    raw = {"x0": k * 37.5, "y0": k * 12.25, "x1": k * 37.5 + 120.5, "y1": k * 12.25 + 80}
    rows = table(spark, d, "supplier").select(k.alias("id"), *(v.alias(f"r{n}") for n, v in raw.items()))
    rows = rows.select("*", grid.aligned_bounds(*(F.col(f"r{n}") for n in raw), 10.0, 20.0, 25.0).alias("a")).select("id", "a.*", *(f"r{n}" for n in raw))
    inner = tuple(F.when(F.col("id") % 2 == 0, F.col(n)).otherwise(F.col(f"r{n}")) for n in raw)
    window = grid.pixel_window(tuple(map(F.lit, (10.0, 20.0, 2510.0, 2520.0))), inner, 25.0, F.lit(100), F.lit(100))
    return rows.withColumn("w", window).select("id", "x0", "y0", "x1", "y1", "width", "height", "w.*")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' WHEN o_orderkey % 19 = 0 THEN '1996' ELSE strftime(o_orderdate, '%Y%m%d') || '000000' END AS day, o_orderkey % 23 = 0 AS bare FROM orders)
SELECT o_orderkey, CASE WHEN day = 'unknown' OR day = '1996' THEN 'missing_date' WHEN substr(day, 1, 8)::INT >= 19960101 THEN 'post_cutoff' WHEN bare THEN 'missing_geometry' ELSE 'eligible' END AS verdict FROM o""")
def r21_before_cutoff(spark, d):
    k = F.col("o_orderkey")
    day = F.when(k % 17 == 0, "unknown").when(k % 19 == 0, "1996").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("000000")))
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.when(k % 23 != 0, F.col("o_orderpriority")).alias("geom"))
    return gates.before_cutoff(rows, "day", 19960101, "geom").select("o_orderkey", "verdict")


@query("""SELECT o_orderkey AS feature_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND o_custkey % 2 = 0""")
def p06_in_service(spark, d):
    fit = lambda c, name: F.when(c, network.IN_SERVICE[name]).otherwise("Anders")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), fit(F.col("o_orderstatus") == "F", "status").alias("status"), fit(F.col("o_orderkey") % 3 == 0, "type_leiding").alias("kind"), fit(F.col("o_custkey") % 2 == 0, "stelsel_type").alias("stelsel_type"))
    return network.in_service(rows, type_leiding="kind").select("feature_id")


@query("""WITH asked AS (SELECT DISTINCT o_orderkey % 50 AS w, o_custkey AS cell FROM orders), x AS (SELECT w, cell, n_nationkey IS NULL AS gone, n_nationkey % 5 = 0 AS down, cell % 4 = 0 AS absent, cell % 9 = 0 AS empty_ FROM asked LEFT JOIN nation ON n_nationkey = w)
SELECT w AS window_id, cell, CASE WHEN NOT gone AND NOT down AND NOT absent AND NOT empty_ THEN cell * 0.5e0 END AS value, CASE WHEN gone THEN 'invalid_response' WHEN down THEN 'rate_limited' WHEN absent THEN 'invalid_response' WHEN empty_ THEN 'missing' ELSE 'available' END AS status,
  CASE WHEN gone THEN 'window is unknown' WHEN down THEN 'quota' WHEN absent THEN 'cell is absent from the samples' WHEN empty_ THEN 'no data' END AS reason FROM x""")
def j23_window_evidence(spark, d):
    n, c = F.col("n_nationkey"), F.col("cell")
    asked = table(spark, d, "orders").select((F.col("o_orderkey") % 50).cast("long").alias("window_id"), F.col("o_custkey").alias("cell"))
    windows = table(spark, d, "nation").select(n.cast("long").alias("window_id"), F.when(n % 5 == 0, "rate_limited").otherwise("available").alias("status"), F.when(n % 5 == 0, "quota").alias("reason"), F.lit("imerg").alias("product"))
    none = c % 9 == 0
    samples = asked.where("cell % 4 <> 0").distinct().select("window_id", "cell", F.when(~none, c * 0.5).alias("value"), F.when(none, "missing").otherwise("available").alias("status"), F.when(none, "no data").alias("reason"))
    return evidence.window_evidence(asked, windows, samples).drop("window")
