"""Registered queries: series, networks, grids, geometry, metrics, gates and the solver over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import flood, gates, geometry, grid, metrics, network, series, solver
from .adapters import GRID_SQL, NETWORK_SQL, RECTANGLES_SQL, part_grid, pipes_and_nodes, points, r6, rectangles, shown, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Series -----------------------------------------------------------------------------------


def _daily(spark, d):
    p = points(spark, d).withColumn("ts", F.date_trunc("day", "ts"))
    return p.groupBy("cell", "ts").agg(F.round(F.sum("value_num"), 4).alias("v"))


_DAILY = "daily AS (SELECT user_id::VARCHAR AS cell, date_trunc('day', ts) AS ts, round(sum(value), 4) AS v FROM events GROUP BY ALL)"
_FROM, _TO = "2024-01-02", "2024-01-09"


@query(f"""WITH {_DAILY}, k AS (SELECT DISTINCT cell FROM daily), c AS (SELECT cell, TIMESTAMP '{_FROM}' + INTERVAL 1 DAY * i AS ts FROM k, range(0, 7) t(i))
SELECT c.cell, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS ts FROM c ANTI JOIN daily USING (cell, ts)""")
def j19_missing_slots(spark, d):
    return series.missing_slots(_daily(spark, d), ["cell"], _FROM, _TO, 86400).select("cell", shown("ts").alias("ts"))


@query(f"""WITH {_DAILY}, s AS (SELECT cell, count(*) AS n_values, sum(v) AS p FROM daily WHERE ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '{_TO}' GROUP BY cell)
SELECT cell, n_values, round(p, 3) AS partial, CASE WHEN n_values = 7 THEN round(p, 3) END AS total, CASE WHEN n_values = 7 THEN 'available' ELSE 'incomplete_window' END AS status FROM s""")
def a07_strict_accumulation(spark, d):
    out = series.strict_accumulation(_daily(spark, d), ["cell"], "v", _FROM, _TO, 86400)
    return out.select("cell", "n_values", F.round("partial", 3).alias("partial"), F.round("total", 3).alias("total"), "status")


@query("SELECT user_id::VARCHAR AS cell, max(value) AS peak, strftime(arg_max(ts, struct_pack(a := value, b := -event_id)), '%Y-%m-%d %H:%M:%S') AS peak_ts FROM events GROUP BY 1")
def a10_peak(spark, d):
    return series.peak(points(spark, d), ["cell"], "value_num", "ingest_seq").select("cell", "peak", shown("peak_ts").alias("peak_ts"))


@query(f"""WITH {_DAILY}, w AS (SELECT cell, ts, v, count(*) OVER f AS n, first(v) OVER f AS a FROM daily WINDOW f AS (PARTITION BY cell ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW))
SELECT cell, round(max(CASE WHEN n = 4 THEN v - a END), 4) AS largest_rise, count(*) FILTER (WHERE n = 4) AS n_windows FROM w GROUP BY cell""")
def w06_largest_rise(spark, d):
    out = series.largest_rise(_daily(spark, d), ["cell"], "v", 3 * 86400, 86400)
    return out.select("cell", F.round("largest_rise", 4).alias("largest_rise"), "n_windows")


@query(f"""WITH {_DAILY}, b AS (SELECT cell, arg_min(v, ts) AS baseline FROM daily GROUP BY cell)
SELECT cell, baseline, round(sum(greatest(v - baseline, 0)), 3) AS excess FROM daily JOIN b USING (cell) GROUP BY ALL""")
def p36_excess_over_baseline(spark, d):
    out = series.above_baseline(_daily(spark, d), ["cell"], "v")
    return out.groupBy("cell", "baseline").agg(F.round(F.sum("excess"), 3).alias("excess"))


@query("""
WITH p AS (SELECT user_id::VARCHAR AS cell, CASE event_type WHEN 'purchase' THEN 'final' WHEN 'view' THEN 'late' WHEN 'click' THEN 'early' END AS product, count(DISTINCT date_trunc('day', ts)) AS n FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY ALL)
SELECT cell, arg_max(product, n * 10 - CASE product WHEN 'final' THEN 1 WHEN 'late' THEN 2 ELSE 3 END) AS product, max(n) AS n_slots FROM p GROUP BY cell""")
def w05_best_product(spark, d):
    p = points(spark, d).withColumn("ts", F.date_trunc("day", "ts"))
    product = F.when(F.col("variable") == "purchase", "final").when(F.col("variable") == "view", "late").when(F.col("variable") == "click", "early")
    return series.best_product(p.withColumn("product", product), ["cell"], "product")


@query("""
SELECT o_orderkey, rank, ambiguous FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS ambiguous FROM orders) WHERE rank <= 3""")
def w08_ranked_with_ties(spark, d):
    out = series.ranked_with_ties(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate"], "o_orderkey")
    return out.where("rank <= 3").select("o_orderkey", "rank", "ambiguous")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w07_latest_survey(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return series.first_of(o, ["o_custkey"], [-F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def w10_later_duplicates(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber")).withColumn("order", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    return series.duplicates(li, "key", "order").select("l_orderkey", "l_partkey", "l_linenumber", "n")


# Networks ---------------------------------------------------------------------------------


@query(f"""WITH {NETWORK_SQL}, x AS (SELECT p.*, a.level AS la, b.level AS lb FROM pipes p JOIN nodes a ON a.node_id = node_a JOIN nodes b ON b.node_id = node_b)
SELECT pipe_id, CASE WHEN la IS NULL OR lb IS NULL THEN 'unknown' WHEN la = lb OR abs(la - lb) + 1e-6 < 1 THEN 'ambiguous' ELSE 'known' END AS status,
  CASE WHEN la IS NULL OR lb IS NULL OR la = lb OR abs(la - lb) + 1e-6 < 1 THEN NULL WHEN la > lb THEN node_b ELSE node_a END AS to_node,
  CASE WHEN NOT (la = lb OR abs(la - lb) + 1e-6 < 1) THEN round(abs(la - lb) / length_m, 6) END AS grade FROM x""")
def g02_directions(spark, d):
    out = network.oriented(*pipes_and_nodes(spark, d), min_drop=1.0)
    return out.select("pipe_id", "direction.status", "to_node", r6("direction.grade").alias("grade"))


@query(f"""WITH RECURSIVE {NETWORK_SQL}, e AS (SELECT CASE WHEN a.level > b.level THEN node_a ELSE node_b END AS f, CASE WHEN a.level > b.level THEN node_b ELSE node_a END AS t
  FROM pipes JOIN nodes a ON a.node_id = node_a JOIN nodes b ON b.node_id = node_b WHERE abs(a.level - b.level) + 1e-6 >= 1),
r AS (SELECT 'r' || r_regionkey AS outfall_id, 'r' || r_regionkey AS node_id, 0 AS steps FROM region UNION SELECT outfall_id, f, steps + 1 FROM r JOIN e ON t = r.node_id WHERE steps < 30)
SELECT outfall_id, node_id, min(steps) AS steps FROM r GROUP BY ALL""")
def g03_reachability(spark, d):
    pipes, nodes = pipes_and_nodes(spark, d)
    return network.upstream_of(network.oriented(pipes, nodes, min_drop=1.0), nodes.where("type = 'outfall'"))


@query("""
WITH own AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, coalesce(v, 0) AS v FROM customer LEFT JOIN own ON k = c_custkey)
SELECT 'c' || c_custkey AS node_id, round(v, 2) AS total, 'r' || n_regionkey AS terminal FROM c JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'n' || n_nationkey, round(coalesce(sum(v), 0), 2), 'r' || n_regionkey FROM nation LEFT JOIN c ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_regionkey
UNION ALL SELECT 'r' || r_regionkey, round(coalesce(sum(v), 0), 2), 'r' || r_regionkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON n_nationkey = c_nationkey GROUP BY r_regionkey""")
def g05_accumulation(spark, d):
    """Order totals through customer -> nation -> region."""
    pipes, nodes = pipes_and_nodes(spark, d)
    own = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id")).agg(F.sum("o_totalprice").alias("value"))
    sources = nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("value", F.lit(0.0)).alias("own"))  # a node without orders has a source of 0
    out = network.forest(pipes.select(F.col("node_a").alias("node_id"), F.col("node_b").alias("down")), sources)
    return out.select("node_id", F.round("total", 2).alias("total"), "terminal")


@query(f"WITH {NETWORK_SQL} SELECT pipe_id, CASE WHEN s IS NULL OR abs(s) < 0.001e0 THEN 'unknown' WHEN s > 0 THEN 'forward' ELSE 'reversed' END AS flow FROM (SELECT pipe_id, (a.level - b.level) / length_m AS s FROM pipes JOIN nodes a ON a.node_id = node_a JOIN nodes b ON b.node_id = node_b)")
def g07_legacy_direction(spark, d):
    pipes, nodes = pipes_and_nodes(spark, d)
    for side in "ab":
        pipes = pipes.join(nodes.select(F.col("node_id").alias(f"node_{side}"), F.col("level").alias(f"level_{side}")), f"node_{side}")
    return network.legacy_direction(pipes).select("pipe_id", "flow")


@query("""
WITH n AS (SELECT c_custkey AS c, (c_custkey % 1490)::VARCHAR AS id FROM customer),
p AS (SELECT 'p' || o_orderkey AS id, o_orderkey AS o, o_totalprice AS price, (o_custkey % 1490)::VARCHAR AS a, CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 100 = 7 THEN 'nowhere' ELSE (o_custkey * 3 % 1490)::VARCHAR END AS b FROM orders),
t AS (SELECT (s_suppkey % 90)::VARCHAR AS id, (s_suppkey * 20)::VARCHAR AS node FROM supplier),
pairs AS (SELECT least(a, b) || '|' || greatest(a, b) AS id FROM p)
SELECT 'empty_network_id' AS code, 'network' AS ident, 1::BIGINT AS n
UNION ALL SELECT unnest(list_filter([CASE WHEN c % 97 = 0 THEN 'invalid_node_type' END, CASE WHEN c % 89 = 0 THEN 'invalid_position' END, CASE WHEN c % 79 = 0 THEN 'invalid_h3' END, CASE WHEN c % 83 = 0 THEN 'invalid_elevation_evidence' END,
  CASE WHEN c % 79 = 0 OR c % 73 = 0 THEN 'elevation_h3_mismatch' END, CASE WHEN c % 71 = 0 THEN 'invalid_node_source' END], lambda x: x IS NOT NULL)), id, 1 FROM n
UNION ALL SELECT unnest(list_filter([CASE WHEN a = b THEN 'self_loop' END, CASE WHEN a NOT IN (SELECT id FROM n) OR b NOT IN (SELECT id FROM n) THEN 'missing_pipe_endpoint' END, CASE WHEN price < 2000 THEN 'invalid_pipe_length' END, CASE WHEN o % 67 = 0 THEN 'invalid_pipe_diameter' END,
  CASE WHEN o % 59 = 0 OR o % 53 = 0 THEN 'invalid_pipe_path' END, CASE WHEN o % 47 = 0 THEN 'invalid_pipe_invert_evidence' END, CASE WHEN o % 43 = 0 THEN 'invalid_pipe_invert_evidence' END, CASE WHEN o % 41 = 0 THEN 'invalid_pipe_source' END], lambda x: x IS NOT NULL)), id, 1 FROM p
UNION ALL SELECT 'duplicate_node_id', id, count(*) - 1 FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_pipe_endpoints', id, count(*) - 1 FROM pairs GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_catchment_attachment', id, count(*) - 1 FROM t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing_catchment_outlet', id, 1 FROM t WHERE node NOT IN (SELECT id FROM n)""")
def g01_network_issues(spark, d):
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    k, w = F.col("c_custkey"), F.col("o_orderkey")
    every = lambda col, n, odd, usual: F.when(col % n == 0, odd).otherwise(usual)
    here = C.cell_of(F.lit(1.0), F.lit(2.0), 5)
    source = lambda provider, acquired: F.struct(provider.alias("provider"), F.lit("pipes").alias("dataset"), F.lit("derived").alias("origin"), acquired.alias("acquired_at"))
    evidence = lambda value, status, **more: F.struct(value.alias("value"), status.alias("status"), F.lit(None).cast("string").alias("reason"), *(v.alias(n) for n, v in more.items()))
    day = F.lit("2020-01-01T00:00:00Z")
    nodes = c.select(
        (k % 1490).cast("string").alias("node_id"), every(k, 97, "odd", "inlet").alias("type"), every(k, 89, 99.0, 1.0).alias("lat"), F.lit(2.0).alias("lon"), every(k, 79, F.lit("nowhere"), here).alias("cell"),
        evidence(F.when(k % 83 != 0, F.lit(0.0)), F.lit("available"), cell=every(k, 73, F.lit("elsewhere"), here)).alias("elevation"), source(every(k, 71, " ", "city"), day).alias("source"),
    )
    lost = (w % 50 == 0) & (F.col("o_custkey") % 100 == 7)
    place = lambda lat: F.struct(lat.alias("lat"), F.lit(2.0).alias("lon"))
    pipes = o.select(
        F.concat(F.lit("p"), w.cast("string")).alias("pipe_id"), (F.col("o_custkey") % 1490).cast("string").alias("node_a"), F.when(lost, "nowhere").otherwise((F.col("o_custkey") * 3 % 1490).cast("string")).alias("node_b"),
        F.when(F.col("o_totalprice") >= 2000, 1.0).otherwise(0.0).alias("length_m"), F.when(w % 67 == 0, -1.0).when(w % 61 != 0, 300.0).alias("diameter_mm"),
        F.when(w % 59 == 0, F.array(place(F.lit(1.0)))).otherwise(F.array(place(F.lit(1.0)), place(every(w, 53, 91.0, 1.0)))).alias("path"),
        evidence(F.lit(1.0), F.lit("available"), unit=every(w, 47, "cm", "m")).alias("invert_a"), evidence(F.lit(1.0), every(w, 43, "odd", "available"), unit=F.lit("m")).alias("invert_b"), source(F.lit("city"), every(w, 41, "never", day)).alias("source"),
    )
    attachments = s.select((F.col("s_suppkey") % 90).cast("string").alias("catchment_id"), (F.col("s_suppkey") * 20).cast("string").alias("outlet_node_id"))
    return network.issues(nodes, pipes, attachments, network_id=" ")


@query("""
WITH a AS (SELECT DISTINCT (p_partkey % 900)::VARCHAR AS code, CASE WHEN p_partkey % 900 < 100 THEN p_partkey ELSE p_partkey % 900 END AS pipe FROM part),
r AS (SELECT o_orderkey AS record_id, (o_orderkey % 1000)::VARCHAR AS code FROM orders)
SELECT record_id, r.code, CASE WHEN count(DISTINCT pipe) = 1 THEN min(pipe)::VARCHAR END AS pipe_id, CASE count(DISTINCT pipe) WHEN 1 THEN 'available' WHEN 0 THEN 'missing' ELSE 'invalid_response' END AS status FROM r LEFT JOIN a ON a.code = r.code GROUP BY ALL""")
def j14_inflow_attachment(spark, d):
    k = F.col("p_partkey")
    aliases = table(spark, d, "part").select((k % 900).cast("string").alias("alias"), F.when(k % 900 < 100, k).otherwise(k % 900).cast("string").alias("pipe_id"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 1000).cast("string").alias("code"))
    return network.attached(rows, aliases).select("record_id", "code", "pipe_id", "status")


_SNAP = """p AS (SELECT c_custkey AS point_id, 46 + (c_custkey % 61) * 0.0001e0 + (c_custkey // 2867) * 0.01e0 AS lat, 11 + (c_custkey % 47) * 0.0001e0 AS lon FROM customer),
n AS (SELECT s_suppkey AS node_id, 46 + (s_suppkey % 31) * 0.0002e0 + 0.00002e0 + (s_suppkey // 713) * 0.01e0 AS lat, 11 + (s_suppkey % 23) * 0.0002e0 + 0.00003e0 AS lon FROM supplier)"""


@query(f"""WITH {_SNAP}, q AS (SELECT point_id, node_id, pow(sin(radians(n.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - p.lon) / 2), 2) AS h FROM p, n),
m AS (SELECT point_id, node_id, 2 * 6371000e0 * atan2(sqrt(h), sqrt(1 - h)) AS dist FROM q),
b AS (SELECT point_id, min(dist) AS dist, arg_min(node_id, struct_pack(a := dist, b := node_id)) AS node_id FROM m WHERE dist <= 8 GROUP BY point_id),
c AS (SELECT b.point_id, count(*) AS n FROM b JOIN m ON m.point_id = b.point_id WHERE m.dist - b.dist < 1e-6 AND m.dist <= 8 GROUP BY b.point_id)
SELECT p.point_id, CASE WHEN n = 1 THEN node_id END AS node_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'snapped' END AS status, round(dist, 4) AS distance_m FROM p LEFT JOIN b USING (point_id) LEFT JOIN c USING (point_id)""")
def j05_snap_to_nodes(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table(spark, d, "customer").select(k.alias("point_id"), (46 + (k % 61) * 0.0001 + F.floor(k / 2867) * 0.01).alias("lat"), (11 + (k % 47) * 0.0001).alias("lon"))
    n = table(spark, d, "supplier").select(s.alias("node_id"), (46 + (s % 31) * 0.0002 + 0.00002 + F.floor(s / 713) * 0.01).alias("lat"), (11 + (s % 23) * 0.0002 + 0.00003).alias("lon"))
    return network.snapped(p, n, 8.0).select("point_id", "node_id", "status", F.round("distance_m", 4).alias("distance_m"))


# Grids ------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL} SELECT row // 5 AS row, col // 5 AS col, count(elevation) AS n_valid, CASE WHEN count(elevation) = 25 THEN round(avg(elevation), 6) END AS value FROM grid GROUP BY 1, 2")
def a16_block_mean(spark, d):
    return grid.block_mean(part_grid(spark, d), 5, "elevation").select("row", "col", "n_valid", r6("value").alias("value"))


@query(f"""WITH {GRID_SQL}, g AS (SELECT row // 10 AS row, col // 10 AS col, size % 6 AS g, count(*) AS n, count(elevation) AS ok, sum(elevation) AS s, max(elevation) AS mx, bool_or(water) AS w FROM grid GROUP BY 1, 2, 3)
SELECT row, col, round(sum(ok) / 100e0, 6) AS coverage, round(sum(s) / sum(ok), 6) AS mean, max(mx) AS max, arg_min(g, struct_pack(a := -n, b := g)) AS dominant, bool_or(w) AS any_water FROM g GROUP BY 1, 2""")
def a17_display_pyramid(spark, d):
    out = grid.pyramid(part_grid(spark, d).withColumn("g", F.col("size") % 6), 10, "elevation", "g", "water")
    return out.select("row", "col", r6("coverage").alias("coverage"), r6("mean").alias("mean"), "max", "dominant", "any_water")


@query(f"""WITH {GRID_SQL}, b AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM grid)
SELECT g.idx FROM grid g, b WHERE g.row BETWEEN r0 + 1 AND r1 - 1 AND g.col BETWEEN c0 + 1 AND c1 - 1
  AND NOT EXISTS (SELECT 1 FROM grid x WHERE x.elevation IS NULL AND x.row BETWEEN g.row - 1 AND g.row + 1 AND x.col BETWEEN g.col - 1 AND g.col + 1)""")
def r02_eroded(spark, d):
    return grid.eroded(part_grid(spark, d).withColumn("valid", F.col("elevation").isNotNull()), 1).select("idx")


@query(f"WITH {GRID_SQL} SELECT count(elevation) AS n_valid, count(*) - count(elevation) AS n_no_data, round(min(elevation), 3) AS min, round(max(elevation), 3) AS max FROM grid")
def a18_pixel_stats(spark, d):
    return grid.pixel_stats(part_grid(spark, d), "elevation")


_D8 = f"""{GRID_SQL}, land AS (SELECT * FROM grid WHERE NOT water AND elevation IS NOT NULL),
o AS (SELECT * FROM (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) v(dir, dr, dc)),
nb AS (SELECT l.idx, o.dir, g.idx AS to_idx, g.idx IS NULL AS off, g.idx IS NOT NULL AND g.elevation IS NULL AS gap,
  CASE WHEN l.elevation - g.elevation > 1e-6 THEN (l.elevation - g.elevation) / (30 * CASE WHEN dir % 2 = 1 THEN sqrt(2) ELSE 1 END) END AS grade
  FROM land l CROSS JOIN o LEFT JOIN grid g ON g.row = l.row + dr AND g.col = l.col + dc),
st AS (SELECT idx, bool_or(off) AS edge, bool_or(gap) AS gap, arg_min(to_idx, struct_pack(a := -grade, b := dir)) FILTER (WHERE grade IS NOT NULL) AS best,
  arg_min(dir, struct_pack(a := -grade, b := dir)) FILTER (WHERE grade IS NOT NULL) AS dir FROM nb GROUP BY idx),
flow AS (SELECT idx, CASE WHEN edge THEN 1 WHEN best IS NOT NULL THEN 0 WHEN gap THEN 4 ELSE 3 END AS terminal_type, CASE WHEN NOT edge THEN best END AS down, CASE WHEN NOT edge THEN dir END AS direction FROM st)"""


@query(f"WITH {_D8} SELECT idx, down, direction, terminal_type FROM flow")
def t03_d8_directions(spark, d):
    return grid.d8(part_grid(spark, d), 30.0)


@query(f"""WITH RECURSIVE {_D8}, up AS (SELECT idx AS source, idx AS at FROM flow UNION ALL SELECT source, down FROM up JOIN flow ON flow.idx = up.at WHERE down IS NOT NULL)
SELECT f.idx, f.terminal_type, count(*) AS n_cells, count(*) * 900e0 AS area_m2 FROM flow f JOIN up ON up.at = f.idx GROUP BY ALL""")
def g13_concentration(spark, d):
    return grid.concentration(part_grid(spark, d), 30.0).select("idx", "terminal_type", "n_cells", "area_m2")


def flood_sql(phase: str, nodes: str, edges: str, onward: str, before: str) -> str:
    """A recursive table `phase` of rounds: each cell's least label, its own or its neighbours' led on, until none changes.
    nodes: cell, l (null: none yet), w; edges: cell, nbr; before: the label that comes first of two."""
    return f"""{phase}_r AS (SELECT 0 AS k, cell, w, l, true AS moved FROM ({nodes})
  UNION ALL SELECT k, cell, w, l, bool_or(l IS DISTINCT FROM was) OVER () FROM (
    SELECT r.k + 1 AS k, r.cell, r.w, r.l AS was, least(r.l, min(CASE WHEN n.l IS NOT NULL THEN {onward} END)) AS l
    FROM {phase}_r r LEFT JOIN ({edges}) e ON e.cell = r.cell LEFT JOIN {phase}_r n ON n.cell = e.nbr AND n.l IS NOT NULL WHERE r.moved GROUP BY r.k, r.cell, r.w, r.l)),
{phase} AS (SELECT cell, {before} FROM {phase}_r WHERE k = (SELECT max(k) FROM {phase}_r))"""


_FLOOD = f"""{GRID_SQL},
z AS (SELECT idx AS cell, row, col, elevation AS z, CASE WHEN col IN (0, 49) OR row = 0 THEN idx % 3 END AS rank FROM grid WHERE elevation IS NOT NULL),
near AS (SELECT a.cell, b.cell AS nbr, a.z FROM z a JOIN z b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell <> b.cell),
{flood_sql("s", "SELECT cell, z AS w, CASE WHEN rank IS NOT NULL THEN z END AS l FROM z", "SELECT cell, nbr FROM near", "greatest(n.l, r.w)", "l AS spill")},
kept AS (SELECT n.cell, n.nbr FROM near n JOIN s a ON a.cell = n.cell JOIN s b ON b.cell = n.nbr WHERE greatest(n.z, b.spill) = a.spill),
{flood_sql("f", "SELECT z.cell, spill - z AS w, CASE WHEN rank IS NOT NULL THEN 0e0 END AS l FROM z JOIN s ON s.cell = z.cell WHERE spill IS NOT NULL", "SELECT cell, nbr FROM kept", "greatest(n.l, r.w)", "l AS fill, w AS own")},
both_ AS (SELECT k.cell, k.nbr FROM kept k JOIN f a ON a.cell = k.cell JOIN f b ON b.cell = k.nbr WHERE greatest(b.fill, a.own) = a.fill),
{flood_sql("t", "SELECT z.cell, 0 AS w, CASE WHEN rank IS NOT NULL THEN struct_pack(rank := rank, steps := 0::BIGINT, terminal := z.cell) END AS l FROM z JOIN s ON s.cell = z.cell WHERE spill IS NOT NULL", "SELECT cell, nbr FROM both_", "struct_pack(rank := n.l.rank, steps := n.l.steps + 1, terminal := n.l.terminal)", "l")},
led AS (SELECT b.cell, arg_min(b.nbr, struct_pack(a := y.spill, b := g.fill, c := b.nbr)) AS down FROM both_ b JOIN t x ON x.cell = b.cell JOIN t n ON n.cell = b.nbr JOIN s y ON y.cell = b.nbr JOIN f g ON g.cell = b.nbr
  WHERE x.l = struct_pack(rank := n.l.rank, steps := n.l.steps + 1, terminal := n.l.terminal) GROUP BY b.cell)"""


@query(f"""WITH RECURSIVE {_FLOOD}
SELECT z.cell, round(spill, 6) AS spill, round(fill, 6) AS fill, l.rank::INT AS terminal_rank, l.steps AS steps, l.terminal AS terminal, down
FROM z LEFT JOIN s ON s.cell = z.cell LEFT JOIN f ON f.cell = z.cell LEFT JOIN t ON t.cell = z.cell LEFT JOIN led ON led.cell = z.cell""")
def g12_priority_flood(spark, d):
    """The part grid, eight neighbours, terminals of three ranks on three of its borders, in tiles of 64 rows by 25 columns."""
    g = part_grid(spark, d).where("elevation IS NOT NULL")
    border = (F.col("col").isin(0, 49)) | (F.col("row") == 0)
    tile = F.concat_ws(":", F.floor(F.col("row") / 64), F.floor(F.col("col") / 25))
    cells = g.select(tile.alias("tile"), F.col("idx").alias("cell"), "elevation", F.when(border, F.col("idx") % 3).alias("terminal_rank"))
    near = grid.neighbours(g, "idx").where("n_idx IS NOT NULL").select(F.col("idx").alias("cell"), F.col("n_idx").alias("nbr"))
    out = flood.priority_flood(cells, near)
    return out.select("cell", r6("spill").alias("spill"), r6("fill").alias("fill"), "terminal_rank", "steps", "terminal", "down")


_CELLDIM = "c AS (SELECT s_suppkey AS cell, s_acctbal AS elevation FROM supplier), adj AS (SELECT a.cell, b.cell AS nbr, 50e0 + (a.cell + b.cell) % 7 AS dist_m FROM c a JOIN c b ON abs(a.cell - b.cell) IN (1, 10))"


def _adjacency(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("elevation"))
    steps = F.array(*map(F.lit, (-10, -1, 1, 10)))
    adj = c.select("cell", F.explode(F.transform(steps, lambda i: F.col("cell") + i)).alias("nbr")).join(c.select(F.col("cell").alias("nbr")), "nbr", "left_semi")
    return c, adj.select("cell", "nbr", (50.0 + (F.col("cell") + F.col("nbr")) % 7).alias("dist_m"))


@query(f"""WITH {_CELLDIM}, g AS (SELECT adj.cell, nbr, (a.elevation - b.elevation) / dist_m AS grade FROM adj JOIN c a ON a.cell = adj.cell JOIN c b ON b.cell = nbr)
SELECT c.cell, arg_min(nbr, struct_pack(a := -grade, b := nbr)) FILTER (WHERE grade > 0) AS down, round(max(grade) FILTER (WHERE grade > 0), 6) AS grade FROM c LEFT JOIN g USING (cell) GROUP BY c.cell""")
def g09_steepest_neighbour(spark, d):
    return grid.steepest_neighbour(*_adjacency(spark, d)).select("cell", "down", r6("grade").alias("grade"))


@query(f"""WITH RECURSIVE {_CELLDIM}, k AS (SELECT cell, cell AS nbr, 0 AS steps FROM c UNION SELECT k.cell, adj.nbr, steps + 1 FROM k JOIN adj ON adj.cell = k.nbr WHERE steps < 4),
m AS (SELECT cell, nbr, min(steps) AS steps FROM k GROUP BY ALL), s AS (SELECT m.cell, m.steps, c.elevation AS v, row_number() OVER (PARTITION BY m.cell ORDER BY steps, nbr) AS rn FROM m JOIN c ON c.cell = m.nbr WHERE steps BETWEEN 1 AND 4 AND c.cell % 3 <> 0)
SELECT c.cell, count(rn) AS n_samples, CASE WHEN count(rn) >= 3 THEN round(sum(v / steps) / sum(1e0 / steps), 6) END AS value FROM c LEFT JOIN s ON s.cell = c.cell AND rn <= 18 GROUP BY c.cell""")
def g11_idw(spark, d):
    c, adj = _adjacency(spark, d)
    out = grid.idw(c, c.where("cell % 3 <> 0").select("cell", F.col("elevation").alias("value")), grid.rings(adj, c, 4))
    return out.select("cell", "n_samples", r6("value").alias("value"))


# Geometry ---------------------------------------------------------------------------------


def _pairs(spark, d):
    t, s = rectangles(spark, d)
    return t, s, geometry.overlaps(t, s, 25.0)


@query(f"WITH {RECTANGLES_SQL} SELECT target, source, round(area, 6) AS area, round(area / 100, 6) AS fraction FROM pairs")
def j12_area_overlap(spark, d):
    return _pairs(spark, d)[2].select("target", "source", r6("area").alias("area"), r6("fraction").alias("fraction"))


@query(f"WITH {RECTANGLES_SQL} SELECT target, CASE WHEN count(*) = count(value) THEN round(sum(value * (area / 100)), 2) END AS value, round(sum(value * (area / 100)), 2) AS partial, count(*) - count(value) AS n_missing FROM pairs GROUP BY target")
def j13_weighted_sum(spark, d):
    _, s, p = _pairs(spark, d)
    out = geometry.weighted_sum(p, s.select(F.col("id").alias("source"), "value"))
    return out.select("target", F.round("value", 2).alias("value"), F.round("partial", 2).alias("partial"), "n_missing")


@query(f"""WITH {RECTANGLES_SQL}, c AS (SELECT target, category, sum(area) AS a FROM pairs GROUP BY ALL)
SELECT target, arg_min(category, struct_pack(a := -round(a, 9), b := category)) AS dominant, round(sum(a), 6) AS total, count(*) AS n_categories FROM c GROUP BY target""")
def a12_category_fractions(spark, d):
    _, s, p = _pairs(spark, d)
    rows = p.join(s.select(F.col("id").alias("source"), "category"), "source").withColumn("area", F.round("area", 9))
    out = geometry.category_fractions(rows)
    return out.select("target", "dominant", r6("total").alias("total"), F.size("fractions").cast("long").alias("n_categories"))


@query(f"WITH {RECTANGLES_SQL} SELECT target, count(value) AS n, round(CASE WHEN count(value) = 1 THEN min(value) ELSE sum(value * area) FILTER (WHERE value IS NOT NULL) / sum(area) FILTER (WHERE value IS NOT NULL) END, 4) AS mean FROM pairs WHERE value IS NOT NULL GROUP BY target")
def a11_area_mean(spark, d):
    _, s, p = _pairs(spark, d)
    out = geometry.area_mean(p.join(s.select(F.col("id").alias("source"), "value"), "source"))
    return out.select("target", "n", F.round("mean", 4).alias("mean"))


@query(f"""WITH {RECTANGLES_SQL}, p AS (SELECT t.target, coalesce(sum(area), 0) AS mapped, coalesce(sum(area) FILTER (WHERE value IS NOT NULL), 0) AS observed FROM tgt t LEFT JOIN pairs USING (target) GROUP BY t.target)
SELECT target, round(mapped, 6) AS mapped, round(observed, 6) AS observed, round(greatest(0e0, 100 - mapped), 6) AS uncovered, abs(observed - 100) <= 1e-4 AS complete, mapped > 100 + 1e-4 AS overlapping FROM p""")
def a13_coverage(spark, d):
    t, s, p = _pairs(spark, d)
    pieces = p.join(s.select(F.col("id").alias("source"), "value"), "source").withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("available"))
    out = geometry.coverage(pieces, t.select(F.col("id").alias("target"), F.lit(100.0).alias("area_m2")))
    return out.select("target", r6("mapped").alias("mapped"), r6("observed").alias("observed"), r6("uncovered").alias("uncovered"), "complete", "overlapping")


@query("""
WITH pt AS (SELECT c_custkey AS point_id, (c_custkey % 40) * 0.5e0 + 0.13e0 AS x, (c_custkey * 7 % 41) * 0.5e0 + 0.27e0 AS y FROM customer),
tri AS (SELECT s_suppkey AS id, s_suppkey % 5 AS priority, (s_suppkey % 17)::DOUBLE AS ax, (s_suppkey % 13)::DOUBLE AS ay FROM supplier),
hit AS (SELECT point_id, id, priority FROM pt, tri WHERE x > ax AND y > ay AND (x - ax) / 6 + (y - ay) / 4 < 1)
SELECT pt.point_id, arg_min(id, struct_pack(a := priority, b := id)) AS polygon_id, count(id) AS n_containing FROM pt LEFT JOIN hit USING (point_id) GROUP BY pt.point_id""")
def j08_polygon_pick(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    pts = table(spark, d, "customer").select(k.alias("point_id"), ((k % 40) * 0.5 + 0.13).alias("x"), ((k * 7 % 41) * 0.5 + 0.27).alias("y"))
    at = lambda dx, dy: F.struct(((s % 17) + F.lit(dx)).cast("double").alias("x"), ((s % 13) + F.lit(dy)).cast("double").alias("y"))
    tri = table(spark, d, "supplier").select(s.alias("polygon_id"), (s % 5).alias("priority"), F.array(F.array(at(0.0, 0.0), at(6.0, 0.0), at(0.0, 4.0))).alias("rings"))
    return geometry.containing(pts, tri, 5.0).select("point_id", "polygon_id", "n_containing")


@query("""
WITH tri AS (SELECT s_suppkey AS id, (s_suppkey % 17)::DOUBLE AS ax, (s_suppkey % 13)::DOUBLE AS ay FROM supplier)
SELECT id AS polygon_id, r.i AS row, c.i AS col FROM tri, range(0, 60) r(i), range(0, 80) c(i) WHERE (c.i + 0.5e0) * 0.3e0 > ax AND (r.i + 0.5e0) * 0.3e0 > ay AND ((c.i + 0.5e0) * 0.3e0 - ax) / 6 + ((r.i + 0.5e0) * 0.3e0 - ay) / 4 < 1""")
def r08_rasterise(spark, d):
    s = F.col("s_suppkey")
    at = lambda dx, dy: F.struct(((s % 17) + F.lit(dx)).cast("double").alias("x"), ((s % 13) + F.lit(dy)).cast("double").alias("y"))
    tri = table(spark, d, "supplier").select(s.alias("polygon_id"), F.array(F.array(at(0.0, 0.0), at(6.0, 0.0), at(0.0, 4.0))).alias("rings"))
    return geometry.rasterised(tri, 0.3)


@query(f"""WITH {RECTANGLES_SQL} SELECT source, target, round(area / sum(area) OVER (PARTITION BY source), 6) AS weight FROM pairs""")
def r16_footprint_weights(spark, d):
    return geometry.footprint_weights(_pairs(spark, d)[2]).select("source", "target", r6("weight").alias("weight"))


# Metrics ----------------------------------------------------------------------------------

_RANK = """s AS (SELECT lang, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, score, count(*) AS n, sum(label) AS p FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score) - n AS below, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS n_above, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS p_above, sum(n) OVER (PARTITION BY lang) AS n_all, sum(p) OVER (PARTITION BY lang) AS p_all FROM g)"""


def _scores(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(f"""WITH {_RANK}, t AS (SELECT lang, sum(n) AS n, sum(p) AS positives, sum(p * (below + (n + 1) / 2e0)) AS r, sum(p / p_all::DOUBLE * (p_above / n_above::DOUBLE)) AS ap FROM c GROUP BY lang)
SELECT lang, n::BIGINT AS n, positives::BIGINT AS positives, round(positives / n::DOUBLE, 6) AS prevalence, round((r - positives * (positives + 1) / 2e0) / (positives * (n - positives))::DOUBLE, 6) AS roc_auc, round(ap, 6) AS average_precision FROM t""")
def m02_m03_ranking(spark, d):
    out = metrics.ranking(_scores(spark, d), ["lang"], "score", "label")
    return out.select("lang", "n", "positives", r6("prevalence").alias("prevalence"), r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))


@query(f"""WITH {_RANK}, f AS (SELECT * FROM (VALUES (0.01e0), (0.05e0), (0.1e0), (0.2e0)) v(fraction)),
t AS (SELECT lang, fraction, sum(n * greatest(0e0, least(1e0, (fraction * n_all - (n_above - n)) / n::DOUBLE))) AS sel, sum(p * greatest(0e0, least(1e0, (fraction * n_all - (n_above - n)) / n::DOUBLE))) AS hits, max(p_all) AS pos FROM c, f GROUP BY ALL)
SELECT lang, fraction, round(sel, 6) AS selected, round(hits, 6) AS hits, round(hits / sel, 6) AS precision, round(hits / pos, 6) AS recall, round(hits / (sel + pos - hits), 6) AS iou FROM t""")
def m04_overlap_at(spark, d):
    out = metrics.overlap_at(_scores(spark, d), ["lang"], "score", "label")
    return out.select("lang", "fraction", *(r6(c).alias(c) for c in ("selected", "hits", "precision", "recall", "iou")))


def _masks(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.when(F.col("l_partkey") % 31 != 0, F.col("l_discount") > 0.05).alias("a"), F.when(F.col("l_suppkey") % 29 != 0, F.col("l_tax") > 0.04).alias("b"), (F.col("l_discount") > 0.08).alias("deep"))


_MASK = "m AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_partkey % 31 <> 0 THEN l_discount > 0.05e0 END AS a, CASE WHEN l_suppkey % 29 <> 0 THEN l_tax > 0.04e0 END AS b, l_discount > 0.08e0 AS deep FROM lineitem)"


@query(f"""WITH {_MASK}, c AS (SELECT l_returnflag, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unknown FROM m GROUP BY 1)
SELECT *, round(tp / (tp + fp + fn)::DOUBLE, 6) AS iou, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, (tp + fp) * 400e0 AS predicted_area FROM c""")
def m05_contingency(spark, d):
    out = metrics.contingency(_masks(spark, d), ["l_returnflag"], "a", "b", 400.0)
    return out.select("l_returnflag", "tp", "fp", "fn", "tn", "unknown", *(r6(c).alias(c) for c in ("iou", "precision", "recall")), "predicted_area")


@query(f"""WITH {_MASK} SELECT l_linenumber, count(*) FILTER (WHERE NOT a AND NOT b) AS dry, count(*) FILTER (WHERE a AND b) AS hit, count(*) FILTER (WHERE a AND NOT b) AS false_alarm, count(*) FILTER (WHERE NOT a AND b) AS miss, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unknown, count(*) AS total FROM m GROUP BY 1""")
def m08_m09_error_classes(spark, d):
    return metrics.class_contingency(_masks(spark, d), "l_linenumber", "a", "b")


@query(f"WITH {_MASK} SELECT count(*) FILTER (WHERE deep AND NOT a) AS deep_outside_a, count(*) FILTER (WHERE a AND NOT b) AS a_outside_b FROM m")
def m10_nested_thresholds(spark, d):
    return metrics.nested_thresholds(_masks(spark, d), ["deep", "a", "b"])


@query("SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, count(*) FILTER (WHERE value = 0) AS zeros FROM events GROUP BY 1")
def a22_score_summary(spark, d):
    out = metrics.score_summary(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", "min", "max", r6("mean").alias("mean"), r6("median").alias("median"), "zeros")


@query(f"""WITH {GRID_SQL}, k AS (SELECT row, col, size > 25 AS wet FROM grid WHERE idx % 41 <> 0), o AS (SELECT * FROM (VALUES ('N', -1, 0), ('E', 0, 1), ('S', 1, 0), ('W', 0, -1)) v(side, dr, dc))
SELECT w.row, w.col, side FROM k w, o JOIN k n ON n.row = w.row + dr AND n.col = w.col + dc WHERE w.wet AND NOT n.wet""")
def m06_boundary_segments(spark, d):
    cells = part_grid(spark, d).select("row", "col", F.when(F.col("idx") % 41 != 0, F.col("size") > 25).alias("wet"))
    return metrics.boundary_segments(cells, "wet", 1.0).select("row", "col", "side")


@query(f"""WITH {GRID_SQL}, o AS (SELECT * FROM (VALUES (-1, 0), (0, 1), (1, 0), (0, -1)) v(dr, dc)),
k AS (SELECT row, col, size > 45 AS a, size < 6 AS b FROM grid),
sa AS (SELECT DISTINCT w.col + 0.5e0 + dc * 0.5e0 AS x, w.row + 0.5e0 + dr * 0.5e0 AS y, dr <> 0 AS flat FROM k w, o JOIN k n ON n.row = w.row + dr AND n.col = w.col + dc WHERE w.a AND NOT n.a),
sb AS (SELECT DISTINCT w.col + 0.5e0 + dc * 0.5e0 AS x, w.row + 0.5e0 + dr * 0.5e0 AS y, dr <> 0 AS flat FROM k w, o JOIN k n ON n.row = w.row + dr AND n.col = w.col + dc WHERE w.b AND NOT n.b),
dist AS (
  SELECT min(sqrt(pow(greatest(abs(p.x - e.x) - CASE WHEN e.flat THEN 0.5e0 ELSE 0 END, 0), 2) + pow(greatest(abs(p.y - e.y) - CASE WHEN e.flat THEN 0 ELSE 0.5e0 END, 0), 2))) AS v FROM sa p, sb e GROUP BY p.x, p.y
  UNION ALL SELECT min(sqrt(pow(greatest(abs(p.x - e.x) - CASE WHEN e.flat THEN 0.5e0 ELSE 0 END, 0), 2) + pow(greatest(abs(p.y - e.y) - CASE WHEN e.flat THEN 0 ELSE 0.5e0 END, 0), 2))) FROM sb p, sa e GROUP BY p.x, p.y)
SELECT round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS largest, count(*) AS n FROM dist""")
def m07_boundary_distance(spark, d):
    g = part_grid(spark, d)
    a, b = (metrics.boundary_segments(g.select("row", "col", m.alias("wet")), "wet", 1.0) for m in (F.col("size") > 45, F.col("size") < 6))
    return metrics.symmetric_p95(a, b, 1.0, 1).select(r6("p95").alias("p95"), r6("largest").alias("largest"), "n")


# Gates ------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'evaluation_reference' WHEN 1 THEN 'context' ELSE 'forcing' END AS role, doc_id % 3 = 0 AS used, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 20 END AS day, CASE WHEN doc_id % 7 = 0 THEN 'note' END AS note FROM documents)
SELECT id, 'reference_is_not_input' AS rule FROM x WHERE used AND role <> 'forcing' UNION ALL SELECT id, 'availability_is_known' FROM x WHERE used AND day IS NULL
UNION ALL SELECT id, 'available_by_cutoff' FROM x WHERE used AND day > 10 AND note IS NULL""")
def v02_leakage(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select(
        k.alias("id"), F.when(k % 5 == 0, "evaluation_reference").when(k % 5 == 1, "context").otherwise("forcing").alias("role"), F.lit("pre_event").alias("temporal_relation"), (k % 3 == 0).alias("use_input"), F.lit(False).alias("use_calibration"),
        F.when(k % 4 != 0, F.timestamp_seconds((k % 20) * 86400)).alias("available_at"), F.when(k % 7 == 0, "note").alias("methodology_note"),
    )
    return gates.leakage(x, F.timestamp_seconds(F.lit(10 * 86400)), retrospective=True)


@query("""
SELECT page_id, 'path_portable' AS rule FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT page_id, 'sha256_valid' FROM pages WHERE page_id % 9 = 0 UNION ALL SELECT page_id, 'bytes_valid' FROM pages WHERE html IS NULL""")
def v01_artifact_rules(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.when(k % 6 == 0, "../up").otherwise(F.concat(F.lit("a/b-"), k.cast("string"))).alias("relative_path"), F.length("html").alias("bytes"), F.when(k % 9 == 0, "ABC").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"))
    return gates.broken(p, "page_id", gates.artifact_rules())


@query("SELECT user_id AS cell, n, m, n + m = 100 AS accounted FROM (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n, count(*) FILTER (WHERE event_type = 'error') AS m FROM events GROUP BY 1)")
def v05_series_accounted(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("cell")).agg(F.count_if(F.col("event_type") != "error").alias("n"), F.count_if(F.col("event_type") == "error").alias("m"))
    return e.withColumn("accounted", gates.series_accounted("n", "m", 100))


@query("""
SELECT o_custkey, o_totalprice, 'left' AS only_in FROM orders WHERE o_orderkey % 500 = 0 UNION ALL SELECT o_custkey, o_totalprice + 1, 'right' FROM orders WHERE o_orderkey % 500 = 0""")
def j20_same_rows(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return gates.same_rows(a, b).select("o_custkey", "o_totalprice", "only_in")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'validated' WHEN o_orderkey % 3 = 0 THEN 'declined' WHEN o_orderkey % 5 = 0 THEN 'accepted' ELSE 'inspected' END AS state FROM orders")
def v07_delivery_state(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", gates.delivery_state(F.col("o_orderstatus") != "F", k % 2 != 0, k % 3 != 0, k % 5 != 0).alias("state"))


# Solver -----------------------------------------------------------------------------------


@query()
def l04_scenarios(spark, d):
    """Three rain scenarios on a tilted basin made of part: no SQL can step it; the tests hold analytic cases."""
    g = part_grid(spark, d)
    cells = g.select(F.explode(F.array(*map(F.lit, ("light", "middle", "heavy")))).alias("scenario"), "row", "col", (F.col("row") * 0.05 + F.col("size") / 100).alias("elevation"), F.lit(0.03).alias("manning"), F.lit(0.0).alias("depth"))
    rain = spark.createDataFrame([("light", 0.0, 600.0, 10.0), ("middle", 0.0, 600.0, 40.0), ("heavy", 0.0, 600.0, 120.0)], "scenario string, from_s double, to_s double, mm_h double")
    return solver.scenarios(cells, rain, 900.0, 10.0).withColumns({"max_depth": r6("max_depth"), "time_of_max": F.round("time_of_max", 2)})
