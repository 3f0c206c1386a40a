"""Registered queries: the surface around outfalls (X08), forcing frames (L03) and scenarios driven by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, grid, solver
from . import forcing, observed
from .adapters import RECTANGLES_SQL, part_grid, r6, rectangles, table
from .queries_space import flood_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STEPS = (-53, -52, -51, -1, 1, 51, 52, 53)  # eight neighbours in rows of 52, so that those beyond the grid have ids of their own


def _surface(spark, d):
    """part as a grid of 50 columns in areas of 4 by 25 cells, with an outlet each (but every seventh); surface classes by size."""
    k = F.col("p_partkey")
    row, col = F.floor(k / 50), k % 50
    area = F.floor(row / 4) * 2 + F.floor(col / 25)
    g = table(spark, d, "part").select(k.alias("k"), row.alias("row"), col.alias("col"), area.alias("area"), (row * 52 + col + 53).alias("cell"), F.col("p_size").alias("size"), F.round(F.col("p_retailprice") + F.col("p_size") * 7.25, 2).alias("z"))
    gone = F.col("k") % 23 == 0
    elevation = g.select("cell", F.when(~gone, F.col("z")).alias("value"), F.when(gone, "missing").otherwise("available").alias("status"))
    no_class = (F.col("k") % 61 == 0) & (F.col("area") % 2 == 0)
    cls = F.when(F.col("size") >= 48, "surface_water").when(F.col("size") == 47, "structural_barrier").otherwise("road")
    surface = g.select("cell", F.when(~no_class, cls).alias("value"), F.when(no_class, "stale").otherwise("available").alias("status"))
    outlets = g.where((F.col("row") % 4 == 2) & (F.col("col") % 25 == 12) & (F.col("area") % 7 != 5)).select("area", F.concat(F.lit("o"), F.col("area").cast("string")).alias("node_id"), "cell")
    states = F.element_at(F.array(*map(F.lit, ("known_upstream_path", "direction_conflict", "blocked_by_unresolved_direction", "isolated"))), (F.col("area") % 4 + 1).cast("int"))
    connectivity = outlets.where("area % 11 <> 8").select(F.col("node_id").alias("outfall_id"), states.alias("status"))
    old = F.col("k") % 499 == 0
    layer = lambda v, bad: g.select("cell", F.when(~bad, v).cast("double").alias("value"), F.when(bad, "stale").otherwise("available").alias("status"), F.when(bad, "old").alias("reason"))
    layers = {"rain": layer(F.col("k") % 50, old), "slope": layer(F.col("k") % 40, F.lit(False)), "land_cover": layer(100 * (1 + F.col("k") % 5) + 11, F.lit(False))}
    adjacency = g.select("cell", F.explode(F.transform(F.array(*map(F.lit, _STEPS)), lambda o: F.col("cell") + o)).alias("nbr"))
    near = adjacency.join(g.select(F.col("cell").alias("nbr")).hint("merge"), "nbr", "left_semi").select("cell", "nbr")
    targets = g.select("area", F.col("area").alias("tile"), "cell", F.lit(900.0).alias("area_m2"))
    gaps = elevation.where("value IS NULL").select("cell")
    return observed.observed_surface(targets, adjacency, elevation, surface, outlets, connectivity, layers, grid.rings(near, gaps, 2).where("steps > 0"), most=5)


_X08 = f"""g AS (SELECT p_partkey AS k, p_partkey // 50 AS row, p_partkey % 50 AS col, p_partkey // 50 // 4 * 2 + p_partkey % 50 // 25 AS area, p_partkey // 50 * 52 + p_partkey % 50 + 53 AS cell, p_size AS size, round(p_retailprice + p_size * 7.25e0, 2) AS z FROM part),
el AS (SELECT cell, CASE WHEN k % 23 <> 0 THEN z END AS v FROM g),
out_ AS (SELECT area, 'o' || area AS node_id, cell FROM g WHERE row % 4 = 2 AND col % 25 = 12 AND area % 7 <> 5),
k1 AS (SELECT a.cell, b.cell AS nbr FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell <> b.cell),
cl AS (SELECT g.*, o.cell IS NOT NULL AS outlet, el.v, CASE WHEN k % 61 = 0 AND g.area % 2 = 0 THEN 'unresolved_missing_surface_class' WHEN size >= 48 AND o.cell IS NULL THEN 'excluded_observed_surface_water'
  WHEN size = 47 AND o.cell IS NULL THEN 'excluded_observed_structural_barrier' WHEN el.v IS NOT NULL THEN 'retain_observed_ahn_area_mean' END AS m FROM g JOIN el ON el.cell = g.cell LEFT JOIN out_ o ON o.cell = g.cell),
don AS (SELECT a.cell, greatest(abs(a.row - b.row), abs(a.col - b.col)) AS steps, el.v, row_number() OVER (PARTITION BY a.cell ORDER BY greatest(abs(a.row - b.row), abs(a.col - b.col)), b.cell) AS rn
  FROM cl a JOIN g b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 AND a.cell <> b.cell JOIN el ON el.cell = b.cell WHERE a.m IS NULL AND el.v IS NOT NULL),
idw AS (SELECT cell, CASE WHEN count(*) >= 3 THEN sum(v / steps) / sum(1e0 / steps) END AS made FROM don WHERE rn <= 18 GROUP BY cell),
prep AS MATERIALIZED (SELECT cl.*, coalesce(m, CASE WHEN made IS NULL THEN 'unresolved_insufficient_ahn_neighbors' ELSE 'idw_from_observed_ahn_neighbors' END) AS method,
  CASE WHEN m = 'retain_observed_ahn_area_mean' THEN v WHEN m IS NULL THEN made END AS terrain FROM cl LEFT JOIN idw ON idw.cell = cl.cell),
side AS (SELECT a.cell, bool_or(b.area = a.area AND b.method = 'excluded_observed_surface_water') AS wet, count(*) FILTER (WHERE b.area = a.area) < 8 AS edge
  FROM prep a LEFT JOIN k1 ON k1.cell = a.cell LEFT JOIN prep b ON b.cell = k1.nbr GROUP BY a.cell),
z AS MATERIALIZED (SELECT p.cell, p.area, terrain AS z, CASE WHEN outlet THEN 0 WHEN wet THEN 1 WHEN edge THEN 2 END AS rank FROM prep p JOIN side ON side.cell = p.cell WHERE terrain IS NOT NULL),
near AS MATERIALIZED (SELECT a.cell, b.cell AS nbr, a.z FROM k1 JOIN z a ON a.cell = k1.cell JOIN z b ON b.cell = k1.nbr AND a.area = b.area),
{flood_sql("s", "SELECT cell, z AS w, CASE WHEN rank IS NOT NULL THEN z END AS l FROM z", "SELECT cell, nbr FROM near", "greatest(n.l, r.w)", "l AS spill")},
kept AS (SELECT n.cell, n.nbr FROM near n JOIN s a ON a.cell = n.cell JOIN s b ON b.cell = n.nbr WHERE greatest(n.z, b.spill) = a.spill),
{flood_sql("f", "SELECT z.cell, spill - z AS w, CASE WHEN rank IS NOT NULL THEN 0e0 END AS l FROM z JOIN s ON s.cell = z.cell WHERE spill IS NOT NULL", "SELECT cell, nbr FROM kept", "greatest(n.l, r.w)", "l AS fill, w AS own")},
both_ AS (SELECT k.cell, k.nbr FROM kept k JOIN f a ON a.cell = k.cell JOIN f b ON b.cell = k.nbr WHERE greatest(b.fill, a.own) = a.fill),
{flood_sql("t", "SELECT z.cell, 0 AS w, CASE WHEN rank IS NOT NULL THEN struct_pack(rank := rank, steps := 0::BIGINT, terminal := z.cell) END AS l FROM z JOIN s ON s.cell = z.cell WHERE spill IS NOT NULL", "SELECT cell, nbr FROM both_", "struct_pack(rank := n.l.rank, steps := n.l.steps + 1, terminal := n.l.terminal)", "l")},
cells AS MATERIALIZED (SELECT p.area, p.cell, k, method, terrain, spill, spill - terrain AS fill_m, l.steps AS steps, l.terminal AS terminal,
  CASE WHEN method LIKE 'excluded%' THEN method WHEN spill IS NULL THEN 'incomplete_conditioning' WHEN l.rank = 0 THEN 'conditioned_outfall_terminal' WHEN l.rank = 1 THEN 'observed_surface_water_exit' ELSE 'analysis_bbox_exit' END AS termination
  FROM prep p LEFT JOIN s ON s.cell = p.cell LEFT JOIN t ON t.cell = p.cell)"""


@query(f"""WITH RECURSIVE {_X08}
SELECT area, cell, method, round(terrain, 5) AS terrain, round(spill, 5) AS hydrologic, round(fill_m, 5) AS fill_m, steps, terminal, termination, CASE WHEN termination <> 'incomplete_conditioning' THEN termination = 'conditioned_outfall_terminal' END AS contributes FROM cells""")
def x08_surface_cells(spark, d):
    r5 = lambda c: F.round(c, 5).alias(c)
    return _surface(spark, d)[0].select("area", "cell", "method", r5("terrain"), r5("hydrologic"), r5("fill_m"), "steps", "terminal", "termination", "contributes")


@query(f"""WITH RECURSIVE {_X08},
per AS (SELECT area, count(*) AS n_target, count(*) FILTER (WHERE spill IS NOT NULL AND method LIKE 'retain%') AS n_observed, count(*) FILTER (WHERE spill IS NOT NULL AND method LIKE 'idw%') AS n_interpolated,
  count(*) FILTER (WHERE termination LIKE 'excluded%water') AS n_water, count(*) FILTER (WHERE termination LIKE 'excluded%barrier') AS n_barrier, count(*) FILTER (WHERE termination LIKE 'incomplete%') AS n_unresolved, count(*) FILTER (WHERE fill_m > 1e-9) AS n_raised,
  count(*) FILTER (WHERE termination LIKE 'conditioned%') AS n_contributing, count(*) FILTER (WHERE termination LIKE 'analysis%') AS n_edge_exit, count(*) FILTER (WHERE termination LIKE 'observed%') AS n_water_exit,
  bool_or(k % 61 = 0 AND area % 2 = 0) AS stale, bool_or(k % 23 = 0) AS missing FROM cells GROUP BY area),
a AS (SELECT per.*, node_id, CASE WHEN node_id IS NULL THEN 'out_of_coverage' WHEN area % 11 = 8 THEN 'invalid_response' WHEN n_unresolved = 0 THEN 'available' WHEN stale THEN 'stale' WHEN missing THEN 'missing' ELSE 'invalid_response' END AS status,
  node_id IS NOT NULL AND area % 11 <> 8 AS reached, n_unresolved = 0 AS whole, ['known_upstream_path', 'direction_conflict', 'blocked_by_unresolved_direction', 'isolated'][area % 4 + 1] AS con FROM per LEFT JOIN out_ USING (area)),
ch AS (SELECT c.*, row_number() OVER (PARTITION BY terminal ORDER BY steps, cell) AS rn FROM cells c WHERE termination LIKE 'conditioned%'),
ru AS (SELECT area, count(*) AS n_selected, bool_or(k % 499 = 0) AS old, sum((k % 50) * least(1e0, CASE k % 5 WHEN 0 THEN 0.80e0 WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.20e0 WHEN 3 THEN 0.30e0 ELSE 1.00e0 END + least(k % 40, 30) / 30e0 * 0.1e0) / 1000 * 900) AS vol FROM ch WHERE rn <= 5 GROUP BY area),
st AS (SELECT a.*, r.n_selected, r.vol, CASE WHEN NOT reached OR NOT whole THEN status WHEN r.old THEN 'stale' WHEN r.n_selected IS NULL THEN 'invalid_response' ELSE 'available' END AS runoff_status FROM a LEFT JOIN ru r ON r.area = a.area AND a.whole)
SELECT area, node_id, status, CASE WHEN reached AND whole THEN n_contributing * 900e0 END AS value, CASE WHEN reached THEN n_contributing * 900e0 END AS partial, CASE WHEN reached THEN n_target END AS n_target, CASE WHEN reached THEN n_observed END AS n_observed,
  CASE WHEN reached THEN n_interpolated END AS n_interpolated, CASE WHEN reached THEN n_water END AS n_water, CASE WHEN reached THEN n_barrier END AS n_barrier, CASE WHEN reached THEN n_unresolved END AS n_unresolved, CASE WHEN reached THEN n_raised END AS n_raised,
  CASE WHEN reached THEN n_contributing END AS n_contributing, CASE WHEN reached THEN n_edge_exit END AS n_edge_exit, CASE WHEN reached THEN n_water_exit END AS n_water_exit, CASE WHEN reached THEN n_selected END AS n_selected, CASE WHEN reached THEN n_selected = n_contributing END AS covers_all,
  CASE WHEN runoff_status = 'available' THEN round(vol, 6) END AS runoff_m3, runoff_status,
  CASE WHEN NOT reached THEN 'conditioned_surface_unavailable' ELSE concat_ws(',', 'not_observed_sewer_catchment', CASE WHEN runoff_status <> 'available' THEN 'environmental_runoff_incomplete' END,
    CASE con WHEN 'blocked_by_unresolved_direction' THEN 'outfall_network_direction_unresolved' WHEN 'known_upstream_path' THEN NULL ELSE 'outfall_network_' || con END) END AS blocking_reasons,
  CASE WHEN reached THEN 'blocked_before_propagation' ELSE 'not_attempted' END AS propagation FROM st""")
def x08_observed_surface(spark, d):
    out = _surface(spark, d)[1].drop("eligible")
    return out.withColumns({"runoff_m3": r6("runoff_m3"), "blocking_reasons": F.array_join("blocking_reasons", ",")})


# Forcing ------------------------------------------------------------------------------------


@query(f"""WITH {RECTANGLES_SQL}, i AS (SELECT unnest(range(8))::INT AS interval), j AS (SELECT unnest(range(4))::INT AS slot),
rain AS (SELECT source, slot, CASE WHEN source % 97 <> 0 THEN (source * (slot + 3)) % 40 / 4e0 END AS mm FROM src, j),
fell AS (SELECT target, slot, sum(mm * (area / 100)) AS mm, count(*) - count(mm) AS dry FROM pairs JOIN rain USING (source) WHERE target % 9 <> 0 GROUP BY ALL),
wt AS (SELECT source, target, area / sum(area) OVER (PARTITION BY source) AS weight FROM pairs WHERE source % 10 = 7),
flow AS (SELECT target, interval, sum(CASE WHEN source % 70 <> 67 OR interval <> 5 THEN source % 11 * (interval + 1) / 2e0 END * weight) AS m3, count(*) FILTER (WHERE source % 70 = 67 AND interval = 5) AS lost FROM wt, i GROUP BY ALL),
f AS (SELECT t.target AS cell, i.interval, CASE WHEN t.target % 9 = 0 OR dry IS NULL THEN 0 WHEN dry = 0 THEN mm / 1000 / 1800 * (0.2e0 + t.target % 5 / 10e0) END AS r, CASE WHEN lost IS NULL THEN 0 WHEN lost = 0 THEN m3 END AS q
  FROM tgt t CROSS JOIN i LEFT JOIN fell ON fell.target = t.target AND fell.slot = i.interval // 2 LEFT JOIN flow ON flow.target = t.target AND flow.interval = i.interval)
SELECT cell, interval, round(r * 1e9, 4) AS rain_nm_s, round(q, 6) AS river_m3_s, CASE WHEN r IS NULL OR q IS NULL THEN 'missing' ELSE 'available' END AS status FROM f""")
def l03_forcing_frames(spark, d):
    """Rectangles of suppliers as rain cells and as river stations, over those of customers, eight intervals in four slots."""
    targets, sources = rectangles(spark, d)
    mapping = geometry.overlaps(targets, sources, 25.0)
    k, t = F.col("source"), F.col("id")
    each = sources.select(t.alias("source"))
    rain = each.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("amount_mm", F.when(k % 97 != 0, (k * (F.col("slot") + 3)) % 40 / 4.0))
    rivers = each.where(k % 10 == 7).withColumn("interval", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rivers = rivers.where((k % 70 != 67) | (F.col("interval") != 5)).withColumn("excess_m3_s", k % 11 * (F.col("interval") + 1) / 2.0)
    weights = geometry.footprint_weights(mapping.where(k % 10 == 7))
    cells = targets.select(t.alias("cell"), (t % 9 != 0).alias("valid"), (0.2 + t % 5 / 10.0).alias("coefficient"))
    out = forcing.forcing_frames(cells, mapping, rain, weights, rivers, 8)
    return out.select("cell", "interval", F.round(F.col("rain_m_s") * 1e9, 4).alias("rain_nm_s"), r6("river_m3_s").alias("river_m3_s"), "status")


def l04_event_scenarios(spark, d):
    """Three scenarios on the basin of all parts: rain of the suppliers of a part by their share of its lines, rivers
    from every tenth supplier by its own shares, frames by cell (L03), stepped (L02). No SQL can step it."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(a).alias("scenario"), F.lit(b).alias("coefficient"), F.lit(c).alias("manning")) for i, (a, b, c) in enumerate([("low", 0.3, 0.03), ("middle", 0.6, 0.05), ("high", 0.9, 0.08)])))
    ground = part_grid(spark, d).withColumn("k", F.explode(kinds)).select((F.col("idx") * 3 + F.col("k.kind")).alias("cell"), "row", "col", "size", "k.scenario", "k.coefficient", "k.manning")
    mesh = ground.select("*", F.when(F.col("size") < 50, F.col("row") * 0.05 + F.col("size") / 100).alias("elevation"), F.lit(0.0).alias("depth"), (F.col("size") < 50).alias("valid"))
    lines = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("source")).count()
    of = lambda key: lines.join(lines.groupBy(key).agg(F.sum("count").alias("n")).hint("merge"), key).select("l_partkey", "source", (F.col("count") / F.col("n")).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("kind")).withColumn("target", F.col("l_partkey") * 3 + F.col("kind"))
    mapping = of("l_partkey").select("target", "source", F.col("share").alias("fraction"))
    # what a river brings to cells that take no part is left out
    weights = of("source").where("source % 10 = 7").join(mesh.where("valid").select(F.col("cell").alias("target")).hint("merge"), "target", "left_semi").select("target", "source", F.col("share").alias("weight"))
    k = F.col("source")
    each = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"))
    rain = each.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("amount_mm", k * (F.col("slot") + 3) % 40 / 4.0)
    rivers = each.where(k % 10 == 7).withColumn("interval", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("excess_m3_s", k % 11 * (F.col("interval") + 1) / 20.0)
    frames = solver.packed(forcing.forcing_frames(mesh, mapping, rain, weights, rivers, 8, 2, 600.0), "cell")
    out = solver.event_scenarios(mesh.join(frames.hint("merge"), "cell"), [300.0 * i for i in range(9)], 10.0, 300.0)
    return out.select("scenario", "row", "col", "status", r6("max_depth").alias("max_depth"), "max_index", r6("final_depth").alias("final_depth"), "wet", r6("volume_rain").alias("volume_rain"), r6("volume_river").alias("volume_river"), F.round("volume_out", 3).alias("volume_out"))


QUERIES["l04_event_scenarios"] = l04_event_scenarios
