"""Registered queries: compositions, inventories and the cell index over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import cube, evidence, gates, geometry, grid, metrics, network, runoff, series
from . import pipelines as P
from .adapters import CATCHMENT_SQL, GRID_SQL, NETWORK_SQL, RECTANGLES_SQL, catchment_cells, part_grid, pipes_and_nodes, points, r6, rectangles, shown, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CATCHMENT_SQL},
t AS (SELECT catchment_id, CASE WHEN count(*) FILTER (WHERE gone) = 0 THEN sum(runoff / 1000 * area) END AS v, count(*) FILTER (WHERE status = 'rate_limited') AS rl, count(*) FILTER (WHERE status = 'stale') AS st, count(*) FILTER (WHERE fixture AND NOT gone) AS fx FROM cells GROUP BY 1),
j AS (SELECT o_custkey, v, CASE WHEN catchment_id IS NULL THEN 'missing' WHEN rl > 0 THEN 'rate_limited' WHEN st > 0 THEN 'stale' WHEN fx > 0 THEN 'synthetic_fixture' ELSE 'available' END AS s FROM orders LEFT JOIN t ON catchment_id = o_orderkey)
SELECT c_custkey AS node_id, CASE WHEN count(o_custkey) = 0 THEN 0e0 WHEN count(*) FILTER (WHERE v IS NULL) = 0 THEN round(sum(v) + 0.0000123456e0, 3) END AS value,
  CASE WHEN count(o_custkey) = 0 THEN 'available' WHEN bool_or(s = 'rate_limited') THEN 'rate_limited' WHEN bool_or(s = 'stale') THEN 'stale' WHEN bool_or(s = 'missing') THEN 'missing' WHEN bool_or(s = 'synthetic_fixture') THEN 'synthetic_fixture' ELSE 'available' END AS status
FROM customer LEFT JOIN j ON o_custkey = c_custkey GROUP BY c_custkey""")
def a06_node_sources(spark, d):
    cells = catchment_cells(spark, d).withColumn("runoff", runoff.runoff("rain", "slope", "land_cover"))
    att = table(spark, d, "orders").select(F.col("o_orderkey").alias("catchment_id"), F.col("o_custkey").alias("outlet_node_id"))
    out = P.node_sources(table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), att, runoff.catchment_totals(runoff.cell_volumes(cells)))
    value = F.when(F.col("n_inputs") == 0, F.col("value")).otherwise(F.round(F.col("value") + 0.0000123456, 3))
    return out.select("node_id", value.alias("value"), "status")


@query(f"WITH {NETWORK_SQL}, x AS (SELECT CASE WHEN a.level IS NULL OR b.level IS NULL THEN 'unknown' WHEN a.level = b.level OR abs(a.level - b.level) + 1e-6 < 1 THEN 'ambiguous' ELSE 'known' END AS status FROM pipes JOIN nodes a ON a.node_id = node_a JOIN nodes b ON b.node_id = node_b) SELECT status, count(*) AS n FROM x GROUP BY status")
def a21_direction_counts(spark, d):
    return network.direction_counts(network.oriented(*pipes_and_nodes(spark, d), min_drop=1.0))


@query("SELECT round(sum(o_totalprice), 1) AS volume_in, round(sum(o_totalprice), 1) AS volume_out, true AS balanced FROM orders JOIN customer ON c_custkey = o_custkey")
def a25_mass_balance(spark, d):
    pipes, nodes = pipes_and_nodes(spark, d)
    own = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id")).agg(F.sum("o_totalprice").alias("value"))
    sources = nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("value", F.lit(0.0)).alias("own"))
    out = network.mass_balance(network.forest(pipes.select(F.col("node_a").alias("node_id"), F.col("node_b").alias("down")), sources))
    return out.select(F.round("volume_in", 1).alias("volume_in"), F.round("volume_out", 1).alias("volume_out"), "balanced")


@query("""
SELECT count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS n_early, count(DISTINCT o_custkey) AS n_customers FROM orders""")
def a20_inventory(spark, d):
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return o.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.count_if(early).alias("n_early"), F.count_distinct("o_custkey").alias("n_customers"))


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1")
def a19_group_rollup(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"), day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"))


@query("SELECT s_nationkey AS asset_id, max(s_acctbal) AS max_score, round(avg(s_acctbal), 6) AS mean_score, count(*) AS n_cells, count(*) - count(s_acctbal) AS n_unscored FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier) GROUP BY 1")
def a23_asset_risk(spark, d):
    s = table(spark, d, "supplier")
    out = P.asset_risk(s.select(F.col("s_nationkey").alias("asset_id"), F.col("s_suppkey").alias("cell")), s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("score")))
    return out.select("asset_id", "max_score", r6("mean_score").alias("mean_score"), "n_cells", "n_unscored")


@query("""
WITH r AS (SELECT user_id AS cell, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), s AS (SELECT user_id AS cell, CASE WHEN max(value) > 60 THEN NULL ELSE max(value) END AS v FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY 1)
SELECT c_custkey AS cell, 'rain' AS layer, 'invalid_response' AS status FROM customer WHERE c_custkey NOT IN (SELECT cell FROM r)
UNION ALL SELECT c_custkey, 'slope', CASE WHEN s.cell IS NULL THEN 'invalid_response' ELSE 'stale' END FROM customer LEFT JOIN s ON s.cell = c_custkey WHERE s.v IS NULL""")
def j22_evidence_issues(spark, d):
    e = table(spark, d, "events")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    own = lambda df: df.select("cell", "value", F.when(F.col("value").isNull(), "stale").otherwise("available").alias("status"), F.when(F.col("value").isNull(), "old").alias("reason"))
    rain = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("cell")).agg(F.max("value").alias("value"))
    slope = e.where("event_type = 'click' AND user_id % 3 <> 0").groupBy(F.col("user_id").alias("cell")).agg(F.max("value").alias("value")).withColumn("value", F.when(F.col("value") <= 60, F.col("value")))
    return evidence.requested(asked, {"rain": own(rain), "slope": own(slope)}, "cell")[1].select("cell", "layer", "status")


@query("""
WITH p AS (SELECT c_custkey, -89 + (c_custkey * 7 % 1780) / 10e0 AS lat, -179 + (c_custkey * 13 % 3580) / 10e0 AS lon FROM customer)
SELECT 'q5_' || floor((lat + 90) / 0.25e0)::BIGINT || '_' || floor((lon + 180) / 0.25e0)::BIGINT AS cell, count(*) AS n, round(avg(c_custkey), 6) AS mean_key FROM p GROUP BY 1""")
def x03_point_scores(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k, (-89 + (k * 7 % 1780) / F.lit(10.0)).alias("lat"), (-179 + (k * 13 % 3580) / F.lit(10.0)).alias("lon"))
    return P.point_scores(p, ["c_custkey"], 5).select("cell", "n", r6("c_custkey").alias("mean_key"))


@query("""
WITH c AS (SELECT c_custkey // 40 AS i, c_custkey % 40 AS j FROM customer)
SELECT 'q9_' || (a.i + 2000) || '_' || (a.j + 100) AS cell, count(*) AS n_inside FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY 1""")
def p49_neighbours(spark, d):
    k = F.col("c_custkey")
    cells = table(spark, d, "customer").select(F.concat_ws("_", F.lit("q9"), (F.floor(k / 40) + 2000).cast("string"), (k % 40 + 100).cast("string")).alias("cell"))
    near = C.neighbours_of(cells, 9).join(cells.select(F.col("cell").alias("nbr")), "nbr")
    return near.groupBy("cell").agg(F.count(F.lit(1)).alias("n_inside"))


@query("""
WITH c AS (SELECT c_custkey AS k, -90 + (c_custkey % 180)::DOUBLE AS south FROM customer)
SELECT 'q3_' || (k % 180) || '_' || (k % 360) AS cell, south + 0.5e0 AS lat, round(pow(6371000e0, 2) * radians(1e0) * (sin(radians(south + 1)) - sin(radians(south))), 0) AS area_m2 FROM c""")
def p48_p51_cell_info(spark, d):
    k = F.col("c_custkey")
    cells = table(spark, d, "customer").select(F.concat_ws("_", F.lit("q3"), (k % 180).cast("string"), (k % 360).cast("string")).alias("cell"))
    i = C.cell_info(F.col("cell"))
    return cells.select("cell", i["lat"].alias("lat"), F.round(i["area_m2"], 0).alias("area_m2"))


@query("""
SELECT c_custkey AS point_id, CASE WHEN v < -0.5e0 OR v > 9.5e0 THEN NULL ELSE least(9, ceil(v - 0.5e0)::INT) END AS idx FROM (SELECT c_custkey, c_acctbal / 1000 AS v FROM customer)""")
def j10_nearest_axis_value(spark, d):
    out = grid.nearest_index(F.col("c_acctbal") / 1000, [float(i) for i in range(10)])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), out.alias("idx"))


@query(f"""WITH {GRID_SQL}, p AS (SELECT c_custkey AS point_id, 50 - (c_custkey % 60) * 0.7e0 - 0.31e0 AS lat, (c_custkey % 71) * 0.8e0 + 0.17e0 AS lon FROM customer)
SELECT point_id, CASE WHEN g.idx IS NOT NULL THEN elevation END AS value, CASE WHEN g.idx IS NULL THEN 'out_of_coverage' WHEN elevation IS NULL THEN 'missing' ELSE 'available' END AS status
FROM p LEFT JOIN grid g ON g.row = floor(50 - lat) AND g.col = floor(lon)""")
def r04_nearest_pixel(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("point_id"), (50 - (k % 60) * 0.7 - 0.31).alias("lat"), ((k % 71) * 0.8 + 0.17).alias("lon"))
    return grid.nearest_pixel(p, part_grid(spark, d), 0.0, 50.0, 1.0, "elevation").select("point_id", "value", "status")


@query("SELECT o_orderkey, CASE WHEN w THEN 0e0 WHEN s IS NULL THEN NULL ELSE s END AS final_score, CASE WHEN w THEN 'water_zero' WHEN s IS NULL THEN 'excluded' ELSE 'score' END AS score_kind FROM (SELECT o_orderkey, o_orderstatus = 'P' AS w, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS s FROM orders)")
def m01_score_vector(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("w"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")).alias("s"))
    return metrics.score_vector(o, "s", "w").select("o_orderkey", "final_score", "score_kind")


@query("""
WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1)
SELECT user_id AS k, CASE WHEN a >= 10 THEN a::DOUBLE END AS gauge_total, CASE WHEN b >= 10 THEN b::DOUBLE END AS grid_total, CASE WHEN a >= 10 AND b >= 10 THEN (b - a)::DOUBLE END AS difference FROM g""")
def m11_gauge_comparison(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    side = lambda c: e.select("k", F.when(F.col(c) >= 10, F.col(c).cast("double")).alias("total"), F.when(F.col(c) >= 10, "available").otherwise("incomplete_window").alias("status"))
    return series.gauge_comparison(side("a"), side("b"), ["k"]).select("k", "gauge_total", "grid_total", "difference")


@query("SELECT o_custkey, o_orderkey, baseline FROM (SELECT o_custkey, o_orderkey, first(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS baseline, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w04_first_sample(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("baseline"))
    return series.first_of(o, ["o_custkey"], [F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "baseline")


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN u THEN 'incomplete_direction' END, CASE WHEN o_orderkey % 5 = 0 THEN 'incomplete_evidence' END, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported_divergence' END, CASE WHEN o_orderstatus = 'P' THEN 'cyclic' END) AS reasons FROM (SELECT *, o_orderkey % 3 = 0 AS u FROM orders)""")
def v09_propagation_reasons(spark, d):
    k = F.col("o_orderkey")
    zero = lambda m: F.when(k % m == 0, 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(gates.propagation_reasons(zero(3), zero(5), zero(7), F.col("o_orderstatus") == "P"), ",").alias("reasons"))


@query("""
WITH c AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_tax > 0.04e0 AND l_discount > 0.05e0) AS tp, count(*) FILTER (WHERE l_tax <= 0.04e0 AND l_discount > 0.05e0) AS fp, count(*) FILTER (WHERE l_tax > 0.04e0 AND l_discount <= 0.05e0) AS fn FROM lineitem GROUP BY 1)
SELECT id, 'iou' AS rule FROM c WHERE id % 10 = 0 AND tp + fp + fn > 0 UNION ALL SELECT id, 'precision' FROM c WHERE id % 15 = 0 AND tp + fp > 0""")
def v04_metric_consistency(spark, d):
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / F.when(y > 0, y))
    tp, fp, fn, k = F.col("tp"), F.col("fp"), F.col("fn"), F.col("id")
    c = c.withColumns({"iou": ratio(tp, tp + fp + fn) + F.when(k % 10 == 0, 0.1).otherwise(0.0), "precision": ratio(tp, tp + fp) + F.when(k % 15 == 0, 0.1).otherwise(0.0), "recall": ratio(tp, tp + fn)})
    return gates.broken(c, "id", gates.metric_consistent("tp", "fp", "fn", "iou", "precision", "recall"))


@query(f"""WITH {RECTANGLES_SQL}, p AS (SELECT t.target, coalesce(sum(area), 0) AS mapped, coalesce(sum(area) FILTER (WHERE value IS NOT NULL), 0) AS observed, sum(value * area) FILTER (WHERE value IS NOT NULL) AS w, count(value) AS n, min(value) AS one FROM tgt t LEFT JOIN pairs USING (target) GROUP BY t.target)
SELECT target, round(CASE WHEN n = 1 THEN one WHEN n > 1 THEN w / observed END, 3) AS partial_mean, CASE WHEN abs(observed - 100) <= 1e-4 AND mapped <= 100 + 1e-4 THEN round(CASE WHEN n = 1 THEN one ELSE w / observed END, 3) END AS mean FROM p""")
def x12_evidence_cell(spark, d):
    t, s = rectangles(spark, d)
    pieces = geometry.overlaps(t, s, 25.0).join(s.select(F.col("id").alias("source"), "value", "category"), "source").withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("available"))
    out = P.evidence_cell(pieces, t.select(F.col("id").alias("target"), F.lit(100.0).alias("area_m2")))
    return out.select("target", F.round("partial_mean", 3).alias("partial_mean"), F.round("mean", 3).alias("mean"))


@query(f"""WITH {GRID_SQL}, b AS (SELECT row // 4 AS row, col // 4 AS col, count(elevation) AS n, avg(elevation) AS v FROM grid GROUP BY 1, 2), l AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM b)
SELECT b.row, b.col, round(v, 6) AS elevation FROM b, l WHERE n = 16 AND b.row BETWEEN r0 + 1 AND r1 - 1 AND b.col BETWEEN c0 + 1 AND c1 - 1
  AND NOT EXISTS (SELECT 1 FROM b x WHERE x.n < 16 AND abs(x.row - b.row) <= 1 AND abs(x.col - b.col) <= 1)""")
def x10_solver_grid(spark, d):
    return P.solver_grid(part_grid(spark, d), 4, 1).select("row", "col", r6("elevation").alias("elevation"))


@query("""
SELECT user_id::VARCHAR AS cell, event_type AS variable, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, list_last(list(value ORDER BY ts, value)) AS last_value FROM events GROUP BY ALL""")
def w02_time_series(spark, d):
    s = cube.time_series(points(spark, d).withColumn("quality", F.lit(None).cast("double")))
    return s.select("cell", "variable", F.size("points").cast("long").alias("n"), shown(F.col("points")[0]["ts"]).alias("first_ts"), F.element_at("points", -1)["value_num"].alias("last_value"))


@query("SELECT o_custkey AS cell FROM orders UNION SELECT user_id FROM events")
def t06_union_of_cells(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("cell")).union(table(spark, d, "events").select("user_id")).distinct()


@query("""
WITH s AS (SELECT c_custkey AS cell, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS kept FROM customer)
SELECT cell, CASE WHEN kept IS NOT NULL THEN 'cache' ELSE 'computed' END AS source, round(coalesce(kept, (0.6e0 * least(cell % 50, 45) / 45 + 0.4e0 * CASE WHEN cell % 50 < 10 THEN 0.1e0 WHEN cell % 50 < 20 THEN 0.3e0 WHEN cell % 50 < 30 THEN 0.5e0 WHEN cell % 50 < 40 THEN 0.7e0 ELSE 0.85e0 END
  + CASE WHEN cell % 50 > 45 THEN 0.6e0 * 0.3e0 * (cell % 50 - 45) / 25 ELSE 0 END + 0.1e0 + least(1e0, (cell % 50) / 20e0) + 0.1e0) / 4), 6) AS score FROM s""")
def x04_area_scores(spark, d):
    c = table(spark, d, "customer")
    slope = c.select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 50).cast("double").alias("value"), F.lit("available").alias("status"), F.lit(None).cast("string").alias("reason"))
    kept = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("score"))
    return P.area_scores(c.select(F.col("c_custkey").alias("cell")), kept, {"slope": slope}, ["slope"]).select("cell", "source", r6("score").alias("score"))


@query("SELECT sum(n) AS n, sum(k) AS k FROM (SELECT count(*) AS n, sum(doc_id) AS k FROM documents)")
def t11_chunks(spark, d):
    """Chunks are partitions; a reader takes them one by one (toLocalIterator) or as a stream."""
    x = table(spark, d, "documents").repartition(7, "doc_id").groupBy(F.spark_partition_id().alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("k"))
    return x.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
