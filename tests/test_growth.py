"""What must not grow with copies, nor pass through the driver."""

import time

from pyspark.sql import functions as F

from terralith.operators import cells, flood, geometry, grid, network, solver
from terralith.plans import observed, pipelines, queries_observed
from terralith.sources.intermediate import written


def test_copies_of_places_and_polygons_meet_once(spark):
    """4e8 pairs of copies: met one by one they take minutes."""
    began = time.time()
    pts = spark.range(20_000).select(F.col("id").alias("point_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")).unionByName(spark.sql("SELECT -1L AS point_id, CAST(NULL AS DOUBLE) AS x, 1D AS y"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    tri = spark.range(20_000).select((F.col("id") + 7).alias("polygon_id"), (F.col("id") % 5).alias("priority"), F.array(F.array(corner(0.0, 0.0), corner(6.0, 0.0), corner(0.0, 4.0))).alias("rings"))
    out = geometry.containing(pts, tri, 5.0)
    assert out.columns == ["point_id", "x", "y", "polygon_id", "n_containing"]
    assert {tuple(r) for r in out.groupBy("polygon_id", "n_containing").count().collect()} == {(7, 20_000, 20_000), (None, 0, 1)}
    assert time.time() - began < 60


def test_points_of_one_place_look_for_a_node_once(spark, monkeypatch):
    rows = {}

    def counted(df, name="step"):
        out = written(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(cells, "written", counted)
    pts = spark.range(500).select(F.col("id").alias("point_id"), F.lit(46.0).alias("lat"), (11 + F.col("id") % 2).cast("double").alias("lon"))
    nodes = spark.range(300).select((300 - F.col("id")).alias("node_id"), F.lit(46.0).alias("lat"), F.lit(11.001).alias("lon"))
    out = cells.nearest_node(pts, nodes)
    assert {tuple(r) for r in out.groupBy("node_id").count().collect()} == {(1, 500)}
    assert max(rows["nearest"]) <= 2


def test_a_codes_pipes_are_counted_before_records_meet_them(spark):
    """9e8 pairs of a record and a pipe of its code: met one by one they take minutes."""
    began = time.time()
    rows = spark.range(30_000).select(F.col("id").alias("record_id"), F.when(F.col("id") > 0, "a").alias("code")).unionByName(spark.sql("SELECT 1L AS record_id, 'a' AS code"))
    aliases = spark.range(30_000).select(F.lit("a").alias("alias"), F.col("id").cast("string").alias("pipe_id"))
    got = network.attached(rows, aliases).groupBy("code", "pipe_id", "status").count().collect()
    assert {tuple(r) for r in got} == {("a", None, "invalid_response", 29_999), (None, None, "missing", 1)}
    assert time.time() - began < 60


def test_points_of_one_place_are_sampled_once(spark, monkeypatch):
    seen = []
    plain = grid.nearest_pixel
    monkeypatch.setattr(grid, "nearest_pixel", lambda points, *a, **b: (seen.append(points.count()), plain(points, *a, **b))[1])
    pts = spark.range(100).select(F.col("id").alias("point_id"), F.when(F.col("id") > 0, 1.5).alias("lat"), F.lit(1.5).alias("lon"))
    pixels = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), F.col("id").cast("double").alias("value"))
    out = grid.terrain_samples(pts, pixels, 0.0, 3.0, 1.0, offset=1.0)
    assert {tuple(r) for r in out.groupBy("elevation", "elevation_status", "slope_status").count().collect()} == {(4.0, "available", "available", 99), (None, "out_of_coverage", "out_of_coverage", 1)}
    assert seen == [10]


def planned(monkeypatch, module) -> list[str]:
    """Plans of the tables that the module writes."""
    plans = []

    def kept(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(module, "written", kept)
    return plans


def test_accumulation_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = planned(monkeypatch, network)
    chain = spark.range(64).select(F.col("id").alias("node_id"), F.when(F.col("id") % 32 != 0, F.col("id") - 1).alias("down"))
    out = network.forest(chain, chain.select("node_id", F.lit(1.0).alias("own")))
    assert {(r.node_id, r.total, r.terminal, r.steps) for r in out.collect()} == {(i, 32.0 - i % 32, i // 32 * 32, i % 32) for i in range(64)}
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)
    # of the joins by jump none takes the nodes that have ended: all of them would meet at null
    assert all("isnotnull(jump" in p for p in plans[1:])


def test_flow_sends_no_table_through_the_driver(spark):
    high = spark.range(50).select(F.col("id").alias("cell"), (F.col("id") * 7 % 13).cast("double").alias("elevation"))
    near = high.select("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("nbr"), F.lit(1.0).alias("dist_m"))
    for out in (grid.immediate_flow(high, near, high.where("cell = 3")), grid.steepest_neighbour(high, near).hint("merge")):
        assert "min_by" in (plan := out._jdf.queryExecution().executedPlan().toString())
        assert plan.count("BroadcastHashJoin") <= (out.columns == ["cell", "down", "grade"])


def test_flood_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = planned(monkeypatch, flood)
    g = spark.range(36).select(F.floor(F.col("id") / 18).alias("tile"), F.col("id").alias("cell"), (F.col("id") * 7 % 13).cast("double").alias("elevation"), F.when(F.col("id") == 0, 1).alias("terminal_rank"))
    near = g.select("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("nbr"))
    assert flood.priority_flood(g, near).where("terminal = 0 AND steps = cell").count() == 36
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_surface_sends_no_table_through_the_driver(spark, tiny, monkeypatch):
    plans = [planned(monkeypatch, m) for m in (observed, pipelines)]
    own, areas = queries_observed._surface(spark, tiny)
    plans = [*plans[0], *plans[1], *(x._jdf.queryExecution().executedPlan().toString() for x in (own, areas))]
    assert len(plans) == 8 and sum(p.count("SortMergeJoin") for p in plans) > 10 and not any("Broadcast" in p for p in plans)


def test_forcing_sends_no_table_through_the_driver(spark, tiny, monkeypatch):
    plans = planned(monkeypatch, solver)
    queries_observed.l04_event_scenarios(spark, tiny)
    assert len(plans) == 1 and plans[0].count("SortMergeJoin") > 6 and "Broadcast" not in plans[0]
