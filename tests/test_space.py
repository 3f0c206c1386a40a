"""Golden cases of networks, grids, geometry, metrics, gates, the solver, sources and streaming."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from terralith.operators import flood, gates, geometry, grid, metrics, network, series, solver
from terralith.plans import forcing, observed
from terralith.plans import pipelines as P
from terralith.sources import readers
from terralith.streaming import ingest


# Networks ---------------------------------------------------------------------------------


def chain(spark, levels, pairs=("AB", "BC")):
    nodes = spark.createDataFrame(list(levels.items()), "node_id string, level double")
    pipes = spark.createDataFrame([(p, p[0], p[1], 100.0) for p in pairs], "pipe_id string, node_a string, node_b string, length_m double")
    return network.oriented(pipes, nodes, min_drop=0.1)


def test_directions_with_tolerance(spark):
    got = {r.pipe_id: r.direction.status for r in chain(spark, {"A": 103.0, "B": 102.0, "C": 101.9000000001, "D": None, "E": float("nan"), "F": 101.85}, ("AB", "BC", "CD", "CE", "CF")).collect()}
    assert got == {"AB": "known", "BC": "known", "CD": "unknown", "CE": "unknown", "CF": "ambiguous"}


def test_accumulation_and_its_refusals(spark):
    own = lambda v: spark.createDataFrame(v, "node_id string, value double, status string")
    ok = own([("A", 7.0, "available"), ("B", 0.0, "available"), ("C", 0.0, "available")])
    status, totals = network.accumulation(chain(spark, {"A": 103.0, "B": 102.0, "C": 101.0}), ok)
    assert status == "complete" and {r.node_id: r.total for r in totals.collect()} == {"A": 7.0, "B": 7.0, "C": 7.0}
    assert network.mass_balance(totals).first().balanced
    assert network.accumulation(chain(spark, {"A": 103.0, "B": None, "C": 101.0}), ok)[0] == "incomplete_direction"
    assert network.accumulation(chain(spark, {"A": 103.0, "B": 102.0, "C": 101.0}), own([("A", None, "stale")]))[0] == "incomplete_evidence"
    assert network.accumulation(chain(spark, {"A": 103.0, "B": 102.0, "C": 101.0}, ("AB", "AC")), ok)[0] == "unsupported_divergence"


def test_forest_equals_a_loop_and_finds_cycles(spark):
    rng = random.Random(5)
    down = {i: rng.randrange(max(0, i - 3), i) if i and i % 50 else None for i in range(400)}
    own = {i: rng.random() for i in down}
    total = dict(own)
    for i in sorted(down, reverse=True):
        if down[i] is not None:
            total[down[i]] += total[i]
    edges = spark.createDataFrame([*((i, d) for i, d in down.items() if d is not None), (1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)], "node_id long, down long")
    sources = spark.createDataFrame([*own.items(), *((i, 1.0) for i in range(1000, 1004))], "node_id long, own double")
    got = {r.node_id: r for r in network.forest(edges, sources).collect()}
    assert all(math.isclose(got[i].total, total[i], rel_tol=1e-9) for i in down)
    assert all(got[i].cyclic and got[i].total is None for i in range(1000, 1004)) and not any(got[i].cyclic for i in down)


def test_reachability_and_issues(spark):
    pipes = chain(spark, {"A": 103.0, "B": 102.0, "C": 101.0})
    got = {(r.outfall_id, r.node_id, r.steps) for r in network.upstream_of(pipes, spark.createDataFrame([("C",)], "node_id string")).collect()}
    assert got == {("C", "C", 0), ("C", "B", 1), ("C", "A", 2)}
    loop = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C")], "from_node string, to_node string")
    assert network.upstream_of(loop, spark.createDataFrame([("C",)], "node_id string")).count() == 3
    nodes = spark.createDataFrame([("n", "inlet", 1.0, 2.0), ("n", "odd", 99.0, 0.0), ("", "inlet", 0.0, 0.0)], "node_id string, type string, lat double, lon double")
    bad = spark.createDataFrame([("p", "n", "x", 0.0), ("p", "n", "n", 1.0), (None, None, "n", 2.0)], "pipe_id string, node_a string, node_b string, length_m double")
    codes = {r.code for r in network.issues(nodes, bad, spark.createDataFrame([("c", "zz")], "catchment_id string, outlet_node_id string")).collect()}
    assert codes == {"duplicate_node_id", "invalid_node_type", "invalid_position", "null_pipe_id", "duplicate_pipe_id", "missing_pipe_endpoint", "self_loop", "invalid_pipe_length", "missing_catchment_outlet"}
    assert [tuple(r) for r in network.issues(nodes.limit(0), bad.limit(0), network_id=" ").collect()] == [("empty_network_id", "network", 1), ("empty_network", "network", 1)]


def test_outfall_connectivity(spark):
    levels = {"A": 103.0, "B": 102.0, "C": 101.0, "D": None, "E": 90.0, "F": 200.0, "G": 95.0}
    kinds = {"C": "outfall", "D": "outfall", "F": "outfall", "G": "outfall"}
    nodes = spark.createDataFrame([(k, kinds.get(k, "manhole"), v) for k, v in levels.items()], "node_id string, type string, level double")
    ends = ("AB", "BC", "AD", "FE", "BF", "BD")
    pipes = spark.createDataFrame([(p, p[0], p[1], 10.0) for p in ends], "pipe_id string, node_a string, node_b string, length_m double")
    paths = network.outfall_paths(network.oriented(pipes, nodes), nodes)
    states = network.outfall_connectivity(paths, nodes)
    got = {r.outfall_id: tuple(r)[1:] for r in states.collect()}
    assert got["C"] == ("known_upstream_path", 3, 3, 2, 0) and got["D"] == ("blocked_by_unresolved_direction", 0, 0, 2, 0)
    assert got["F"] == ("direction_conflict", 0, 0, 0, 2) and got["G"] == ("isolated", 0, 0, 0, 0)
    counts = {r.what: r.n for r in network.connectivity_counts(paths, states).collect()}
    assert (counts["n_nodes"], counts["n_pipes"], counts["n_boundary_pipes"], counts["outfalls isolated"]) == (4, 3, 2, 1)


def test_surface_paths_and_what_they_carry(spark):
    cells = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0), (5, None), (6, 5.0)], "cell int, elevation double")
    near = [(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (4, 3), (6, 4), (6, 99)]
    adjacency = spark.createDataFrame([(a, b, 1.0) for a, b in near], "cell int, nbr int, dist_m double")
    outlets = spark.createDataFrame([(3,)], "cell int")
    paths = P.surface_paths(cells, adjacency, outlets)
    got = {r.cell: (r.terminal, r.n_steps, r.n_cells, r.ends_at, r.contributes) for r in paths.collect()}
    assert got[1] == (3, 2, 1, "outlet", True) and got[3] == (3, 0, 3, "outlet", True)
    assert {got[k][3:] for k in (4, 5, 6)} == {("incomplete_elevation", None)}
    left = {r.cell: r.ends_at for r in P.surface_paths(cells, adjacency, outlets, cells.where("cell <> 2")).collect()}
    assert left[1] == "coverage_exit" and left[3] == "outlet"
    layer = lambda v, gone=(): spark.createDataFrame([(c, None if c in gone else v, "stale" if c in gone else "available", None) for c in (1, 2, 3)], "cell int, value double, status string, reason string")
    areas = spark.createDataFrame([(c, 100.0) for c in (1, 2, 3)], "cell int, area_m2 double")
    layers = {"rain": layer(10.0, (1,)), "slope": layer(0.0), "land_cover": layer(511.0)}
    two = P.conditioned_runoff(paths, areas, layers, most=2).first()
    assert (two.n_candidates, two.n_selected, two.covers_all, two.area_m2, two.status) == (3, 2, False, 200.0, "available") and abs(two.value - 2.0) < 1e-9
    all_ = P.conditioned_runoff(paths, areas, layers).first()
    assert all_.covers_all and all_.value is None and all_.status == "stale" and abs(all_.partial - 2.0) < 1e-9


# Grids ------------------------------------------------------------------------------------


def square(spark, z, water=()):
    rows = [(i, i // 5, i % 5, True, None if v is None else float(v), i in water) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "idx int, row int, col int, inside boolean, elevation double, water boolean")


def test_plane(spark):
    got = {r.idx: r for r in grid.concentration(square(spark, [i % 5 for i in range(25)]), 30.0).collect()}
    assert (got[11].direction, got[11].down, got[13].terminal) == (6, 10, 10)
    assert (got[10].n_cells, got[10].area_m2, got[10].terminal_type) == (4, 3600.0, grid.BOUNDARY)
    assert sum(r.area_m2 for r in got.values() if r.terminal_type != grid.FLOWING) == 22_500
    flow = grid.d8(square(spark, [i % 5 for i in range(25)]), 30.0)
    vols = {r.node_id: r.total for r in grid.volumes(flow, spark.createDataFrame([(i, 2.0) for i in range(25)], "idx int, volume double")).collect()}
    assert vols[10] == 8.0


def test_pit_water_and_missing(spark):
    pit = {r.idx: r for r in grid.concentration(square(spark, [0 if i == 12 else 10 for i in range(25)]), 30.0).collect()}
    assert pit[12].terminal_type == grid.DEPRESSION and pit[12].n_cells > 1
    gap = {r.idx: r for r in grid.d8(square(spark, [0 if i == 11 else None if i == 12 else 10 for i in range(25)]), 30.0).collect()}
    assert 12 not in gap and gap[11].terminal_type == grid.MISSING_INPUT
    cone = [abs(i // 5 - 2) + abs(i % 5 - 2) for i in range(25)]
    wet = {r.idx: r.down for r in grid.d8(square(spark, cone, {12}), 30.0).collect()}
    assert len(wet) == 24 and wet[7] == 12


def test_blocks_and_erosion(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (0, 0) else float(r), (r, c) != (0, 0)) for r in range(4) for c in range(4)], "row int, col int, value double, valid boolean")
    got = {(r.row, r.col): r.value for r in grid.block_mean(cells, 2).collect()}
    assert got == {(0, 0): None, (0, 1): 0.5, (1, 0): 2.5, (1, 1): 2.5}
    assert {(r.row, r.col) for r in grid.eroded(cells, 1).collect()} == {(1, 2), (2, 1), (2, 2)}


def flooded(cells, near):
    """One heap over all cells: labels pop in order and are final then."""
    import heapq

    z = {c: h for c, h, _ in cells if h is not None}
    best, heap = {}, [((h, 0.0, r, 0, c), c, None) for c, h, r in cells if r is not None and h is not None]
    heapq.heapify(heap)
    popped = {}
    while heap:
        label, c, down = heapq.heappop(heap)
        if c in popped:
            continue
        popped[c] = (label, down)
        for n in near.get(c, ()):
            if n in z and n not in popped:
                spill = max(z[n], label[0])
                new = (spill, max(label[1], spill - z[n]), label[2], label[3] + 1, label[4])
                if n not in best or new < best[n]:
                    best[n] = new
                    heapq.heappush(heap, (new, n, c))
    # of neighbours that give the label, the one that popped first
    out = {}
    for c, (label, down) in popped.items():
        ways = [(popped[n][0], n) for n in near.get(c, ()) if n in popped and (max(z[c], popped[n][0][0]), max(popped[n][0][1], max(z[c], popped[n][0][0]) - z[c]), popped[n][0][2], popped[n][0][3] + 1, popped[n][0][4]) == label]
        out[c] = (*label, min(ways)[1] if down is not None else None)
    return out


def test_priority_flood_over_tiles_is_one_heap(spark):
    rng = random.Random(1)
    rows, cols = 14, 11
    ids = [(r, c) for r in range(rows) for c in range(cols)]
    key = lambda r, c: r * cols + c
    cells = [(key(r, c), None if rng.random() < 0.06 else float(rng.randint(0, 9)) / 2, rng.choice([0, 1, 2]) if rng.random() < 0.06 else None) for r, c in ids]
    near = {key(r, c): [key(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= r + i < rows and 0 <= c + j < cols] for r, c in ids}
    df = spark.createDataFrame([(f"{r // 7}:{c // 6}", *x) for (r, c), x in zip(ids, cells)], "tile string, cell long, elevation double, terminal_rank int")
    pairs = spark.createDataFrame([(a, b) for a, ns in near.items() for b in ns], "cell long, nbr long")
    want = flooded(cells, near)
    got = {r.cell: (r.spill, r.fill, r.terminal_rank, r.steps, r.terminal, r.down) for r in flood.priority_flood(df, pairs).collect()}
    assert len(got) == len(cells)
    assert {c: v for c, v in got.items() if v[0] is not None} == want
    none = flood.priority_flood(df.where("cell < 40").withColumn("terminal_rank", F.lit(None).cast("int")), pairs).collect()
    assert len(none) == 40 and all(r.spill is None and r.terminal is None for r in none)
    assert flood.priority_flood(df.limit(0), pairs.limit(0)).count() == 0


def test_observed_surface_of_one_area(spark):
    """Five cells in a row, the outlet at one end, water at the other, a gap that is filled and a bowl that is raised."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    targets = frame([(7, 0, c, 10.0) for c in range(5)] + [(8, 0, 9, 10.0)], "area int, tile int, cell long, area_m2 double")
    adjacency = frame([(c, n) for c in range(5) for n in (c - 1, c + 1) if 0 <= n < 5] + [(9, 10)], "cell long, nbr long")
    high = {0: 1.0, 1: 0.5, 2: None, 3: 4.0, 4: 2.0, 9: 1.0}
    elevation = frame([(c, z, "missing" if z is None else "available") for c, z in high.items()], "cell long, value double, status string")
    surface = frame([(c, "surface_water" if c in (0, 4) else "road", "available") for c in high], "cell long, value string, status string")
    outlets = frame([(7, "o", 0)], "area int, node_id string, cell long")
    pairs = frame([(2, c, abs(c - 2)) for c in (0, 1, 3, 4)], "cell long, nbr long, steps int")
    layer = lambda v: frame([(c, v, "available", None) for c in high], "cell long, value double, status string, reason string")
    layers = {"rain": layer(100.0), "slope": layer(0.0), "land_cover": layer(111.0)}
    for state, reason in (("isolated", "outfall_network_isolated"), (None, None)):
        connectivity = frame([("o", state)] if state else [], "outfall_id string, status string")
        cells, areas = observed.observed_surface(targets, adjacency, elevation, surface, outlets, connectivity, layers, pairs)
        by = {r.area: r for r in areas.collect()}
        assert (by[8].status, by[8].value, by[8].propagation) == ("out_of_coverage", None, "not_attempted")
        if state is None:
            assert (by[7].status, by[7].runoff_status, by[7].value) == ("invalid_response", "invalid_response", None)
            continue
        assert (by[7].status, by[7].value, by[7].n_contributing, by[7].n_interpolated, by[7].n_water, by[7].n_water_exit, by[7].n_raised) == ("available", 30.0, 3, 1, 1, 1, 1)
        assert by[7].blocking_reasons == ["not_observed_sewer_catchment"] + [reason] * (reason is not None) and by[7].runoff_status == "available" and by[7].runoff_m3 > 0
        got = {r.cell: r for r in cells.where("area = 7").collect()}
        assert math.isclose(got[2].terrain, (1.0 / 2 + 0.5 + 4.0 + 2.0 / 2) / (0.5 + 1 + 1 + 0.5)) and got[2].method == observed.FILLED
        assert (got[1].hydrologic, got[1].fill_m, got[1].down, got[1].steps) == (1.0, 0.5, 0, 1) and got[4].fill_m is None and got[3].termination == "observed_surface_water_exit"


def test_forcing_frames(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cells = frame([(1, True, 0.5), (2, False, 0.5), (3, True, 1.0)], "cell int, valid boolean, coefficient double")
    mapping = frame([(1, "a", 0.25), (1, "b", 0.75), (2, "a", 1.0)], "target int, source string, fraction double")
    rain = frame([("a", 0, 36.0), ("b", 0, 12.0), ("a", 1, 0.0)], "source string, slot int, amount_mm double")
    weights = frame([("r", 2, 0.4), ("r", 3, 0.6)], "source string, target int, weight double")
    rivers = frame([("r", i, 10.0 * i) for i in (0, 1, 3)], "source string, interval int, excess_m3_s double")
    got = {(r.cell, r.interval): (r.rain_m_s, r.river_m3_s, r.status) for r in forcing.forcing_frames(cells, mapping, rain, weights, rivers, 4).collect()}
    assert len(got) == 12 and got[1, 0] == got[1, 1] == (pytest.approx(18 / 1000 / 1800 * 0.5), 0.0, "available")
    assert got[1, 2] == (None, 0.0, "missing") and got[2, 3] == (0.0, 12.0, "available") and got[3, 1] == (0.0, 6.0, "available") and got[3, 2] == (0.0, None, "missing")


# Geometry ---------------------------------------------------------------------------------


def ring(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))


def test_polygons(spark):
    shell, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))
    inside = lambda x, y, edges=False: geometry.in_polygon(F.array(shell, hole), F.lit(float(x)), F.lit(float(y)), edges)
    row = spark.range(1).select(inside(3, 3), inside(1.5, 1.5), inside(5, 1), inside(0, 0), inside(4, 4), inside(4, 4, True), geometry.ring_area(shell), geometry.ring_area(geometry.clipped(ring((-1, -1), (5, -1), (5, 5), (-1, 5)), *map(F.lit, (0.0, 0.0, 2.0, 3.0)))), geometry.ring_area(geometry.clipped(ring((0, 0), (4, 0), (0, 4)), *map(F.lit, (0.0, 0.0, 2.0, 2.0))))).first()
    assert tuple(row) == (True, False, False, True, False, True, 16.0, 6.0, 4.0)


def test_rasterise_and_overlap(spark):
    p = spark.range(1).select(F.lit("a").alias("polygon_id"), F.array(ring((0, 0), (4, 0), (4, 4), (0, 4))).alias("rings"))
    assert geometry.rasterised(p, 1.0).count() == 16
    assert {r.fraction for r in geometry.subcell_coverage(p, 2.0).collect()} == {1.0}
    t = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(7, 5.0, 5.0, 30.0, 30.0), (8, 10.0, 0.0, 11.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = geometry.overlaps(t, s, 4.0).collect()
    assert [(r.source, r.area, r.fraction) for r in got] == [(7, 25.0, 0.25)]


def test_coverage_and_weights(spark):
    pieces = spark.createDataFrame([(1, 60.0, 5.0, "available"), (1, 40.0, None, "stale"), (2, 100.0, 0.0, "available"), (3, 120.0, 1.0, "available")], "target int, area double, value double, status string")
    targets = spark.createDataFrame([(i, 100.0) for i in (1, 2, 3, 4)], "target int, area_m2 double")
    got = {r.target: r for r in geometry.coverage(pieces, targets).collect()}
    assert (got[1].observed, got[1].status, got[1].complete) == (60.0, "stale", False)
    assert got[2].complete and got[3].overlapping and got[4].status == "out_of_coverage"
    assert {r.target: r.mean for r in geometry.area_mean(pieces).collect()} == {1: 5.0, 2: 0.0, 3: 1.0}


# Metrics ----------------------------------------------------------------------------------


def test_ranking_with_ties(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(12)), rng.randrange(2)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "s double, y int")
    got = metrics.ranking(df, [], "s", "y").first()
    flipped = metrics.ranking(df.withColumn("s", -F.col("s")), [], "s", "y").first()
    assert math.isclose(got.roc_auc, want) and math.isclose(got.roc_auc + flipped.roc_auc, 1)
    assert metrics.ranking(df.where("y = 1"), [], "s", "y").first().roc_auc is None
    top = metrics.overlap_at(df, [], "s", "y", (1.0,)).first()
    assert top.recall == 1.0 and math.isclose(top.precision, len(pos) / 300)


def test_contingency_and_boundary(spark):
    df = spark.createDataFrame([(1, True, True), (1, True, False), (1, None, True), (2, False, False)], "k int, a boolean, b boolean")
    got = {r.k: r for r in metrics.contingency(df, ["k"], "a", "b").collect()}
    assert (got[1].iou, got[1].recall, got[1].unknown) == (0.5, 1.0, 1) and got[2].iou is None and "no observed cell" in got[2].undefined
    wet = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 0, None), (1, 1, True)], "row int, col int, wet boolean")
    assert {(r.row, r.col, r.side) for r in metrics.boundary_segments(wet, "wet", 1.0).collect()} == {(0, 0, "E"), (1, 1, "N")}


# Series and gates -----------------------------------------------------------------------------


def test_series_completeness_and_rise(spark):
    obs = lambda rows: spark.createDataFrame(rows, "k string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    full = [("a", i * 900, float(i)) for i in range(8)]
    part = [("b", i * 900, float(i)) for i in range(8) if i != 3]
    got = {r.k: r for r in series.strict_accumulation(obs(full + part), ["k"], "v", "1970-01-01T00:00:00", "1970-01-01T02:00:00", 900).collect()}
    assert got["a"].total == 28.0 and got["b"].total is None and got["b"].status == "incomplete_window" and got["b"].partial == 25.0
    twice = series.strict_accumulation(obs([*full, full[0]]), ["k"], "v", "1970-01-01", "1970-01-01T02:00:00", 900).first()
    assert twice.status == "invalid_response"
    rise = {r.k: (r.largest_rise, r.n_windows) for r in series.largest_rise(obs(full + part), ["k"], "v").collect()}
    assert rise == {"a": (4.0, 4), "b": (None, 0)}
    assert [r.t for r in series.missing_slots(obs(part), ["k"], "1970-01-01", "1970-01-01T02:00:00", 900).selectExpr("unix_seconds(ts) AS t").collect()] == [2700]


def test_gates(spark):
    rows = [("in", "forcing", "pre_event", True, False, 5, None), ("ref", "evaluation_reference", "pre_event", True, False, 1, None), ("late", "forcing", "pre_event", True, False, 20, None), ("noted", "forcing", "pre_event", True, False, 20, "why"), ("post", "forcing", "post_event", False, True, 1, None), ("undated", "forcing", "pre_event", True, False, None, None)]
    df = spark.createDataFrame(rows, "id string, role string, temporal_relation string, use_input boolean, use_calibration boolean, d int, methodology_note string").withColumn("available_at", F.timestamp_seconds("d"))
    got = {(r.id, r.rule) for r in gates.leakage(df, F.timestamp_seconds(F.lit(10)), retrospective=True).collect()}
    assert got == {("ref", "reference_is_not_input"), ("late", "available_by_cutoff"), ("post", "reference_is_not_input"), ("undated", "availability_is_known")}
    layer = spark.createDataFrame([("c", (None, "stale"))], "cell string, rain struct<value:double,status:string>")
    with pytest.raises(gates.MissingLayer):
        gates.require_layers(layer, ["rain"])
    assert gates.over_bounds({"nodes": 101, "pipes": 5}) == ["nodes: 101 > 100"]


# Solver -----------------------------------------------------------------------------------


def basin(z, dx=10.0):
    z = np.array(z, float)
    return solver.Basin(z, np.full(z.shape, 0.03), np.ones(z.shape, bool), dx)


def test_lake_at_rest_stays(spark):
    z = np.array([[5.0, 5, 5, 5], [5, 0, 1, 5], [5, 5, 5, 5]])
    level = np.maximum(3.0 - z, 0)
    out = solver.simulate(basin(z), 300.0, [], 100.0, level)
    assert np.allclose(out["most"], level, atol=1e-9) and out["left"] == 0


def test_dam_break_is_symmetric_and_keeps_its_volume():
    h = np.zeros((5, 21))
    h[:, 8:13] = 1.0
    b = basin(np.zeros((5, 21)))
    out = solver.simulate(b, 20.0, [], 20.0, h)
    assert np.allclose(b.h, b.h[:, ::-1], atol=1e-9)
    assert math.isclose(out["start"], out["left"] + out["end"], rel_tol=1e-9)


def test_scenarios_balance(spark):
    cells = spark.createDataFrame([(s, r, c, r * 0.1, 0.03, 0.0) for s in ("a", "b") for r in range(4) for c in range(4)], "scenario string, row int, col int, elevation double, manning double, depth double")
    rain = spark.createDataFrame([("a", 0.0, 60.0, 36.0), ("b", 0.0, 60.0, 0.0)], "scenario string, from_s double, to_s double, mm_h double")
    got = {r.scenario: r for r in solver.scenarios(cells, rain, 120.0, 10.0).collect()}
    assert got["a"].balanced and math.isclose(got["a"].volume_in, 16 * 100 * 36 / 1000 / 60) and got["b"].volume_in == 0.0


def stepped(ground, rough, rain, river, edges, every, size):
    """An event cell by cell and face by face, in plain loops. ground: {(row, col): elevation}; rain and river: {cell: by interval}."""
    h, q = dict.fromkeys(ground, 0.0), {}
    outputs = {every * i for i in range(1, int(edges[-1] / every) + 1)} | {edges[-1]}
    most, index, now, left, seen = dict.fromkeys(ground, 0.0), dict.fromkeys(ground, 0), 0.0, 0.0, 0
    for mark in sorted(outputs | set(edges[1:])):
        k = max(i for i, e in enumerate(edges) if e <= now)
        while mark - now > 1e-9:
            deepest = max(h.values())
            stable = 5.0 if deepest < 1e-3 else min(5.0, 0.7 * size / math.sqrt(9.80665 * deepest))
            dt = (mark - now) / math.ceil((mark - now) / stable - 1e-9)
            new = {}
            for a in ground:
                for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)):
                    if b in ground:
                        deep = max(ground[a] + h[a], ground[b] + h[b]) - max(ground[a], ground[b])
                        if deep >= 1e-3:
                            old = q.get((a, b), 0.0)
                            push = old - 9.80665 * deep * dt * (ground[b] + h[b] - ground[a] - h[a]) / size
                            new[a, b] = push / (1 + 9.80665 * dt * ((rough[a] + rough[b]) / 2) ** 2 * abs(old) / deep ** (7 / 3))
            for r, c in ground:  # the border lets out what flows towards it; the mesh is 3 by 4
                for inner, out, edge in (((r - 1, c), (r + 1, c), r == 2), ((r + 1, c), (r - 1, c), r == 0), ((r, c - 1), (r, c + 1), c == 3), ((r, c + 1), (r, c - 1), c == 0)):
                    flow = new.get((inner, (r, c)), 0.0) - new.get(((r, c), inner), 0.0)
                    if edge and flow > 0:
                        new[(r, c), out] = flow
            have = {a: h[a] + (rain[a][k] + river[a][k] / size**2) * dt for a in ground}
            gives = dict.fromkeys(ground, 0.0)
            for (a, b), f in new.items():
                gives[a if f > 0 else b] += abs(f) * dt / size
            part = {a: min(1.0, have[a] / g) if (g := gives[a]) > have[a] else 1.0 for a in ground}
            new = {(a, b): f * part[a if f > 0 else b] for (a, b), f in new.items()}
            h = dict(have)
            for (a, b), f in new.items():
                h[a] -= f * dt / size
                if b in h:
                    h[b] += f * dt / size
                else:
                    left += f * dt * size
            h = {a: max(x, 0.0) for a, x in h.items()}  # rounding
            q, now = new, now + dt
        now = mark
        if mark in outputs:
            seen += 1
            for a in ground:
                if h[a] > most[a]:
                    most[a], index[a] = h[a], seen
    return h, most, index, left


def test_events_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    edges, hole = [0.0, 40.0, 100.0, 130.0], (1, 2)
    place = [(r, c) for r in range(3) for c in range(4)]
    ground = {a: float(rng.integers(0, 20)) / 10 for a in place if a != hole}
    rough = {a: 0.02 + 0.01 * (a[1] % 3) for a in place}
    rain = {a: [float(x) for x in rng.integers(0, 5, 3) * 1e-3] for a in place}
    river = {a: [0.0, 2.0, 1.0] if a in ((1, 1), hole) else [0.0] * 3 for a in place}
    rows = [("x", *a, ground.get(a), rough[a], None, [None] * 3 if a == hole else rain[a], river[a], "mine") for a in place]
    first = lambda name, **new: [(name, *(new.get(k, v) for k, v in zip(("row", "col", "z", "n", "h", "rain", "river", "status"), r[1:]))) if r[1:3] == (0, 0) else (name, *r[1:]) for r in rows]
    bad = {"null": first("null", rain=None), "hole": first("hole", river=[0.0, None, 0.0]), "short": first("short", rain=[0.0]), "rough": first("rough", n=0.0), "negative": first("negative", h=-1.0), "deep": first("deep", h=1e6), "twice": [("twice", *r[1:]) for r in rows + rows[:1]]}
    bad["land"] = [("land", *r[1:3], None, *r[4:]) for r in rows]
    schema = "scenario string, row int, col int, elevation double, manning double, depth double, rain_m_s array<double>, river_m3_s array<double>, status string"
    cells = spark.createDataFrame(rows + [(None, *r[1:]) for r in rows] + [r for b in bad.values() for r in b], schema)
    every = solver.event_scenarios(cells, edges, 10.0, 50.0, (0.05, 0.3)).cache()
    final, most, index, left = stepped(ground, rough, rain, river, edges, 50.0, 10.0)
    for name in ("x", None):
        got = {(r.row, r.col): r for r in every.where(F.col("scenario").eqNullSafe(name)).collect()}
        assert len(got) == 12 and got[hole].max_depth is None and got[hole].wet is None and {r.status for r in got.values()} == {"available"}
        for a in ground:
            assert math.isclose(got[a].max_depth, most[a], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(got[a].final_depth, final[a], rel_tol=1e-9, abs_tol=1e-12)
            assert got[a].max_index == index[a] and got[a].wet == [most[a] >= 0.05, most[a] >= 0.3]
        one = got[0, 0]
        assert left > 0 and math.isclose(one.volume_out, left, rel_tol=1e-9) and math.isclose(one.volume_river, 60 * 2 + 30 * 1)
        assert math.isclose(one.volume_rain, sum(100 * (b - a) * rain[x][i] for x in ground for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    why = {"null": "missing_forcing", "hole": "missing_forcing", "short": "missing_forcing", "rough": "invalid_terrain", "negative": "invalid_terrain", "deep": "step_below_minimum", "twice": "repeated_cells", "land": "invalid_terrain"}
    for name, status in why.items():
        got = every.where(F.col("scenario") == name).collect()
        assert len(got) == len(bad[name]) and {(r.status, r.max_depth, r.n_steps) for r in got} == {(status, None, None)}
    told = {r.scenario: r for r in solver.event_summary(every).collect()}
    assert told["x"].n_cells == 11 and told["x"].n_wet == sum(m >= 0.05 for m in most.values()) and told["null"].deepest is None and abs(told["x"].residual) < told["x"].tolerance
    assert solver.event_scenarios(cells.limit(0), edges, 10.0, 50.0).count() == 0
    with pytest.raises(ValueError):
        solver.event_scenarios(cells, [0.0, 10.0, 10.0], 10.0, 50.0)


def test_strips_equal_one_mesh(spark, monkeypatch):
    rng = np.random.default_rng(11)
    place = [(r, c) for r in range(60) for c in range(4) if not 20 <= r < 33 and rng.random() > 0.05]  # rows 20 to 32 are no cells
    ground = {a: None if rng.random() < 0.1 else a[0] * 0.05 + float(rng.integers(0, 60)) / 40 for a in place}
    edges = [0.0, 40.0, 100.0]
    schema = "scenario string, row int, col int, elevation double, manning double, depth double, rain_m_s array<double>, river_m3_s array<double>"
    rows = [(s, *a, z, 0.03, float(a[0] % 7 == 3) * deep, [float(x) * fall for x in rng.integers(0, 5, 2)], [float(a == (50, 2)) * 3] * 2) for s, fall, deep in (("a", 1e-3, 0.5), ("b", 1e-4, 0.0), (None, 2e-3, 1.0)) for a, z in ground.items()]
    bad = [("bad", *r[1:3], r[3], 0.03, 0.0, [None, 0.0], r[7]) for r in rows if r[0] == "a"] + [("deep", *r[1:5], 1e6, *r[6:]) for r in rows if r[0] == "a"] + [("twice", *r[1:]) for r in [*rows, rows[0]] if r[0] == "a"]
    cells = spark.createDataFrame(rows + bad + [("small", 0, c, 1.0, 0.03, 0.1, [0.0, 1e-3], [0.0, 0.0]) for c in range(3)], schema)
    rain = spark.createDataFrame([(s, a, b, v) for s in ("a", "b", None) for a, b, v in ((0.0, 40.0, 900.0), (20.0, 70.0, 300.0))], "scenario string, from_s double, to_s double, mm_h double")
    key = lambda r: (str(r.scenario), r.row, r.col)
    run = lambda: [sorted(df.collect(), key=key) for df in (solver.event_scenarios(cells, edges, 10.0, 25.0), solver.scenarios(cells.where("scenario IS NULL OR scenario IN ('a', 'b')"), rain, 90.0, 10.0, 30.0))]
    one = run()
    monkeypatch.setattr(solver, "TILE_CELLS", 40)
    monkeypatch.setattr(solver, "ROUND_STEPS", 3)
    cut, widest = run(), []
    monkeypatch.setattr(solver, "written", lambda df, name, f=solver.written: (widest.append(name), f(df, name))[1])
    for a, b in zip(one, cut):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for name, v in x.asDict().items():
                if name.startswith("volume") or name == "residual":
                    assert (v is None) == (y[name] is None) and (v is None or math.isclose(v, y[name], rel_tol=1e-9, abs_tol=1e-6)), (x, y)
                elif name == "tolerance":
                    assert v is None or math.isclose(v, y[name], rel_tol=1e-9)
                else:
                    assert v == y[name], (name, x, y)
    solver.scenarios(cells.where("scenario = 'a'"), rain, 90.0, 10.0).count()
    assert "strips" in widest  # a mesh over TILE_CELLS is never one group


def test_frames_are_packed_in_order_and_keep_what_is_missing(spark):
    frames = spark.createDataFrame([(1, i, None if i == 2 else i / 10, float(i)) for i in (3, 1, 0, 2)], "cell int, interval int, rain_m_s double, river_m3_s double")
    got = solver.packed(frames, "cell").first()
    assert got.rain_m_s == [0.0, 0.1, None, 0.3] and got.river_m3_s == [0.0, 1.0, 2.0, 3.0]


# Sources and streaming --------------------------------------------------------------------


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("lat,lon,w,l,s,m,e\n1,2,0.1,0.2,0.3,0.4,100\nbad\n")
    assert readers.read_points_csv(spark, f"{tmp_path}/p.csv").count() == 1
    assert readers.read_keyed_csv(spark, f"{tmp_path}/none.csv", "k", ["v"]).count() == 0
    raw = spark.createDataFrame([("f", bytearray(np.array([[1, -9999], [3, 4]], "<f4").tobytes())), ("short", bytearray(b"123"))], "path string, content binary")
    rows = readers.raster_rows(raw, "f32", 2, 2, -9999).collect()
    assert {(r.key, r.row, r.col, r.value) for r in rows} == {("f", 0, 0, 1.0), ("f", 0, 1, None), ("f", 1, 0, 3.0), ("f", 1, 1, 4.0), ("short", None, None, None)}
    wkb = b"\x01" + struct.pack("<III", 3, 1, 3) + struct.pack("<6d", 0, 0, 1, 0, 0, 1)
    gp = b"GP\x00\x01\x00\x00\x00\x00" + wkb
    got = spark.createDataFrame([(bytearray(wkb),), (bytearray(gp),), (bytearray(b"xx"),), (None,)], "g binary").select(readers.wkb_rings("g").alias("r")).collect()
    assert [None if r.r is None else [(p.x, p.y) for p in r.r[0]] for r in got] == [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]] * 2 + [None, None]
    text = '{"features":[{"id":"A","geometry":{"type":"Point","coordinates":[11.1,46.0]},"properties":{"type":"node","nodeType":"inlet","elevation":103}},{"id":"p","geometry":{"type":"LineString","coordinates":[[11.1,46.0],[11.2,46.1]]},"properties":{"type":"pipe","diameter":500}}]}'
    nodes, pipes, areas = readers.network_of(readers.geojson_features(spark.createDataFrame([(text,), ("no json",)], "content string")))
    assert tuple(nodes.first()) == ("A", "inlet", 46.0, 11.1, 103.0) and pipes.first().finish.lat == 46.1 and areas.count() == 0
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["# s1;rain", "2020-01-01 00:00;2020-01-01 01:00;1.5", "2020-01-01 01:00;2020-01-01 02:00;", "# s2;rain", "2020-01-01 00:00;2020-01-01 01:00;-1"])], "file string, line int, text string")
    assert [(r.station, r.value, r.status) for r in readers.station_sections(lines).orderBy("line").collect()] == [("s1", 1.5, "available"), ("s1", None, "missing"), ("s2", None, "invalid_response")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 86400 + i * 1800, "L", "x", 1.0) for i in range(6)] + [("a", 86400, "L", "x", 1.0)]
    df = spark.createDataFrame(rows, "cell string, t long, layer string, variable string, value_num double").select("cell", F.timestamp_seconds("t").alias("ts"), "layer", "variable", "value_num")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.deduplicated(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    got = {(r.window_end.timestamp(), r.status, r.total) for r in ingest.sliding_totals(df.dropDuplicates(), 2).collect()}
    assert (93600.0, "available", 4.0) in got and (88200.0, "incomplete_window", None) in got
