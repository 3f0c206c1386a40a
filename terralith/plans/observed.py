"""What the surface around outfalls contributes, from observed elevations and surface classes, for many areas at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flood, grid
from ..operators.evidence import CARRYING, PRECEDENCE, rank_of
from ..sources.intermediate import written
from .pipelines import conditioned_runoff

# Tables of cells and of areas grow with what is looked at, so joins are hinted to be by shuffle: a table just under the
# broadcast limit (neighbours, a layer) would go through the driver, many times larger than its estimate.

# Surface classes, how a cell's terrain came about, and where its way ends (by the terminal's rank).
WATER, BARRIER = ("surface_water", "supporting_water"), ("structural_barrier",)
OBSERVED, FILLED = "retain_observed_ahn_area_mean", "idw_from_observed_ahn_neighbors"
NO_CLASS, NO_NEIGHBOURS = "unresolved_missing_surface_class", "unresolved_insufficient_ahn_neighbors"
NOT_WATER, NOT_BARRIER = "excluded_observed_surface_water", "excluded_observed_structural_barrier"
ENDS = ("conditioned_outfall_terminal", "observed_surface_water_exit", "analysis_bbox_exit")
INCOMPLETE = "incomplete_conditioning"
RAISED_M = 1e-9


def prepared_cells(targets: DataFrame, elevation: DataFrame, surface: DataFrame, outlets: DataFrame, pairs: DataFrame, least: int = 3, most: int = 18) -> DataFrame:
    """area, tile, cell, area_m2, outlet, method, terrain, surface_status, elevation_status: G10 with its reasons.

    An outlet is land whatever its class. Cells without an elevation get one by inverse distance from all cells that
    have one (pairs: cell, nbr, steps), of whatever class, inside the targets or not.
    """
    own = targets.select("area", "tile", "cell", "area_m2").join(surface.select("cell", F.col("value").alias("class"), F.col("status").alias("surface_status")).hint("merge"), "cell", "left")
    own = own.join(elevation.select("cell", F.col("value").alias("raw"), F.col("status").alias("elevation_status")).hint("merge"), "cell", "left").join(outlets.select("area", "cell", F.lit(True).alias("outlet")).hint("merge"), ["area", "cell"], "left")
    own = own.withColumn("outlet", F.coalesce("outlet", F.lit(False)))
    kind = F.when(F.col("class").isNull(), NO_CLASS).when(F.col("class").isin(*WATER) & ~F.col("outlet"), NOT_WATER).when(F.col("class").isin(*BARRIER) & ~F.col("outlet"), NOT_BARRIER).when(F.col("raw").isNotNull(), OBSERVED)
    own = written(own.withColumn("method", kind), "prepared")
    known = elevation.where("value IS NOT NULL").select("cell", "value")
    filled = grid.idw(own.where("method IS NULL").select("cell"), known, pairs, steps=1_000_000, least=least, most=most)
    own = own.join(filled.select("cell", F.col("value").alias("made")).hint("merge"), "cell", "left")
    method = F.coalesce("method", F.when(F.col("made").isNull(), NO_NEIGHBOURS).otherwise(FILLED))
    terrain = F.when(method == OBSERVED, F.col("raw")).when(method == FILLED, F.col("made"))
    return own.select("area", "tile", "cell", "area_m2", "outlet", method.alias("method"), terrain.alias("terrain"), "surface_status", "elevation_status")


def conditioned_cells(prepared: DataFrame, adjacency: DataFrame) -> DataFrame:
    """prepared_cells() with where each one drains: hydrologic, fill_m, down, steps, terminal, termination, contributes.

    Of the terminals that compete an outlet comes first, then land beside water, then land at the edge of its area.
    adjacency: cell, nbr, of all neighbours, in the area or not. contributes is unknown where conditioning is incomplete.
    """
    prepared = written(prepared, "prepared")
    other = prepared.select(F.col("cell").alias("nbr"), F.col("area").alias("n_area"), (F.col("method") == NOT_WATER).alias("n_water"))
    near = written(adjacency.select("cell", "nbr").join(other.hint("merge"), "nbr", "left").join(prepared.select("cell", "area").hint("merge"), "cell").withColumn("same", F.coalesce(F.col("area") == F.col("n_area"), F.lit(False))), "near")
    sides = near.groupBy("cell").agg(F.bool_or(F.col("same") & F.col("n_water")).alias("wet"), F.bool_or(~F.col("same")).alias("edge"))
    land = prepared.where("terrain IS NOT NULL").join(sides.hint("merge"), "cell", "left")
    rank = F.when(F.col("outlet"), 0).when(F.col("wet"), 1).when(F.col("edge"), 2)
    flooded = flood.priority_flood(land.select("tile", "cell", F.col("terrain").alias("elevation"), rank.alias("terminal_rank")), near.where("same"))
    out = prepared.join(flooded.hint("merge"), "cell", "left")
    ends = F.when(F.col("method").isin(NOT_WATER, NOT_BARRIER), F.col("method")).when(F.col("spill").isNull(), INCOMPLETE).otherwise(F.element_at(F.array(*map(F.lit, ENDS)), F.col("terminal_rank") + 1))
    out = out.withColumn("termination", ends)
    contributes = F.when(F.col("termination") != INCOMPLETE, F.col("termination") == ENDS[0])
    return out.select(*prepared.columns, F.col("spill").alias("hydrologic"), flood.depression_fill(F.col("spill"), F.col("terrain")).alias("fill_m"), "down", "steps", "terminal", "termination", contributes.alias("contributes"))


def surface_summary(cells: DataFrame, outlets: DataFrame) -> DataFrame:
    """One row per area: status, value (the contributing area, only where no cell is incomplete), partial, and the counts.

    An area without an outlet among its cells is out of coverage. Of incomplete areas the status is the failure of its
    surface classes and elevations that comes first; synthetic inputs taint.
    """
    n = lambda c, name: F.count_if(c).alias(name)
    ends, method = F.col("termination"), F.col("method")
    drained = ends.isin(*ENDS)
    worst = lambda c: F.min(rank_of(F.col(c)))
    per = cells.groupBy("area").agg(
        F.count(F.lit(1)).alias("n_target"), n(drained & (method == OBSERVED), "n_observed"), n(drained & (method == FILLED), "n_interpolated"), n(ends == NOT_WATER, "n_water"), n(ends == NOT_BARRIER, "n_barrier"),
        n(ends == INCOMPLETE, "n_unresolved"), n(drained & (F.col("fill_m") > RAISED_M), "n_raised"), n(ends == ENDS[0], "n_contributing"), n(ends == ENDS[2], "n_edge_exit"), n(ends == ENDS[1], "n_water_exit"),
        F.coalesce(F.sum(F.when(ends == ENDS[0], F.col("area_m2"))), F.lit(0.0)).alias("partial"), F.least(worst("surface_status"), worst("elevation_status")).alias("worst"),
        F.bool_or((F.col("surface_status") == "synthetic_fixture") | (F.col("elevation_status") == "synthetic_fixture")).alias("tainted"), F.bool_or("outlet").alias("has_outlet"),
    )
    whole = F.col("n_unresolved") == 0
    failed = F.coalesce(F.element_at(F.array(*map(F.lit, (*PRECEDENCE, "invalid_response"))), F.col("worst") + 1), F.lit("invalid_response"))
    status = F.when(~F.col("has_outlet"), "out_of_coverage").when(~whole, failed).when(F.col("tainted"), "synthetic_fixture").otherwise("available")
    per = per.withColumn("status", status).withColumn("value", F.when(whole & F.col("has_outlet"), F.col("partial")))
    return per.join(outlets.select("area", "node_id", F.col("cell").alias("outlet_cell")).hint("merge"), "area", "left").drop("worst", "tainted", "has_outlet")


def observed_surface(targets: DataFrame, adjacency: DataFrame, elevation: DataFrame, surface: DataFrame, outlets: DataFrame, connectivity: DataFrame, layers: dict[str, DataFrame], pairs: DataFrame, most: int = 100, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cells with where they drain, and per area the contributing surface, its runoff and why it goes no further.

    targets: area, tile, cell, area_m2 (a cell in one area); adjacency: cell, nbr of all neighbours; elevation: cell, value,
    status of the targets and of what is around them; surface: cell, value (a class), status; outlets: area, node_id, cell,
    one an area; connectivity: outfall_id, status; layers: rain, slope, land_cover for X07; pairs: cell, nbr, steps.

    The runoff is that of the `most` contributing cells with the shortest ways (X07), and only of areas whose surface
    carries a value. It never enters the network: blocking_reasons says why, of the surface, the runoff and the outfall.
    An area whose outfall isn't in connectivity is an invalid response as a whole.
    """
    cells = written(conditioned_cells(prepared_cells(targets, elevation, surface, outlets, pairs, least), adjacency), "conditioned")
    areas = written(surface_summary(cells, outlets), "surface_areas")
    complete = areas.where("value IS NOT NULL").select("area")
    paths = cells.where("contributes").join(complete.hint("merge"), "area", "left_semi").select("terminal", "cell", F.col("steps").alias("n_steps"), F.lit(True).alias("contributes"))
    runoff = conditioned_runoff(paths, cells.select("cell", "area_m2"), layers, most)
    runoff = runoff.select(F.col("terminal").alias("outlet_cell"), "n_selected", "covers_all", F.col("value").alias("runoff_m3"), F.col("status").alias("runoff_status"), F.col("partial").alias("runoff_partial"))
    out = areas.join(connectivity.select(F.col("outfall_id").alias("node_id"), F.col("status").alias("connectivity"), F.lit(True).alias("known")).hint("merge"), "node_id", "left").join(runoff.hint("merge"), "outlet_cell", "left")
    lost = F.col("node_id").isNotNull() & F.col("known").isNull()
    status = F.when(F.col("node_id").isNull(), "out_of_coverage").when(lost, "invalid_response").otherwise(F.col("status"))
    ran = F.when(F.col("node_id").isNull() | lost | F.col("value").isNull(), status).otherwise(F.coalesce("runoff_status", F.lit("invalid_response")))
    stop = F.when(F.col("connectivity") == "blocked_by_unresolved_direction", "outfall_network_direction_unresolved").when(F.col("connectivity") != "known_upstream_path", F.concat(F.lit("outfall_network_"), "connectivity"))
    reasons = F.array_compact(F.array(F.lit("not_observed_sewer_catchment"), F.when(~ran.isin(*CARRYING), "environmental_runoff_incomplete"), stop))
    reached = F.col("node_id").isNotNull() & ~lost
    keep = lambda c: F.when(reached, F.col(c)).alias(c)
    counts = ("n_target", "n_observed", "n_interpolated", "n_water", "n_barrier", "n_unresolved", "n_raised", "n_contributing", "n_edge_exit", "n_water_exit")
    return cells, out.select(
        "area", "node_id", status.alias("status"), keep("value"), keep("partial"), *map(keep, counts), keep("n_selected"), keep("covers_all"), F.when(reached & ran.isin(*CARRYING), F.col("runoff_m3")).alias("runoff_m3"),
        ran.alias("runoff_status"), F.when(reached, reasons).otherwise(F.array(F.lit("conditioned_surface_unavailable"))).alias("blocking_reasons"),
        F.when(reached, "blocked_before_propagation").otherwise("not_attempted").alias("propagation"), F.lit(False).alias("eligible"),
    )
