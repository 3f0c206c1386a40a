"""Compositions (X-rows): each is one lazy plan, gates aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cells as C
from ..operators import cube, gates, geometry, grid, network, risk, runoff
from ..operators.evidence import CARRYING, available, requested, strict_sum
from ..sources.intermediate import written


def features_from_layers(layers: dict[str, DataFrame], key: str = "cell") -> DataFrame:
    """Tables of one layer each, full-outer joined on the cell, with all hazard models. A column that no layer
    has is null."""
    out = None
    for df in layers.values():
        out = df if out is None else out.join(df, key, "full_outer")
    for name, kind in (("slope", "double"), ("elsus_class", "double"), ("hazard_pga", "double"), ("clc_class", "int"), ("lithology", "string"), ("rain24h", "double"), ("rain72h", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return risk.all_risks(out)


def point_scores(points: DataFrame, scores: list[str], res: int) -> DataFrame:
    """Points (lat, lon, scores) to the mean of each score per cell, with the mean position and the count."""
    rows = points.withColumn("cell", C.cell_of(F.col("lat"), F.col("lon"), res)).where("cell IS NOT NULL")
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in [*scores, "lat", "lon"]))


def area_scores(asked: DataFrame, cached: DataFrame, layers: dict[str, DataFrame], required: list[str] = ()) -> DataFrame:
    """Scores of the asked cells: those that are cached as they are, the others computed from the
    layers' evidence (cell, value, status, reason); in strict mode a required layer that is missing somewhere raises."""
    hits = asked.join(cached, "cell", "left_semi").join(cached, "cell")
    missed = asked.select("cell").join(cached.select("cell"), "cell", "left_anti")
    evidence, _ = requested(missed, layers, "cell")
    if required:
        gates.require_layers(evidence, list(required))
    names = ("slope", "elsus_class", "hazard_pga", "clc_class", "rain24h", "rain72h")
    wide = evidence.select("cell", *(F.col(f"{n}.value").alias(n) if n in layers else F.lit(None).cast("double").alias(n) for n in names), F.lit(None).cast("string").alias("lithology"))
    fresh = risk.all_risks(wide).select("cell", "score").withColumn("source", F.lit("computed"))
    return hits.select("cell", "score").withColumn("source", F.lit("cache")).unionByName(fresh)


def proof(nodes: DataFrame, pipes: DataFrame, cells: DataFrame, attachments: DataFrame, min_drop: float = 0.1) -> dict[str, DataFrame | str | None]:
    """cells' runoff -> strict volume per catchment -> per outlet node -> directions -> no-loss accumulation.

    A node without attachments has a source of 0; an attachment whose catchment has no total is missing (B-15).
    """
    volumes = runoff.cell_volumes(cells.withColumn("runoff", runoff.runoff("rain", "slope", "land_cover")))
    totals = runoff.catchment_totals(volumes, attachments)
    sources = node_sources(nodes, attachments, totals)
    directed = network.oriented(pipes, nodes, min_drop=min_drop)
    status, accumulated = network.accumulation(directed, sources)
    return {"catchments": totals, "sources": sources, "directions": directed, "issues": network.issues(nodes, pipes, attachments), "status": status, "accumulated": accumulated}


def node_sources(nodes: DataFrame, attachments: DataFrame, totals: DataFrame) -> DataFrame:
    """Strict source per node over its attachments (catchment_id, outlet_node_id)."""
    rows = attachments.select("catchment_id", F.col("outlet_node_id").alias("node_id")).join(totals.select("catchment_id", "value", "status"), "catchment_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    own = strict_sum(rows, ["node_id"], "value", "status")
    none = F.col("n_inputs").isNull()
    out = nodes.select("node_id").join(own, "node_id", "left")
    return out.select("node_id", F.when(none, 0.0).otherwise(F.col("value")).alias("value"), F.when(none, "available").otherwise(F.col("status")).alias("status"), "partial", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"))


def conditioned_terrain(cells: DataFrame, pairs: DataFrame, barrier: Column, observed: str = "elevation") -> DataFrame:
    """Cell, elevation, kind: barriers and water are left out, observed cells kept, the rest filled by inverse
    distance where enough samples are near, else unresolved."""
    open_cells = cells.where(~F.coalesce(barrier, F.lit(False)))
    known = open_cells.where(F.col(observed).isNotNull()).select("cell", F.col(observed).alias("value"))
    gaps = open_cells.where(F.col(observed).isNull()).select("cell")
    filled = grid.idw(gaps, known, pairs)
    kept = known.select("cell", F.col("value").alias("elevation"), F.lit("observed").alias("kind"))
    made = filled.select("cell", F.col("value").alias("elevation"), F.when(F.col("value").isNull(), "unresolved").otherwise("filled").alias("kind"))
    out = cells.where(F.coalesce(barrier, F.lit(False))).select("cell", F.lit(None).cast("double").alias("elevation"), F.lit("excluded").alias("kind"))
    return kept.unionByName(made).unionByName(out)


def surface_paths(cells: DataFrame, adjacency: DataFrame, outlets: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Cell, terminal, n_steps, n_cells, ends_at, contributes: the end of each cell's steepest path, its length, how
    many cells drain through the cell, how the path ends (outlet, incomplete_elevation, depression, or coverage_exit where
    it leaves the targets) and whether it drains to an outlet, which is unknown where elevations are incomplete."""
    flow = grid.immediate_flow(cells, adjacency, outlets)
    if targets is not None:
        inside = flow.join(targets.select("cell", F.lit(True).alias("__in")).distinct(), "cell", "left")
        flow = inside.select("cell", F.when(F.col("__in"), F.col("down")).alias("down"), F.when(F.col("__in"), F.col("ends")).otherwise("coverage_exit").alias("ends"))
    flow = written(flow)
    out = network.forest(flow.select(F.col("cell").alias("node_id"), "down"), flow.select(F.col("cell").alias("node_id"), F.lit(1.0).alias("own")))
    out = out.join(flow.where("ends IS NOT NULL").select(F.col("cell").alias("terminal"), F.col("ends").alias("ends_at")).hint("merge"), "terminal", "left")
    contributes = F.when(F.col("ends_at") == "outlet", True).when(F.col("ends_at") != "incomplete_elevation", False)
    return out.select(F.col("node_id").alias("cell"), "terminal", F.col("steps").alias("n_steps"), F.col("total").cast("long").alias("n_cells"), "ends_at", contributes.alias("contributes"))


def conditioned_runoff(paths: DataFrame, areas: DataFrame, layers: dict[str, DataFrame], most: int = 100) -> DataFrame:
    """Strict runoff volume of the cells that drain to each outlet, as far as a request goes: the `most` cells
    with the shortest paths, of equals the smallest ids. Says how many cells there were and whether all are in.

    paths: surface_paths(); areas: cell, area_m2; layers: rain, slope and land_cover, each cell, value, status, reason. A
    layer that leaves a cell out is an invalid response, and so is an area not above 0.
    """
    all_ = paths.where("contributes").select("terminal", "cell", "n_steps")
    rank = F.row_number().over(Window.partitionBy("terminal").orderBy("n_steps", "cell"))
    chosen = written(all_.withColumn("rank", rank).where(F.col("rank") <= most).select("terminal", "cell").join(areas.select("cell", "area_m2").hint("merge"), "cell", "left"))
    evidence, _ = requested(chosen, layers, "cell")
    rows = chosen.join(evidence.hint("merge"), "cell").withColumn("coverage_fraction", F.lit(1.0)).withColumn("runoff", runoff.runoff())
    totals = runoff.catchment_totals(runoff.cell_volumes(rows), key="terminal")
    size = chosen.groupBy("terminal").agg(F.count(F.lit(1)).alias("n_selected"), F.sum("area_m2").alias("area_m2"))
    found = all_.groupBy("terminal").agg(F.count(F.lit(1)).alias("n_candidates")).join(size.hint("merge"), "terminal").join(totals.hint("merge"), "terminal")
    return found.select("terminal", "n_candidates", "n_selected", (F.col("n_selected") == F.col("n_candidates")).alias("covers_all"), "area_m2", "value", "status", "reason", "partial")


def event_runoff(cells: DataFrame, rain: DataFrame, lats: list[float], lons: list[float], area_m2: float) -> DataFrame:
    """An event's runoff on a grid: the rain of the nearest source cell, runoff depth, volume, and what comes down
    the frozen flow. cells: idx, lat, lon, slope, land_cover, down; rain: i, j (places on the axes), value. As all of the
    land must carry evidence, a cell without a depth raises."""
    at = cells.withColumns({"i": grid.nearest_index(F.col("lat"), lats), "j": grid.nearest_index(F.col("lon"), lons)}).join(rain.select("i", "j", F.col("value").alias("__rain")), ["i", "j"], "left")
    ev = lambda c: available(F.col(c))
    rows = at.withColumns({"rain": ev("__rain"), "slope": ev("slope"), "land_cover": ev("land_cover")}).withColumn("runoff", runoff.runoff())
    depth = written(rows.select("idx", "down", F.col("rain.value").alias("rain_mm"), F.col("runoff.value").alias("runoff_mm"), (F.col("runoff.value") / 1000 * area_m2).alias("volume")))
    if depth.where("volume IS NULL").head(1):
        raise ValueError("cells of the land lack rain, slope or land cover")
    return depth.drop("down").join(grid.volumes(depth, depth).select(F.col("node_id").alias("idx"), F.col("total").alias("accumulated")).hint("merge"), "idx")


def footprint_parameters(pieces: DataFrame, parameters: DataFrame, targets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per target the area-weighted mean of each parameter of its land-cover classes, the dominant class (of
    equals the smallest) and their number, where classes with parameters cover it within the tolerance (a share of its
    area); else nulls. pieces: target, category, area; parameters: category and the parameters; targets: target, area_m2."""
    names = [c for c in parameters.columns if c != "category"]
    per = pieces.where("category IS NOT NULL AND area > 0").groupBy("target", "category").agg(F.sum("area").alias("area"))
    rows = per.join(parameters.select("category", *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__known")), "category", "left")
    out = rows.groupBy("target").agg(
        F.sum("area").alias("mapped"), F.bool_and(F.coalesce("__known", F.lit(False))).alias("known"), F.count(F.lit(1)).alias("n_classes"),
        F.min_by("category", F.struct(-F.col("area"), F.col("category"))).alias("dominant"), *((F.sum(F.col(f"__{c}") * F.col("area")) / F.sum("area")).alias(c) for c in names),
    )
    ok = F.coalesce(F.col("known") & (F.abs(F.col("mapped") - F.col("area_m2")) <= F.col("area_m2") * tolerance), F.lit(False))
    return targets.select("target", "area_m2").join(out, "target", "left").select("target", ok.alias("valid"), *(F.when(ok, F.col(c)).alias(c) for c in ("dominant", "n_classes", *names)))


def asset_risk(assets: DataFrame, scores: DataFrame) -> DataFrame:
    """Assets (asset_id, cell) with the greatest and mean score of their cells; cells without a score are counted apart."""
    rows = assets.join(scores.select("cell", "score"), "cell", "left")
    return rows.groupBy("asset_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("score").isNull()).alias("n_unscored"))


def solver_grid(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """Block means of complete blocks, and of those the ones whose whole neighbourhood is complete."""
    blocks = grid.block_mean(cells, size, "elevation").withColumn("valid", F.col("value").isNotNull())
    return grid.eroded(blocks, halo).select("row", "col", F.col("value").alias("elevation"))


def input_binding(targets: DataFrame, rain: DataFrame, river: DataFrame, bucket: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rain mapping, river weights, and the targets that rain doesn't cover to within 1e-6."""
    mapping = geometry.overlaps(targets, rain, bucket)
    cover = mapping.groupBy("target").agg(F.sum("fraction").alias("f"))
    bare = targets.select(F.col("id").alias("target")).join(cover, "target", "left").where(F.abs(F.coalesce("f", F.lit(0.0)) - 1) > 1e-6)
    return mapping, geometry.footprint_weights(geometry.overlaps(targets, river, bucket)), bare


def evidence_cell(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target coverage, area mean and dominant category of its pieces (target, area, value, status, category);
    the mean stands only where coverage is complete, the mean of what is there is `partial_mean`."""
    out = geometry.coverage(pieces, targets).join(geometry.area_mean(pieces.where(F.col("status").isin(*CARRYING))), "target", "left").join(geometry.category_fractions(pieces).select("target", "dominant"), "target", "left")
    return out.withColumn("partial_mean", F.col("mean")).withColumn("mean", F.when(F.col("complete") & ~F.col("overlapping"), F.col("mean")))


def snapshot_scores(points: DataFrame, asked: DataFrame | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """X01 and the models: latest snapshot, wide features, hazards."""
    wide = cube.features(cube.latest(points), mapping, asked)
    have = wide.columns
    need = {"slope": "double", "elsus_class": "double", "hazard_pga": "double", "clc_class": "int", "lithology": "string"}
    return risk.all_risks(wide.withColumns({n: F.lit(None).cast(k) for n, k in need.items() if n not in have}))
