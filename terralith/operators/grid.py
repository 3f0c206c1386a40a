"""Regular grids as rows (row, col, ...): blocks, masks, D8 routing, sampling and hex neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite_difference_slope
from .evidence import PRECEDENCE_SLOPE, worst_of
from .network import forest

# Neighbours in the order N NE E SE S SW W NW, codes of terminals.
NEIGHBOURS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
FLOWING, BOUNDARY, WATER, DEPRESSION, MISSING_INPUT, NONE = 0, 1, 2, 3, 4, 255
ELEVATION_TOLERANCE, GRADIENT_TIE = 1e-6, 1e-15


def block_mean(cells: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Mean of size x size blocks of which every cell has a value; other blocks are null."""
    v = F.when(~F.isnan(value), F.col(value))
    out = cells.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(F.count(v).alias("n"), F.avg(v).alias("m"))
    return out.select("row", "col", F.col("n").alias("n_valid"), F.when(F.col("n") == size * size, F.col("m")).alias("value"))


def pyramid(cells: DataFrame, size: int, value: str, group: str, water: str) -> DataFrame:
    """Per block its coverage, mean, maximum, dominant group (of equals the lowest), and whether any is water."""
    where = [F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")]
    by_group = cells.groupBy(*where, F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("ok"), F.sum(value).alias("s"), F.max(value).alias("mx"), F.bool_or(water).alias("w"))
    out = by_group.groupBy("row", "col").agg(
        (F.sum("ok") / (size * size)).alias("coverage"), F.try_divide(F.sum("s"), F.sum("ok")).alias("mean"), F.max("mx").alias("max"),
        F.min_by(F.col("g"), F.when(F.col("g").isNotNull(), F.struct(-F.col("n"), F.col("g")))).alias("dominant"), F.bool_or("w").alias("any_water"),
    )
    return out


def eroded(cells: DataFrame, halo: int, valid: str = "valid") -> DataFrame:
    """Cells that are valid with their whole (2 halo + 1) square inside the grid. Only invalid cells are spread."""
    around = [(r, c) for r in range(-halo, halo + 1) for c in range(-halo, halo + 1)]
    offsets = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in around))
    bad = cells.where(~F.coalesce(F.col(valid), F.lit(False))).select((F.col("row")).alias("r0"), F.col("col").alias("c0"), F.explode(offsets).alias("o"))
    bad = bad.select((F.col("r0") + F.col("o.r")).alias("row"), (F.col("c0") + F.col("o.c")).alias("col")).distinct()
    size = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    inside = F.lit(False) if size.r0 is None else F.col("row").between(size.r0 + halo, size.r1 - halo) & F.col("col").between(size.c0 + halo, size.c1 - halo)
    return cells.where(F.col(valid)).where(inside).join(bad, ["row", "col"], "left_anti")


def pixel_stats(cells: DataFrame, value: str) -> DataFrame:
    """Valid and no-data counts, least and greatest value; NaN is no data."""
    v = F.when(~F.isnan(value), F.col(value))
    return cells.agg(F.count(v).alias("n_valid"), (F.count(F.lit(1)) - F.count(v)).alias("n_no_data"), F.round(F.min(v), 3).alias("min"), F.round(F.max(v), 3).alias("max"))


def nearest_index(value: Column, axis: list[float]) -> Column:
    """Place of the nearest axis value, of equals the lowest; null outside the axis by more than half a step."""
    a = F.array(*map(F.lit, map(float, axis)))
    best = F.array_min(F.transform(a, lambda x, i: F.struct(F.round(F.abs(x - value), 12).alias("d"), i.alias("i"))))["i"]
    half = max((abs(b - c) for b, c in zip(axis, axis[1:])), default=0.0) / 2
    return F.when(value.between(min(axis) - half, max(axis) + half), best)


def nearest_pixel(points: DataFrame, pixels: DataFrame, west: float, north: float, size: float, value: str = "value", least: float | None = 0.0) -> DataFrame:
    """Each point (lat, lon) with the pixel it lies in: value and status; outside the raster is out of coverage,
    values under `least` are invalid."""
    at = points.withColumns({"row": F.floor((F.lit(north) - F.col("lat")) / size), "col": F.floor((F.col("lon") - west) / size)})
    hit = at.join(pixels.select("row", "col", F.col(value).alias("value"), F.lit(True).alias("__in")), ["row", "col"], "left")
    v = F.col("value")
    status = F.when(F.col("__in").isNull(), "out_of_coverage").when(v.isNull() | F.isnan(v), "missing").when(F.lit(False) if least is None else v < least, "invalid_response").otherwise("available")
    return hit.select(*points.columns, F.when(status == "available", v).alias("value"), status.alias("status"))


def terrain_samples(points: DataFrame, pixels: DataFrame, west: float, north: float, size: float, value: str = "value", offset: float = 1 / 3600, ident: str = "point_id") -> DataFrame:
    """Of each point (ident, lat, lon) the elevation of its pixel, and the slope from those `offset` degrees north,
    south, east and west: value and status each. A slope needs all four; of their failures the first in order counts.
    Points of one place are sampled once."""
    o = F.lit(offset)
    offsets = {"centre": (0, 0), "north": (1, 0), "south": (-1, 0), "east": (0, 1), "west": (0, -1)}
    around = F.array(*(F.struct(F.lit(n).alias("place"), (F.col("lat") + o * dy).alias("lat"), (F.col("lon") + o * dx).alias("lon")) for n, (dy, dx) in offsets.items()))
    places = points.select("lat", "lon").distinct()
    five = places.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.explode(around).alias("__p")).select("__lat", "__lon", "__p.*")
    hit = nearest_pixel(five, pixels.hint("merge"), west, north, size, value, least=None)
    got = lambda n: F.max(F.when(F.col("place") == n, F.struct("value", "status"))).alias(n)
    per = hit.groupBy("__lat", "__lon").agg(*map(got, offsets))
    per = points.select(ident, "lat", "lon").join(per, F.col("lat").eqNullSafe(F.col("__lat")) & F.col("lon").eqNullSafe(F.col("__lon")), "left")
    failed = worst_of([F.col(f"{n}.status") for n in ("north", "south", "east", "west")], PRECEDENCE_SLOPE)
    slope = finite_difference_slope(*(F.col(f"{n}.value") for n in ("west", "east", "south", "north")), F.col("__lat"), offset)
    return per.select(ident, F.col("centre.value").alias("elevation"), F.col("centre.status").alias("elevation_status"), F.when(failed.isNull(), slope).alias("slope"), F.coalesce(failed, F.lit("available")).alias("slope_status"))


def aligned_bounds(x0: Column, y0: Column, x1: Column, y1: Column, origin_x: float, origin_y: float, size: float) -> Column:
    """struct(x0, y0, x1, y1, width, height): the bounds widened to a lattice of cells of that size, and its number of cells."""
    down = lambda v, o: F.lit(o) + F.floor((v - F.lit(o)) / size) * size
    up = lambda v, o: F.lit(o) + F.ceil((v - F.lit(o)) / size) * size
    a, b, c, d = down(x0, origin_x), down(y0, origin_y), up(x1, origin_x), up(y1, origin_y)
    return F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), F.round((c - a) / size).cast("long").alias("width"), F.round((d - b) / size).cast("long").alias("height"))


def pixel_window(source: tuple[Column, ...], inner: tuple[Column, ...], size: float, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom, status): pixels of a raster (x0, y0, x1, y1; width by height) that bounds
    inside it take up. Bounds off the lattice or out of the raster have no window: status invalid."""
    (sx0, _, _, sy1), (x0, y0, x1, y1) = source, inner
    edges = {"left": (x0 - sx0) / size, "top": (sy1 - y1) / size, "right": (x1 - sx0) / size, "bottom": (sy1 - y0) / size}
    whole = F.lit(True)
    for v in edges.values():
        whole &= v == F.floor(v)
    ok = F.coalesce(whole & (edges["left"] >= 0) & (edges["top"] >= 0) & (edges["right"] <= width) & (edges["bottom"] <= height) & (edges["left"] < edges["right"]) & (edges["top"] < edges["bottom"]), F.lit(False))
    return F.struct(*(F.when(ok, v.cast("long")).alias(n) for n, v in edges.items()), F.when(ok, "available").otherwise("invalid").alias("status"))


def neighbours(cells: DataFrame, *columns: str, key: str = "cell") -> DataFrame:
    """Cells joined with what their eight neighbours hold: dir, and the columns prefixed n_. Missing neighbours have nulls."""
    offsets = F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(NEIGHBOURS)))
    around = cells.select("*", F.explode(offsets).alias("__o")).withColumns({"__r": F.col("row") + F.col("__o.dr"), "__c": F.col("col") + F.col("__o.dc"), "dir": F.col("__o.dir")})
    other = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), *(F.col(c).alias(f"n_{c}") for c in columns))
    return around.join(other, ["__r", "__c"], "left").drop("__r", "__c", "__o")


def d8(cells: DataFrame, size: float) -> DataFrame:
    """Steepest descent of each cell: idx, down, direction, terminal_type.

    cells: idx, row, col, inside, elevation, water. Of the eight gradients the first in order that none after it
    exceeds by more than the tie wins. A land cell with a neighbour off the area is a boundary terminal. Another one
    without a lower neighbour is a missing-input terminal if a neighbour's elevation is missing, else a depression.
    """
    land = cells.withColumn("land", F.coalesce(F.col("inside") & ~F.col("water") & F.col("elevation").isNotNull(), F.lit(False)))
    around = neighbours(land, "idx", "inside", "elevation", "water", "land").where("land")
    length = F.when(F.col("dir") % 2 == 1, size * 2**0.5).otherwise(size)
    drop = F.col("elevation") - F.col("n_elevation")
    grade = F.when(F.coalesce(F.col("n_inside"), F.lit(False)) & (drop > ELEVATION_TOLERANCE), drop / length)
    own = around.groupBy("idx").agg(
        F.array_sort(F.collect_list(F.struct("dir", grade.alias("grade"), F.col("n_idx").alias("to"), F.col("n_water").alias("wet")))).alias("n"),
        F.bool_or(~F.coalesce(F.col("n_inside"), F.lit(False))).alias("edge"), F.bool_or(F.coalesce(F.col("n_inside"), F.lit(False)) & F.col("n_elevation").isNull()).alias("gap"),
    )
    kind = "struct<dir:int,grade:double,to:" + cells.schema["idx"].dataType.simpleString() + ",wet:boolean>"
    best = F.aggregate("n", F.lit(None).cast(kind), lambda acc, x: F.when(x["grade"].isNotNull() & (acc["grade"].isNull() | (x["grade"] > acc["grade"] + GRADIENT_TIE)), x.cast(kind)).otherwise(acc))
    out = own.withColumn("b", best)
    kind_of = F.when(F.col("edge"), BOUNDARY).when(F.col("b.to").isNotNull(), FLOWING).when(F.col("gap"), MISSING_INPUT).otherwise(DEPRESSION)
    return out.select("idx", F.when(kind_of == FLOWING, F.col("b.to")).alias("down"), F.when(kind_of == FLOWING, F.col("b.dir")).alias("direction"), kind_of.alias("terminal_type"))


def concentration(cells: DataFrame, size: float) -> DataFrame:
    """d8 with terminal, count and area of what drains through each cell."""
    flow = d8(cells, size)
    totals = forest(flow.select(F.col("idx").alias("node_id"), "down"), flow.select(F.col("idx").alias("node_id"), F.lit(1.0).alias("own")).unionByName(cells.where("inside AND water").select(F.col("idx").alias("node_id"), F.lit(0.0).alias("own"))))
    out = flow.join(totals.withColumnRenamed("node_id", "idx"), "idx")
    return out.select("idx", "down", "direction", "terminal_type", "terminal", F.col("total").cast("long").alias("n_cells"), (F.col("total") * size * size).alias("area_m2"))


def volumes(flow: DataFrame, local: DataFrame) -> DataFrame:
    """Local volumes (idx, volume) summed down a frozen d8 (idx, down)."""
    return forest(flow.select(F.col("idx").alias("node_id"), "down"), local.select(F.col("idx").alias("node_id"), F.col("volume").alias("own")))


def idw(targets: DataFrame, samples: DataFrame, pairs: DataFrame, steps: int = 4, least: int = 3, most: int = 18) -> DataFrame:
    """Values at cells by inverse distance on the grid: the `most` nearest of at least `least` samples within
    `steps`. pairs: cell, nbr, steps. Fewer samples give null. All tables are as long as the area, so joins are by shuffle."""
    near = pairs.where(F.col("steps").between(1, steps)).join(samples.select(F.col("cell").alias("nbr"), "value").where("value IS NOT NULL").hint("merge"), "nbr").join(targets.select("cell").hint("merge"), "cell")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("steps", "nbr"))).where(F.col("k") <= most)
    out = near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("value") / F.col("steps")) / F.sum(1 / F.col("steps"))).alias("v"))
    return targets.select("cell").join(out.hint("merge"), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n_samples"), F.when(F.col("n") >= least, F.col("v")).alias("value"))


def rings(neighbour: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Cell, nbr, steps: what lies within k steps on the adjacency (cell, nbr), with the least number of steps.
    Joins are by shuffle: the adjacency is as long as the area, and so may the cells be."""
    seen = cells.select("cell", F.col("cell").alias("nbr"), F.lit(0).alias("steps")).distinct()
    edge = seen
    for i in range(1, k + 1):
        edge = edge.join(neighbour.select(F.col("cell").alias("nbr"), F.col("nbr").alias("far")).hint("merge"), "nbr").select("cell", F.col("far").alias("nbr"), F.lit(i).alias("steps")).distinct()
        edge = edge.join(seen.hint("merge"), ["cell", "nbr"], "left_anti")
        seen = seen.unionByName(edge)
    return seen


def steepest_neighbour(cells: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Of each cell the neighbour with the steepest descent, of equals the smallest id. cells: cell, elevation;
    adjacency: cell, nbr, dist_m."""
    high = adjacency.join(cells.select(F.col("cell").alias("nbr"), F.col("elevation").alias("below")).hint("merge"), "nbr").join(cells.select("cell", "elevation").hint("merge"), "cell")
    grade = (F.col("elevation") - F.col("below")) / F.col("dist_m")
    best = high.withColumn("grade", grade).where("grade > 0").groupBy("cell").agg(F.min_by("nbr", F.struct(-F.col("grade"), "nbr")).alias("down"), F.max("grade").alias("grade"))
    return cells.select("cell").join(best, "cell", "left")


def immediate_flow(cells: DataFrame, adjacency: DataFrame, outlets: DataFrame) -> DataFrame:
    """Cell, down, ends: the neighbour with the steepest descent (of equals the smallest id), or why there is none.

    A cell without an elevation, and one with a neighbour that has none or isn't in the table, is incomplete_elevation;
    an outlet flows nowhere; a cell without a lower neighbour is a depression. cells: cell, elevation; adjacency: cell,
    nbr, dist_m, of all neighbours, known or not; outlets: cell.
    """
    # by cell last, so that rows are grouped where they were joined; hinted, as these tables are as long as the area
    high = adjacency.join(cells.select(F.col("cell").alias("nbr"), F.col("elevation").alias("below")).hint("merge"), "nbr", "left").join(cells.select("cell", "elevation").hint("merge"), "cell")
    high = high.withColumn("grade", (F.col("elevation") - F.col("below")) / F.col("dist_m"))
    per = high.groupBy("cell").agg(F.bool_or(F.col("below").isNull()).alias("gap"), F.min_by("nbr", F.when(F.col("grade") > 0, F.struct(-F.col("grade"), "nbr"))).alias("down"))
    out = cells.select("cell", "elevation").join(per.hint("merge"), "cell", "left").join(outlets.select("cell", F.lit(True).alias("out")).distinct().hint("merge"), "cell", "left")
    ends = F.when(F.col("elevation").isNull(), "incomplete_elevation").when(F.col("out"), "outlet").when(F.col("gap"), "incomplete_elevation").when(F.col("down").isNull(), "depression")
    return out.select("cell", F.when(ends.isNull(), F.col("down")).alias("down"), ends.alias("ends"))
