"""Cells: a square latitude-longitude index, and operators that only need ids, areas and neighbours.

A table of cells (cell, lat, lon, area_m2, res) and one of neighbours (cell, nbr, dist_m) may come from any index; the
square one is built in, a hexagonal one can be read as tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, haversine_m
from ..sources.intermediate import written
from .geometry import in_polygon


def step_deg(res: int) -> float:
    """Side of a cell: 8 degrees at resolution 0, half of it at each further one."""
    return 8.0 / 2**res


def cell_of(lat: Column, lon: Column, res: int) -> Column:
    """Id of the cell of a point; null outside the globe."""
    s = step_deg(res)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.concat_ws("_", F.lit(f"q{res}"), F.floor((lat + 90) / s).cast("string"), F.floor((lon + 180) / s).cast("string")))


def cell_info(cell: Column) -> Column:
    """struct(lat, lon, area_m2, res, south, west, side) of an id; null for what is no id."""
    part = F.split(cell, "_")
    res, i, j = F.substring(F.get(part, 0), 2, 3).cast("int"), F.get(part, 1).cast("long"), F.get(part, 2).cast("long")
    s = F.lit(8.0) / F.pow(F.lit(2.0), res)
    south, west = i * s - 90, j * s - 180
    area = F.lit(EARTH_RADIUS_M**2) * F.radians(s) * (F.sin(F.radians(F.least(south + s, F.lit(90.0)))) - F.sin(F.radians(south)))
    return F.when(valid(cell), F.struct((south + s / 2).alias("lat"), (west + s / 2).alias("lon"), area.alias("area_m2"), res.alias("res"), south.alias("south"), west.alias("west"), s.alias("side")))


def valid(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^q\d{1,2}_\d+_\d+$"), F.lit(False))


def neighbours_of(cells: DataFrame, res: int) -> DataFrame:
    """Cell, nbr, dist_m of the eight neighbours of each cell, in the table or not; the date line is crossed."""
    n = round(360 / step_deg(res))
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))
    part = F.split("cell", "_")
    out = cells.select("cell", F.get(part, 1).cast("long").alias("i"), F.get(part, 2).cast("long").alias("j"), F.explode(offsets).alias("o"))
    i, j = F.col("i") + F.col("o.a"), F.pmod(F.col("j") + F.col("o.b"), F.lit(n))
    out = out.where((i >= 0) & (i < n // 2)).select("cell", F.concat_ws("_", F.lit(f"q{res}"), i.cast("string"), j.cast("string")).alias("nbr"))
    a, b = cell_info(F.col("cell")), cell_info(F.col("nbr"))
    return out.withColumn("dist_m", haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))


def cells_in_box(spark: SparkSession, south: float, west: float, north: float, east: float, res: int) -> DataFrame:
    """Cells whose centre lies in the box; the cell of its middle if there is none. Made by Spark, row by row of the lattice."""
    s = step_deg(res)
    i0, i1 = math.ceil((south + 90) / s - 0.5), math.floor((north + 90) / s - 0.5)
    j0, j1 = math.ceil((west + 180) / s - 0.5), math.floor((east + 180) / s - 0.5)
    if i0 > i1 or j0 > j1:
        i0 = i1 = math.floor(((south + north) / 2 + 90) / s)
        j0 = j1 = math.floor(((west + east) / 2 + 180) / s)
    rows = spark.range(i0, i1 + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(j0), F.lit(j1))).alias("j"))
    return rows.select(F.concat_ws("_", F.lit(f"q{res}"), F.col("i").cast("string"), F.col("j").cast("string")).alias("cell"))


def cells_in_polygon(cells: DataFrame, rings: Column) -> DataFrame:
    """P50: cells whose centre is inside rings of (x: lon, y: lat)."""
    info = cell_info(F.col("cell"))
    return cells.where(in_polygon(rings, info["lon"], info["lat"]))


def halo(cells: DataFrame, res: int) -> DataFrame:
    """Cells and their neighbours, marked."""
    ring = neighbours_of(cells, res).select(F.col("nbr").alias("cell")).distinct().join(cells.select("cell"), "cell", "left_anti")
    return cells.select("cell", F.lit(False).alias("halo")).unionByName(ring.select("cell", F.lit(True).alias("halo")))


def sampling_bounds(cells: DataFrame) -> DataFrame:
    """Box around the centres, half a cell wider, within the globe; wider than 180 degrees is an error in `status`."""
    i = cell_info(F.col("cell"))
    out = cells.select(i.alias("i")).where("i IS NOT NULL").agg(
        F.greatest(F.lit(-90.0), F.min("i.south")).alias("south"), F.least(F.lit(90.0), F.max(F.col("i.south") + F.col("i.side"))).alias("north"),
        F.greatest(F.lit(-180.0), F.min("i.west")).alias("west"), F.least(F.lit(180.0), F.max(F.col("i.west") + F.col("i.side"))).alias("east"),
    )
    return out.withColumn("status", F.when(F.col("east") - F.col("west") > 180, "invalid_response").otherwise("available"))


def nearest_node(points: DataFrame, nodes: DataFrame, reach_m: float = 1000.0) -> DataFrame:
    """Each point (point_id, lat, lon) with the nearest node (of equals the smallest id), however far: node_id, distance_m.

    Points and nodes meet in cubes of space as wide as the reach, so neither poles nor the date line cut anything off.
    A point is settled by a node within the reach only; those that found none look again four times as far, at last
    over the whole globe. Without any node both are null. Points of one place look once, and of nodes of one place only
    the smallest id is looked at. Where nodes lie denser than one to a cube, the first reach is shorter than reach_m.
    """

    def placed(df: DataFrame, width: float, *names: str) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        xyz = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
        return df.select(*names, "lat", "lon", *(F.floor(c * EARTH_RADIUS_M / width).alias(f"b{i}") for i, c in enumerate(xyz)))

    nodes = written(nodes.groupBy("lat", "lon").agg(F.min("node_id").alias("node_id")), "nodes")
    settled, left = None, written(points.select("lat", "lon").distinct(), "unsettled")
    reach = min(reach_m, EARTH_RADIUS_M * math.sqrt(4 * math.pi / max(1, nodes.count())))
    while True:
        # a chord is never longer than its arc, so what is within the reach is at most one cube away
        near = placed(nodes, reach, "node_id")
        for i in range(3):
            near = near.withColumn(f"o{i}", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(f"b{i}", F.col(f"b{i}") + F.col(f"o{i}")).drop(f"o{i}")
        near = near.withColumnsRenamed({"lat": "nlat", "lon": "nlon"})
        pairs = placed(left, reach).join(near.hint("merge"), ["b0", "b1", "b2"]).select("lat", "lon", "node_id", haversine_m("lat", "lon", "nlat", "nlon").alias("d")).where(F.col("d") <= reach)
        got = written(pairs.groupBy("lat", "lon").agg(F.min_by("node_id", F.struct("d", "node_id")).alias("node_id"), F.min("d").alias("distance_m")), "nearest")
        settled = got if settled is None else settled.unionByName(got)
        left = written(left.join(got, ["lat", "lon"], "left_anti"), "unsettled")
        if reach > EARTH_RADIUS_M * 4 or not left.head(1):
            return points.select("point_id", "lat", "lon").join(settled, ["lat", "lon"], "left").select("point_id", "node_id", "distance_m")
        reach *= 4
