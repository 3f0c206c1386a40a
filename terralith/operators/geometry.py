"""Polygons as array<array<struct<x, y>>> (rings, holes after the shell), overlays of rectangles, and area-weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import CARRYING, PRECEDENCE_SPATIAL, rank_of


def _edges(ring: Column) -> Column:
    """array<struct<a, b>> of a ring's edges, closed if it isn't."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, half-open: a point on a lower or left edge is inside, on an upper or right one not."""

    def flip(inside: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        left = x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) + a["x"]
        return inside != F.coalesce(spans & left, F.lit(False))

    return F.aggregate(_edges(ring), F.lit(False), flip)


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, for masks that count it as inside."""

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (F.abs(cross) < 1e-12) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(_edges(ring), touches)


def in_polygon(rings: Column, x: Column, y: Column, edges_inside: bool = False) -> Column:
    """Inside the first ring and in none of the others."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    inside = in_ring(rings[0], x, y) & ~F.exists(holes, lambda h: in_ring(h, x, y))
    return (inside | F.exists(rings, lambda r: on_ring(r, x, y))) if edges_inside else inside


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula."""
    twice = lambda r: F.aggregate(_edges(r), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(_bound(ring, twice)) / 2


def clipped(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring clipped to a rectangle, one side after the other."""
    point = "array<struct<x:double,y:double>>"

    def side(r: Column, axis: str, at: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        ok = lambda p: (p[axis] >= at) if keep_above else (p[axis] <= at)

        def cut(e: Column) -> Column:
            a, b = e["a"], e["b"]
            t = (at - a[axis]) / F.when(b[axis] == a[axis], F.lit(None)).otherwise(b[axis] - a[axis])
            values = {axis: at, other: a[other] + (b[other] - a[other]) * t}
            crossing = F.array(F.struct(values["x"].alias("x"), values["y"].alias("y"))).cast(point)
            none = F.array().cast(point)
            return F.concat(F.when(ok(a) != ok(b), crossing).otherwise(none), F.when(ok(b), F.array(b).cast(point)).otherwise(none))

        return F.flatten(F.transform(_edges(r), cut))

    def sided(out: Column, axis: str, at: Column, above: bool) -> Column:
        return _bound(out, lambda r: side(r, axis, at, above))

    out = ring.cast(point)
    for axis, at, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        out = sided(out, axis, at, above)
    return out


def containing(points: DataFrame, polygons: DataFrame, bucket: float, priority: str = "priority") -> DataFrame:
    """Each point (point_id, x, y) with the polygon (polygon_id, rings, priority) that contains it, of
    several the least priority, then id. Candidates meet in square buckets that a polygon's bounding box covers. Points
    of one place meet them once, and so do polygons of the same rings, which are counted and have their least beforehand."""
    shell = F.col("rings")[0]
    box = lambda f, c: F.floor(f(F.transform(shell, lambda p: p[c])) / bucket)
    shapes = polygons.groupBy("rings").agg(F.min(F.struct(F.col(priority).alias("priority"), "polygon_id")).alias("__least"), F.count(F.lit(1)).alias("__n"))
    spread = shapes.select("__least", "__n", "rings", F.explode(F.sequence(box(F.array_min, "x"), box(F.array_max, "x"))).alias("bx"), F.sequence(box(F.array_min, "y"), box(F.array_max, "y")).alias("__ys"))
    spread = spread.withColumn("by", F.explode("__ys")).drop("__ys")
    places = points.select("x", "y").distinct().withColumns({"bx": F.floor(F.col("x") / bucket), "by": F.floor(F.col("y") / bucket)})
    hit = places.join(spread, ["bx", "by"]).where(in_polygon(F.col("rings"), F.col("x"), F.col("y")))
    best = hit.groupBy("x", "y").agg(F.min("__least").alias("__least"), F.sum("__n").alias("n_containing"))
    best = best.select("x", "y", F.col("__least.polygon_id").alias("polygon_id"), "n_containing")
    return points.join(best, ["x", "y"], "left").select(*points.columns, "polygon_id", F.coalesce("n_containing", F.lit(0)).alias("n_containing"))


def rasterised(polygons: DataFrame, size: float) -> DataFrame:
    """polygon_id, row, col of the cells whose centre is inside by even-odd crossings, a row of cells at a time."""
    shell = F.flatten(F.transform("rings", _edges))
    low, high = F.array_min(F.transform(shell, lambda e: F.least(e["a"]["y"], e["b"]["y"]))), F.array_max(F.transform(shell, lambda e: F.greatest(e["a"]["y"], e["b"]["y"])))
    lines = polygons.select("polygon_id", shell.alias("__e"), F.explode(F.sequence(F.floor(low / size), F.ceil(high / size))).alias("row")).withColumn("__y", (F.col("row") + 0.5) * size)
    y = F.col("__y")
    crossed = F.filter("__e", lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(crossed, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    spans = lines.select("polygon_id", "row", xs.alias("__x")).where("size(__x) > 1")
    spans = spans.select("polygon_id", "row", "__x", F.explode(F.sequence(F.lit(0), (F.floor(F.size("__x") / 2) - 1).cast("int"))).alias("i"))
    # centres from the first crossing (included) to the second (excluded)
    first, last = F.ceil(F.element_at("__x", 2 * F.col("i") + 1) / size - 0.5), F.ceil(F.element_at("__x", 2 * F.col("i") + 2) / size - 0.5) - 1
    return spans.where(first <= last).select("polygon_id", "row", F.explode(F.sequence(first, last)).alias("col"))


def subcell_coverage(polygons: DataFrame, size: float) -> DataFrame:
    """Share of a cell's 4 x 4 sample points that any polygon covers: bits of the samples are OR-ed and counted."""
    fine = rasterised(polygons, size / 4)
    bit = F.expr("shiftleft(1, CAST(pmod(row, 4) * 4 + pmod(col, 4) AS INT))")
    out = fine.select(F.floor(F.col("row") / 4).alias("r"), F.floor(F.col("col") / 4).alias("c"), bit.alias("bit")).groupBy("r", "c").agg(F.bit_or("bit").alias("bits"))
    return out.select(F.col("r").alias("row"), F.col("c").alias("col"), (F.bit_count("bits") / 16).alias("fraction"))


def overlaps(targets: DataFrame, sources: DataFrame, bucket: float) -> DataFrame:
    """Pairs of rectangles (id, x0, y0, x1, y1) that share area, with it. Each pair is made in one bucket
    only: the one with the lower left corner of what they share."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        cover = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))
        out = df.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(cover("x0", "x1")).alias("bx"), cover("y0", "y1").alias("__by"))
        return out.withColumn("by", F.explode("__by")).drop("__by")

    both = spread(targets, "target").join(spread(sources, "source"), ["bx", "by"])
    x0, y0 = F.greatest("target_x0", "source_x0"), F.greatest("target_y0", "source_y0")
    w, h = F.least("target_x1", "source_x1") - x0, F.least("target_y1", "source_y1") - y0
    own = (F.floor(x0 / bucket) == F.col("bx")) & (F.floor(y0 / bucket) == F.col("by"))
    whole = (F.col("target_x1") - F.col("target_x0")) * (F.col("target_y1") - F.col("target_y0"))
    return both.where((w > 0) & (h > 0) & own).select("target", "source", (w * h).alias("area"), (w * h / whole).alias("fraction"))


def weighted_sum(mapping: DataFrame, sources: DataFrame) -> DataFrame:
    """Mapping (target, source, fraction) times sources (source, value), per target; a source without a value makes
    the total missing."""
    rows = mapping.join(sources.select("source", "value"), "source", "left")
    out = rows.groupBy("target").agg(F.sum(F.col("value") * F.col("fraction")).alias("partial"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.sum("fraction").alias("coverage"))
    return out.select("target", F.when(F.col("n_missing") == 0, F.col("partial")).alias("value"), "partial", "n_missing", "coverage")


def footprint_weights(mapping: DataFrame) -> DataFrame:
    """Fractions of each source that add up to 1 over the targets it reaches."""
    total = mapping.groupBy("source").agg(F.sum("area").alias("__total"))
    return mapping.join(total, "source").select("source", "target", (F.col("area") / F.col("__total")).alias("weight"))


def coverage(pieces: DataFrame, targets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per target (target, area_m2) the mapped, observed, unavailable and uncovered area, fractions, whether it is
    complete, and whether pieces overlap. pieces: target, area, value, status."""
    ok = F.col("value").isNotNull() & F.col("status").isin(*CARRYING)
    per = pieces.groupBy("target").agg(F.sum("area").alias("mapped"), F.sum(F.when(ok, F.col("area")).otherwise(0.0)).alias("observed"), F.min(rank_of(F.col("status"), PRECEDENCE_SPATIAL)).alias("worst"))
    out = targets.select("target", "area_m2").join(per, "target", "left").fillna(0.0, ["mapped", "observed"])  # areas, not evidence: none mapped is an area of 0
    names = F.array(*map(F.lit, (*PRECEDENCE_SPATIAL, "missing")))
    slack = F.col("area_m2") * tolerance
    complete = F.abs(F.col("observed") - F.col("area_m2")) <= slack
    return out.select(
        "target", "area_m2", "mapped", "observed", (F.col("mapped") - F.col("observed")).alias("unavailable"), F.greatest(F.lit(0.0), F.col("area_m2") - F.col("mapped")).alias("uncovered"),
        (F.col("observed") / F.col("area_m2")).alias("observed_fraction"), complete.alias("complete"), (F.col("mapped") > F.col("area_m2") + slack).alias("overlapping"),
        F.when(complete, "available").when(F.col("worst").isNull(), "out_of_coverage").otherwise(F.element_at(names, F.coalesce("worst", F.lit(0)) + 1)).alias("status"),
    )


def area_mean(pieces: DataFrame, key: str = "target", value: str = "value", area: str = "area") -> DataFrame:
    """Area-weighted mean of the pieces with a value; one piece gives its own value."""
    rows = pieces.where(F.col(value).isNotNull())
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(value) * F.col(area)) / F.sum(area)).alias("m"), F.min(value).alias("only"))
    return out.select(key, "n", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("m")).alias("mean"))


def category_fractions(pieces: DataFrame, key: str = "target", category: str = "category", area: str = "area") -> DataFrame:
    """Per target the share of each category and the dominant one (of equals the smallest code)."""
    per = pieces.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.sum(area).alias("a"))
    total = per.groupBy(key).agg(F.sum("a").alias("total"), F.min_by(category, F.struct(-F.col("a"), F.col(category))).alias("dominant"), F.array_sort(F.collect_list(F.struct(F.col(category).alias("category"), F.col("a").alias("area")))).alias("areas"))
    return total.select(key, "dominant", "total", F.transform("areas", lambda x: F.struct(x["category"].alias("category"), (x["area"] / F.col("total")).alias("fraction"))).alias("fractions"))


def polygon_pixel_mean(pixels: DataFrame, key: str = "polygon_id", value: str = "value", low: float = -1000.0, high: float = 9000.0, most_missing: float = 0.6) -> DataFrame:
    """Mean of a polygon's pixels; too much no-data is missing, a value out of range is invalid; quality is the share with data."""
    v = F.when(~F.isnan(value), F.col(value))
    out = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("ok"), F.avg(v).alias("m"), F.bool_or((v < low) | (v > high)).alias("odd"))
    status = F.when(1 - F.col("ok") / F.col("n") > most_missing, "missing").when(F.coalesce("odd", F.lit(False)), "invalid_response").otherwise("available")
    return out.select(key, F.when(status == "available", F.col("m")).alias("value"), status.alias("status"), (F.col("ok") / F.col("n")).alias("quality"))


def centre_edges(axis: DataFrame, order: str = "i", centre: str = "x") -> DataFrame:
    """Lower and upper edge of each centre: midpoints, the ends extrapolated. An axis is short: one ordered window."""
    from pyspark.sql.window import Window

    w = Window.orderBy(order)
    before, after = F.lag(centre).over(w), F.lead(centre).over(w)
    x = F.col(centre)
    return axis.withColumns({"lower": F.coalesce((before + x) / 2, x - (after - x) / 2), "upper": F.coalesce((x + after) / 2, x + (x - before) / 2)})
