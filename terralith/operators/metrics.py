"""Ranking and overlap metrics. Ties share their rank; an empty denominator gives null, not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import point_segment_distance
from ..sources.intermediate import written

#: Ranges of scores that are cumulated side by side, so that no task sorts all scores: so many, or one for each shuffle partition.
RANGES = 64


def score_groups(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Per distinct score its rows and positives, with cumulative counts from below and from above.

    Scores fall into RANGES ranges by approximate quantiles. Sums run within a range; what lies before and behind
    it comes from the ranges' totals, a row for each. Where the ranges are cut changes nothing in the result.
    """
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    n = max(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(F.col(score).cast("double"), [i / n for i in range(1, n)], 1000).alias("q")).first().q or []
    groups = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda q: q < F.col("score")))
    groups = groups.withColumn("__range", place)
    totals = groups.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"), F.sum("p").alias("__p"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(*keys, "__range", zero(F.sum("__n").over(before)).alias("__n0"), zero(F.sum("__p").over(before)).alias("__p0"), F.sum("__n").over(w).alias("n_all"), F.sum("__p").over(w).alias("p_all"))
    up = Window.partitionBy(*keys, "__range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    out = groups.withColumns({"__n1": F.sum("n").over(up), "__p1": F.sum("p").over(up)}).join(totals, [*keys, "__range"])
    n_below, p_below = F.col("__n0") + F.col("__n1") - F.col("n"), F.col("__p0") + F.col("__p1") - F.col("p")
    return out.select(*keys, "score", "n", "p", n_below.alias("n_below"), (F.col("n_all") - n_below).alias("n_above"), (F.col("p_all") - p_below).alias("p_above"), "n_all", "p_all")


def ranking(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """ROC-AUC with averaged ranks, average precision with tie groups, counts and prevalence."""
    g = score_groups(rows, keys, score, label)
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    precision = F.try_divide(F.col("p"), F.col("p_all")) * (F.col("p_above") / F.col("n_above"))
    out = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * rank).alias("__r"), F.sum(precision).alias("average_precision"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    auc = F.when((p > 0) & (q > 0), (F.col("__r") - p * (p + 1) / 2) / (p * q))
    return out.select(*keys, "n", "positives", (p / F.col("n")).alias("prevalence"), auc.alias("roc_auc"), F.when(p > 0, F.col("average_precision")).alias("average_precision"))


def overlap_at(rows: DataFrame, keys: list[str], score: str, label: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """Precision, recall and IoU of the top share of rows; the group at the threshold counts with a fraction."""
    g = score_groups(rows, keys, score, label).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    want = F.col("fraction") * F.col("n_all")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (want - (F.col("n_above") - F.col("n"))) / F.col("n")))
    out = g.groupBy(*keys, "fraction").agg(F.sum(share * F.col("n")).alias("selected"), F.sum(share * F.col("p")).alias("hits"), F.max("p_all").alias("positives"))
    d = lambda a, b: F.when(b > 0, a / b)
    return out.select(*keys, "fraction", "selected", "hits", d(F.col("hits"), F.col("selected")).alias("precision"), d(F.col("hits"), F.col("positives")).alias("recall"), d(F.col("hits"), F.col("selected") + F.col("positives") - F.col("hits")).alias("iou"))


def score_vector(rows: DataFrame, score: str, water: str) -> DataFrame:
    """Rows with a final score: water is a structural zero, round-off below zero is zero, the rest must be finite."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    final = F.when(F.col(water), 0.0).when(finite, F.when((s < 0) & (s > -1e-9), 0.0).otherwise(s))
    return rows.withColumns({"final_score": final, "score_kind": F.when(F.col(water), "water_zero").when(~finite, "excluded").when((s < 0) & (s > -1e-9), "clamped").otherwise("score")})


def score_summary(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Count, min, max, mean, median (average of the two middles) and zeros."""
    return rows.groupBy(*keys).agg(F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"), F.count_if(F.col(score) == 0).alias("zeros"))


def contingency(rows: DataFrame, keys: list[str], predicted: str, observed: str, cell_area: float = 1.0) -> DataFrame:
    """Counts, areas, IoU, precision and recall of two masks where both are known; null with a reason where undefined."""
    a, b = F.col(predicted), F.col(observed)
    known = a.isNotNull() & b.isNotNull()
    out = rows.groupBy(*keys).agg(F.count_if(known & a & b).alias("tp"), F.count_if(known & a & ~b).alias("fp"), F.count_if(known & ~a & b).alias("fn"), F.count_if(known & ~a & ~b).alias("tn"), F.count_if(~known).alias("unknown"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda x, y: F.when(y > 0, x / y)
    return out.withColumns({
        "iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "predicted_area": (tp + fp) * cell_area, "observed_area": (tp + fn) * cell_area,
        "undefined": F.concat_ws(",", F.when(tp + fp == 0, "no predicted cell"), F.when(tp + fn == 0, "no observed cell")),
    })


def error_class(predicted: str, observed: str) -> Column:
    """0 dry, 1 hit, 2 false alarm, 3 miss, 255 unknown."""
    a, b = F.col(predicted), F.col(observed)
    return F.when(a.isNull() | b.isNull(), 255).when(a & b, 1).when(a, 2).when(b, 3).otherwise(0)


def class_contingency(rows: DataFrame, band: str, predicted: str, observed: str) -> DataFrame:
    """Error classes by band, with the sum of each row."""
    kind = error_class(predicted, observed)
    return rows.groupBy(band).agg(*(F.count_if(kind == k).alias(n) for k, n in ((0, "dry"), (1, "hit"), (2, "false_alarm"), (3, "miss"), (255, "unknown"))), F.count(F.lit(1)).alias("total"))


def nested_thresholds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """Per neighbouring pair of masks (deepest first) how many cells break that the first lies within the second."""
    return rows.agg(*(F.count_if(F.coalesce(F.col(a) & ~F.col(b), F.lit(False))).alias(f"{a}_outside_{b}") for a, b in zip(masks, masks[1:])))


def boundary_segments(cells: DataFrame, wet: str, size: float) -> DataFrame:
    """Edges between a wet cell and a known dry one: row, col, side, and the edge's midpoint."""
    known = cells.where(F.col(wet).isNotNull())
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, dr, dc in (("N", -1, 0), ("E", 0, 1), ("S", 1, 0), ("W", 0, -1))))
    out = known.where(F.col(wet)).select("row", "col", F.explode(sides).alias("s"))
    dry = known.where(~F.col(wet)).select(F.col("row").alias("r2"), F.col("col").alias("c2"))
    out = out.join(dry, (F.col("r2") == F.col("row") + F.col("s.dr")) & (F.col("c2") == F.col("col") + F.col("s.dc")))
    return out.select("row", "col", "s.side", ((F.col("col") + 0.5 + F.col("s.dc") * 0.5) * size).alias("x"), ((F.col("row") + 0.5 + F.col("s.dr") * 0.5) * size).alias("y"))


def _within(a: DataFrame, b: DataFrame, size: float, reach: float) -> DataFrame:
    """x, y, distance (null: none within reach * size) from points of a to edges of b, by buckets: the pairs are those of
    neighbouring buckets, not all. A bucket is wider than the reach by an edge, whose midpoint gives its own bucket."""
    w = size * (reach + 1)
    flat, half = F.col("side").isin("N", "S"), F.lit(size / 2)
    ends = [F.col("x") - F.when(flat, half).otherwise(0.0), F.col("y") - F.when(flat, 0.0).otherwise(half), F.col("x") + F.when(flat, half).otherwise(0.0), F.col("y") + F.when(flat, 0.0).otherwise(half)]
    near = b.select(F.floor(F.col("x") / w).alias("bx0"), F.floor(F.col("y") / w).alias("by0"), *(e.alias(n) for e, n in zip(ends, ("ax", "ay", "cx", "cy")))).distinct()
    spread = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = near.withColumn("o", F.explode(spread)).select((F.col("bx0") + F.col("o.i")).alias("bx"), (F.col("by0") + F.col("o.j")).alias("by"), "ax", "ay", "cx", "cy")
    left = a.select("x", "y").distinct().withColumns({"bx": F.floor(F.col("x") / w), "by": F.floor(F.col("y") / w)})
    d = left.join(near, ["bx", "by"], "left").groupBy("x", "y").agg(F.min(point_segment_distance("x", "y", "ax", "ay", "cx", "cy")).alias("d"))
    return d.select("x", "y", F.when(F.col("d") <= size * reach, F.col("d")).alias("distance"))


def boundary_distances(a: DataFrame, b: DataFrame, size: float, reach: float = 8) -> DataFrame:
    """X, y, distance from each edge's midpoint of a to the nearest edge of b, however far; null if b has none.

    Points that find nothing within reach look again four times as far, so most are found among few pairs.
    """
    if not b.head(1):
        return a.select("x", "y", F.lit(None).cast("double").alias("distance")).distinct()
    out = None
    while True:
        found = written(_within(a, b, size, reach), "boundary_distances")
        done = found.where("distance IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        a, reach = found.where("distance IS NULL"), reach * 4
        if not a.head(1):
            return out


def symmetric_p95(a: DataFrame, b: DataFrame, size: float, reach: float = 8) -> DataFrame:
    """The 95th percentile (linear) of both directions' distances together, the largest, and their number; nulls
    and 0 if either boundary is empty."""
    both = boundary_distances(a, b, size, reach).unionByName(boundary_distances(b, a, size, reach))
    return both.agg(F.percentile("distance", 0.95).alias("p95"), F.max("distance").alias("largest"), F.count("distance").alias("n"))
