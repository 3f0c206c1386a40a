"""Runoff per cell and strict volumes per catchment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import CARRYING, strict_sum, worst_of

# Land-cover families by hundreds: group, imperviousness, base coefficient.
FAMILIES = {1: ("artificial", 0.9, 0.80), 2: ("agriculture", 0.4, 0.45), 3: ("forest_and_seminatural", 0.15, 0.20), 4: ("wetland", 0.2, 0.30), 5: ("water", 1.0, 1.00)}


def family(land_cover: Column, what: int) -> Column:
    """Group (0), imperviousness (1) or base coefficient (2) of a class; null outside 100..599."""
    k = F.floor(land_cover / 100)
    out = F.when(F.lit(False), F.lit(FAMILIES[1][what]))
    for h, row in FAMILIES.items():
        out = out.when(k == h, F.lit(row[what]))
    return out


def runoff(rain: str = "rain", slope: str = "slope", land_cover: str = "land_cover") -> Column:
    """struct(value, status, reason) in mm from three evidence structs (value, status).

    The first check that fails decides: an input without a value, rain that isn't a number from 0, slope outside
    0..90, a class that isn't whole, or one outside the table. Synthetic inputs taint the result.
    """
    inputs = {"rainfall_mm": rain, "slope_deg": slope, "land_cover": land_cover}
    value = {n: F.col(f"{c}.value").cast("double") for n, c in inputs.items()}
    # a carrying status without a value is a missing one
    status = {n: F.when(v.isNull() & F.coalesce(F.col(f"{inputs[n]}.status").isin(*CARRYING), F.lit(True)), F.lit("missing")).otherwise(F.col(f"{inputs[n]}.status")) for n, v in value.items()}
    r, s, k = value.values()
    base = family(k, 2)
    none = r.isNull() | s.isNull() | k.isNull()
    gone = F.array_join(F.array_compact(F.array(*(F.when(v.isNull(), F.concat(F.lit(f"{n}="), status[n])) for n, v in value.items()))), "; ")
    fixture = F.lit(False)
    for x in status.values():
        fixture |= F.coalesce(x == "synthetic_fixture", F.lit(False))
    reason = (
        F.when(none, gone).when(F.isnan(r) | (r < 0) | (r == float("inf")), "rainfall is not a number from 0")
        .when(F.isnan(s) | (s < 0) | (s > 90), "slope is outside 0..90").when(F.isnan(k) | (k < 0) | (k != F.floor(k)), "land cover is not a whole code").when(base.isNull(), "land cover is outside the table")
    )
    amount = r * F.least(F.lit(1.0), base + F.least(s, F.lit(30.0)) / 30 * 0.1)
    carried = reason.isNull()
    failed = F.when(carried, F.when(fixture, "synthetic_fixture").otherwise("available")).when(none, F.coalesce(worst_of(list(status.values())), F.lit("invalid_response"))).otherwise("invalid_response")
    return F.struct(F.when(carried, amount).alias("value"), failed.alias("status"), reason.alias("reason"))


def runoff_risk(rain: Column, slope: Column, land_cover: Column) -> Column:
    """struct(score, level) of the legacy index; open water has none."""
    k = F.floor(land_cover / 100)
    imperv = F.when(k == 1, 0.9).when(k == 2, 0.4).when(k == 3, 0.15).when(k == 4, F.when(rain > 30, 0.8).otherwise(0.2)).otherwise(0.5)
    score = F.least(F.lit(1.0), F.least(rain / 50, F.lit(1.0)) * imperv * (0.5 + F.least(slope, F.lit(30.0)) / 30))
    level = F.when(score > 0.8, "EXTREME").when(score > 0.5, "HIGH").when(score > 0.2, "MODERATE").otherwise("LOW")
    return F.when(F.coalesce(k < 5, F.lit(True)), F.struct(score.alias("score"), level.alias("level")))


def cell_volumes(cells: DataFrame, runoff_mm: str = "runoff", area: str = "area_m2", fraction: str = "coverage_fraction") -> DataFrame:
    """Cells with volume_m3 and its status; a fraction outside (0, 1] or an area not above 0 is invalid."""
    ok = (F.col(fraction) > 0) & (F.col(fraction) <= 1) & (F.col(area) > 0)
    good = F.coalesce(ok, F.lit(False))
    carries = F.col(f"{runoff_mm}.value").isNotNull()
    volume = F.when(good, F.col(f"{runoff_mm}.value") / 1000 * F.col(area) * F.col(fraction))
    return cells.withColumns({"volume_m3": volume, "volume_status": F.when(carries & ~good, "invalid_response").otherwise(F.col(f"{runoff_mm}.status"))})


def catchment_totals(cells: DataFrame, catchments: DataFrame | None = None, key: str = "catchment_id", window: str | None = None) -> DataFrame:
    """Strict volume per catchment of cells with volume_m3 and volume_status; a catchment without cells is missing."""
    out = strict_sum(cells, [key], "volume_m3", "volume_status", window)
    if catchments is None:
        return out
    none = F.col("n_inputs").isNull()
    out = catchments.select(key).distinct().join(out, key, "left")
    return out.withColumns({"status": F.when(none, "missing").otherwise(F.col("status")), "reason": F.when(none, "no cells").otherwise(F.col("reason")), "n_inputs": F.coalesce("n_inputs", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0))})


def catchment_metadata(cells: DataFrame, key: str = "catchment_id", cell: str = "cell", status: str = "volume_status", resolution: str = "res") -> DataFrame:
    """Per catchment its cells' number, the statuses that occur, the resolutions, and whether a cell repeats."""
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"), F.array_sort(F.collect_set(status)).alias("statuses"), F.array_sort(F.collect_set(resolution)).alias("resolutions"), (F.count_distinct(cell) < F.count(F.lit(1))).alias("repeats"))


def allocation_check(parts: DataFrame, key: str, percent: str) -> DataFrame:
    """Whether a surface's percentages add up to 99..101."""
    out = parts.groupBy(key).agg(F.sum(percent).alias("total_percent"), F.count(F.lit(1)).alias("n_parts"))
    return out.withColumn("status", F.when(F.col("total_percent").between(99, 101), "available").otherwise("invalid_response"))
