"""Gates: rules over manifests and inputs as predicates, each broken rule one row; receipts and content addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"


def broken(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """Ident, rule for every rule whose predicate isn't true of a row (null counts as broken). One scan."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.col(ident), F.explode(found).alias("rule"))


def artifact_rules(path: str = "relative_path", size: str = "bytes", sha: str = "sha256") -> dict[str, Column]:
    """A portable relative path, a size from 0, and a hash."""
    p = F.col(path)
    return {"path_portable": p.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & ~p.rlike(r"(^|/)\.\.?(/|$)"), "bytes_valid": F.col(size) >= 0, "sha256_valid": F.col(sha).rlike(SHA256)}


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """Values that must be unique and aren't."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def leakage(datasets: DataFrame, cutoff, retrospective: bool = False) -> DataFrame:
    """Id, rule of datasets that would leak: references, context and post-event data are no input and no calibration;
    an input must be available by the cutoff, or, in a retrospective run, carry a note."""
    used = F.col("use_input") | F.col("use_calibration")
    late = F.col("available_at") > F.lit(cutoff).cast("timestamp")
    noted = F.trim(F.coalesce("methodology_note", F.lit(""))) != ""
    kept_out = F.col("role").isin("evaluation_reference", "comparison_reference", "context") | (F.col("temporal_relation") == "post_event")
    return broken(datasets, "id", {
        "reference_is_not_input": ~(kept_out & used), "availability_is_known": ~used | F.col("available_at").isNotNull(),
        "available_by_cutoff": ~used | ~F.coalesce(late, F.lit(False)) | (F.lit(retrospective) & noted),
    })


def whole_date(value: Column | str) -> Column:
    """Yyyymmdd as a number from the first eight digits of a whole number, given as one or as text; else null."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+", ""))
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8).cast("int"))


def before_cutoff(features: DataFrame, date: str, cutoff: int, geometry: str) -> DataFrame:
    """Features with `verdict`: missing_date, post_cutoff (from the cutoff, yyyymmdd, on), missing_geometry or
    eligible, the first that applies. Keep the eligible ones; verdict_counts() tells what went."""
    day = whole_date(date)
    verdict = F.when(day.isNull(), "missing_date").when(day >= cutoff, "post_cutoff").when(F.col(geometry).isNull(), "missing_geometry").otherwise("eligible")
    return features.withColumn("verdict", verdict)


def verdict_counts(features: DataFrame) -> DataFrame:
    """Verdict, n."""
    return features.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def grid_consistent(width: Column, height: Column, size: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """V03."""
    return (F.abs(x1 - x0 - width * size) < 1e-6) & (F.abs(y1 - y0 - height * size) < 1e-6)


def metric_consistent(tp: str, fp: str, fn: str, iou: str, precision: str, recall: str, tolerance: float = 1e-9) -> dict[str, Column]:
    """Published ratios follow from the counts; null exactly where the denominator is 0."""
    same = lambda v, a, b: F.when(b == 0, F.col(v).isNull()).otherwise(F.abs(F.col(v) - a / F.when(b != 0, b)) <= tolerance)
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return {"iou": same(iou, t, t + p + n), "precision": same(precision, t, t + p), "recall": same(recall, t, t + n)}


def series_accounted(readings: str, missing: str, expected: int = 288) -> Column:
    """V05."""
    return F.col(readings) + F.col(missing) == expected


def delivery_state(files_ok: Column, reviewed: Column, accepted: Column, inspected: Column) -> Column:
    """Where a delivered package stands; a later step without the earlier ones doesn't count."""
    return F.when(~F.coalesce(files_ok, F.lit(False)), "rejected").when(~F.coalesce(reviewed, F.lit(False)), "validated").when(~F.coalesce(accepted, F.lit(False)), "declined").when(~F.coalesce(inspected, F.lit(False)), "accepted").otherwise("inspected")


class MissingLayer(RuntimeError):
    pass


def require_layers(evidence: DataFrame, layers: list[str], carrying: tuple[str, ...] = ("available",)) -> DataFrame:
    """Evidence unchanged, or an error that names the required layers of which some cell has nothing."""
    bad = evidence.agg(*(F.count_if(~F.coalesce(F.col(f"{n}.status").isin(*carrying), F.lit(False))).alias(n) for n in layers)).first()
    gone = [n for n in layers if bad[n]]
    if gone:
        raise MissingLayer(", ".join(f"{n}: {bad[n]} cells" for n in gone))
    return evidence


def propagation_reasons(unknown_directions: Column, unavailable_sources: Column, divergent: Column, cyclic: Column) -> Column:
    """Why volumes can't be propagated; empty if they can."""
    return F.array_compact(F.array(F.when(unknown_directions > 0, "incomplete_direction"), F.when(unavailable_sources > 0, "incomplete_evidence"), F.when(divergent > 0, "unsupported_divergence"), F.when(cyclic, "cyclic")))


# The sizes that one request may have.
REQUEST_BOUNDS = {"features": 500, "coordinates": 10_000, "nodes": 100, "pipes": 200, "catchments": 50, "cells": 500}


def over_bounds(counts: dict[str, int]) -> list[str]:
    """What exceeds the bounds of one interactive request; batch jobs take it as a warning."""
    return [f"{k}: {n} > {REQUEST_BOUNDS[k]}" for k, n in counts.items() if n > REQUEST_BOUNDS.get(k, n)]


def content_address(*columns: Column) -> Column:
    """SHA-256 of the columns as canonical JSON: fields in name order, nulls kept."""
    own = sorted(columns, key=str)
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other doesn't have as often, by side. Empty: they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
