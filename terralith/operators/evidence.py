"""Evidence: a value with a status. Missing is never zero, and a total needs all of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses, and which failure wins where several inputs fail.
STATUSES = ("available", "missing", "stale", "out_of_coverage", "auth_required", "rate_limited", "upstream_error", "invalid_response", "incomplete_window", "synthetic_fixture")
CARRYING = ("available", "synthetic_fixture")
PRECEDENCE = ("auth_required", "rate_limited", "upstream_error", "invalid_response", "incomplete_window", "out_of_coverage", "stale", "missing")
PRECEDENCE_SPATIAL = ("invalid_response", "auth_required", "rate_limited", "upstream_error", "incomplete_window", "out_of_coverage", "stale", "missing")
PRECEDENCE_SLOPE = ("auth_required", "rate_limited", "upstream_error", "invalid_response", "incomplete_window", "stale", "out_of_coverage", "missing")
SUM_SCHEMA = "value double, status string, reason string, partial double, n_inputs long, n_missing long"


def rank_of(status: Column, precedence: tuple[str, ...] = PRECEDENCE) -> Column:
    """Place of a failure in the order; null for a status that carries a value."""
    pairs = [x for i, s in enumerate(precedence) for x in (F.lit(s), F.lit(i))]
    return F.when(~status.isin(*CARRYING), F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(len(precedence))))


def worst_of(statuses: list[Column], precedence: tuple[str, ...] = PRECEDENCE) -> Column:
    """P43 over the inputs of one row: the failure that comes first in the order; null if none failed."""
    failed = F.array_compact(F.array(*(rank_of(s, precedence) for s in statuses)))
    return F.when(F.size(failed) > 0, F.element_at(F.array(*map(F.lit, (*precedence, "invalid_response"))), F.coalesce(F.array_min(failed), F.lit(0)) + 1))


def available(value: Column, **fields: Column) -> Column:
    """An observed value; zero is one, null is a missing one."""
    return F.struct(value.alias("value"), F.when(value.isNull(), "missing").otherwise("available").alias("status"), F.when(value.isNull(), "no value").alias("reason"), *(v.alias(k) for k, v in fields.items()))


def unavailable(status: str, reason: str, kind: str = "double") -> Column:
    return F.struct(F.lit(None).cast(kind).alias("value"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def sampled(value: Column, low: float, high: float) -> Column:
    """A raster sample as evidence; what is not finite or out of range is an invalid response."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | (value < low) | (value > high)
    status = F.when(value.isNull(), "missing").when(bad, "invalid_response").otherwise("available")
    return F.struct(F.when(status == "available", value).alias("value"), status.alias("status"), F.when(status != "available", status).alias("reason"))


def violations(value: str = "value", status: str = "status", reason: str = "missing_reason", names: dict[str, str] | None = None) -> Column:
    """E1-E12 as array<string> of the rules a row breaks. names maps the struct's fields to columns that exist."""
    n = names or {}
    col = lambda k: F.col(n[k]) if k in n else None
    v, s, r = F.col(value), F.col(status), F.col(reason)
    carries = F.coalesce(s.isin(*CARRYING), F.lit(False))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    rules: dict[str, Column] = {
        "E1": ~F.coalesce(s.isin(*STATUSES), F.lit(False)), "E2": carries & v.isNull(), "E3": ~carries & v.isNotNull(),
        "E4": carries & r.isNotNull(), "E5": ~carries & blank(r),
    }
    if "provider" in n:
        rules["E6"] = blank(col("provider")) | blank(col("dataset"))
        rules["E12"] = (s == "synthetic_fixture") & ~(F.coalesce((col("provider") == "synthetic-fixture") & col("dataset").startswith("fixture:"), F.lit(False)))
    if "acquired_at" in n:
        rules["E7"] = F.try_to_timestamp(col("acquired_at")).isNull() | (("observed_at" in n) and (col("observed_at").isNotNull() & F.try_to_timestamp(col("observed_at")).isNull()))
    if "window_start" in n:
        a, b = col("window_start"), col("window_end")
        rules["E8"] = (a.isNull() != b.isNull()) | F.coalesce(a > b, F.lit(False))
    if "lat" in n:
        rules["E9"] = F.coalesce(~col("lat").between(-90, 90), F.lit(False)) | F.coalesce(~col("lon").between(-180, 180), F.lit(False))
    if "cell" in n:
        rules["E10"] = col("cell").isNotNull() & (F.trim(col("cell")) == "")
    if "source_quality" in n:
        rules["E11"] = F.coalesce(~col("source_quality").between(0, 1), F.lit(False))
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in sorted(rules.items(), key=lambda x: int(x[0][1:])))))


def strict_sum(df: DataFrame, keys: list[str], value: str, status: str, window: str | None = None, precedence: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """Per key, a total only if every input carries a value and all share one window; the sum of what is
    there is published apart, as `partial`. Synthetic inputs taint the total. Partial aggregation serves hot keys.

    Empty groups don't exist here; a left join gives them (see catchment_totals). Null values count as missing.
    """
    # in stages, so that long inputs are computed once
    rows = df.select(*keys, F.col(value).alias("__v"), F.col(status).alias("__s"), *([F.col(window).alias("__window")] if window else []))
    rows = rows.withColumn("__ok", F.coalesce(F.col("__v").isNotNull() & F.col("__s").isin(*CARRYING), F.lit(False)))
    ok = F.col("__ok")
    rank = F.when(~ok, F.coalesce(rank_of(F.col("__s"), precedence), F.lit(precedence.index("missing"))))
    spread = F.max(F.when(ok, F.col("__window"))).eqNullSafe(F.min(F.when(ok, F.col("__window")))) if window else F.lit(True)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_inputs"), F.count_if(~ok).alias("n_missing"), F.sum(F.when(ok, F.col("__v"))).alias("partial"),
        F.min(rank).alias("__worst"), F.bool_or(F.coalesce(F.col("__s") == "synthetic_fixture", F.lit(False))).alias("__fixture"), spread.alias("__one_window"),
    )
    names = F.array(*map(F.lit, (*precedence, "invalid_response")))
    status_out = F.when(F.col("n_missing") > 0, F.element_at(names, F.coalesce("__worst", F.lit(0)) + 1)).when(~F.col("__one_window"), "invalid_response").when(F.col("__fixture"), "synthetic_fixture").otherwise("available")
    whole = (F.col("n_missing") == 0) & F.col("__one_window")
    reason = F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing"), F.lit(" of "), F.col("n_inputs"), F.lit(" inputs unavailable"))).when(~F.col("__one_window"), "windows differ")
    return out.select(*keys, F.when(whole, F.col("partial")).alias("value"), status_out.alias("status"), reason.alias("reason"), "partial", "n_inputs", "n_missing")


def source_summary(df: DataFrame, keys: list[str], provider: str, dataset: str, status: str) -> DataFrame:
    """Distinct providers and datasets, and how often each status occurs."""
    return df.groupBy(*keys).agg(
        F.array_sort(F.collect_set(provider)).alias("providers"), F.array_sort(F.collect_set(dataset)).alias("datasets"),
        *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in STATUSES),
    )


def requested(cells: DataFrame, results: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Every requested cell with one evidence struct per layer, and one issue row per layer that isn't there.

    A layer's result that leaves a cell out is an invalid response. results: key, value, status, reason. Layers may cover
    far more than the cells asked for, so joins are by shuffle.
    """
    out = cells.select(key).distinct()
    for name, df in results.items():
        own = df.select(F.col(key), F.struct("value", "status", "reason").alias(name)).dropDuplicates([key])
        out = out.join(own.hint("merge"), key, "left").withColumn(name, F.coalesce(name, F.struct(F.lit(None).cast("double").alias("value"), F.lit("invalid_response").alias("status"), F.lit("omitted by provider").alias("reason"))))
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), F.col(f"{n}.status").alias("status"), F.col(f"{n}.reason").alias("reason")) for n in results))
    issues = out.select(key, F.explode(layers).alias("i")).select(key, "i.*").where(~F.col("status").isin(*CARRYING))
    return out, issues


def window_evidence(asked: DataFrame, windows: DataFrame, samples: DataFrame, key: str = "cell") -> DataFrame:
    """Evidence (value, status, reason) of every requested cell of a window. asked: window_id, key; windows:
    window_id, status, reason and more, which each cell's row carries as the struct `window`; samples: window_id, key,
    value, status, reason.

    A window that isn't available gives its own status to all of its cells, whatever was sampled; a cell of an available
    one that no sample names is an invalid response, as is one of a window that isn't known.
    """
    rest = [c for c in windows.columns if c != "window_id"]
    rows = asked.select("window_id", key).distinct().join(windows.select("window_id", F.struct(*rest).alias("window")), "window_id", "left")
    rows = rows.join(samples.select("window_id", key, F.struct("value", "status", "reason").alias("__s")), ["window_id", key], "left")
    up, gone = F.col("window.status") == "available", F.col("window").isNull()
    status = F.when(gone, "invalid_response").when(~up, F.col("window.status")).otherwise(F.coalesce("__s.status", F.lit("invalid_response")))
    reason = F.when(gone, "window is unknown").when(~up, F.col("window.reason")).when(F.col("__s").isNull(), "cell is absent from the samples").otherwise(F.col("__s.reason"))
    return rows.select("window_id", key, F.when(up & ~gone, F.col("__s.value")).alias("value"), status.alias("status"), reason.alias("reason"), "window")
