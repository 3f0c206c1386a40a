"""Time series with expected calendars: completeness, strict totals, rises, baselines and the best product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar(start, end, seconds: int) -> Column:
    """array<timestamp> of the slots that begin in [start, end)."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return F.transform(F.sequence(F.lit(0).cast("long"), F.ceil((F.unix_seconds(b) - F.unix_seconds(a)) / seconds) - 1), lambda i: F.timestamp_seconds(F.unix_seconds(a) + i * seconds))


def expected_slots(keys: DataFrame, start, end, seconds: int) -> DataFrame:
    """Keys times the calendar; the calendar is made in each row, nothing is joined."""
    return keys.distinct().select("*", F.explode(calendar(start, end, seconds)).alias("ts"))


def missing_slots(obs: DataFrame, keys: list[str], start, end, seconds: int) -> DataFrame:
    """The slots that a key's observations leave out."""
    return expected_slots(obs.select(*keys), start, end, seconds).join(obs.select(*keys, "ts").distinct(), [*keys, "ts"], "left_anti")


def strict_accumulation(obs: DataFrame, keys: list[str], amount: str, start, end, seconds: int) -> DataFrame:
    """Per key a total over [start, end) only if every slot is there once with a value; else
    incomplete_window, or invalid_response where a slot repeats or a time isn't a slot's. The partial sum stands apart."""
    n = int((_epoch(end) - _epoch(start)) // seconds)
    on_slot = F.pmod(F.unix_seconds("ts") - _epoch(start), F.lit(seconds)) == 0
    rows = obs.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    v = F.when(~F.isnan(amount), F.col(amount))
    by_slot = rows.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("c"), F.sum(v).alias("v"), F.count(v).alias("ok"), F.bool_and(on_slot).alias("on"))
    out = by_slot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slots"), F.sum("v").alias("partial"), F.count_if(F.col("ok") >= 1).alias("n_values"), F.bool_or((F.col("c") > 1) | ~F.col("on")).alias("odd"))
    status = F.when(F.col("odd"), "invalid_response").when((F.col("n_slots") == n) & (F.col("n_values") == n), "available").otherwise("incomplete_window")
    return out.select(*keys, F.when(status == "available", F.col("partial")).alias("total"), status.alias("status"), "partial", "n_values", F.lit(n).alias("n_expected"))


def _epoch(t) -> int:
    from datetime import UTC, datetime

    t = datetime.fromisoformat(str(t).replace("Z", "+00:00"))
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def peak(obs: DataFrame, keys: list[str], value: str, line: str) -> DataFrame:
    """The greatest value with the time of its earliest line."""
    return obs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("peak"), F.max_by("ts", F.struct(F.col(value), -F.col(line))).alias("peak_ts"))


def largest_rise(obs: DataFrame, keys: list[str], value: str, seconds: int = 3600, step: int = 900) -> DataFrame:
    """The greatest value(t) - value(t - seconds) among the t for which every step in between is there."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    rows = obs.where(F.col(value).isNotNull()).withColumns({"__n": F.count(F.lit(1)).over(w), "__first": F.first(value).over(w), "__span": F.unix_seconds("ts") - F.min(F.unix_seconds("ts")).over(w)})
    whole = (F.col("__n") == seconds // step + 1) & (F.col("__span") == seconds)
    return rows.groupBy(*keys).agg(F.max(F.when(whole, F.col(value) - F.col("__first"))).alias("largest_rise"), F.count_if(whole).alias("n_windows"))


def above_baseline(obs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """With excess = max(value - first value, 0) and the baseline; the first value by one aggregation, not a sort."""
    first = obs.groupBy(*keys).agg(F.min_by(value, "ts").alias("baseline"))
    return obs.join(first, keys).withColumn("excess", F.when(F.col(value).isNotNull() & F.col("baseline").isNotNull(), F.greatest(F.col(value) - F.col("baseline"), F.lit(0.0))))


def best_product(obs: DataFrame, keys: list[str], product: str, order: tuple[str, ...] = ("final", "late", "early")) -> DataFrame:
    """Per key the product with most distinct times, of equals the first in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(product))
    per = obs.where(rank > 0).groupBy(*keys, product).agg(F.count_distinct("ts").alias("n_slots"))
    return per.groupBy(*keys).agg(F.max_by(product, F.struct("n_slots", -rank)).alias("product"), F.max("n_slots").alias("n_slots"))


def best_per_slot(obs: DataFrame, keys: list[str], product: str, order: tuple[str, ...] = ("final", "late", "early")) -> DataFrame:
    """Of each slot the observation of the best product."""
    rest = [c for c in obs.columns if c not in (*keys, "ts")]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(product))
    return obs.where(rank > 0).groupBy(*keys, "ts").agg(F.min_by(F.struct(*rest), F.struct(rank, *(c for c in rest))).alias("p")).select(*keys, "ts", "p.*")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the order, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("p")).select(*keys, "p.*")


def ranked_with_ties(rows: DataFrame, keys: list[str], dates: list[str], ident: str) -> DataFrame:
    """Rank by dates descending, then id; rows whose dates equal those of another are ambiguous."""
    w = Window.partitionBy(*keys)
    order = [F.desc(d) for d in dates]
    return rows.withColumns({"rank": F.row_number().over(w.orderBy(*order, ident)), "ambiguous": F.count(F.lit(1)).over(Window.partitionBy(*keys, *dates)) > 1})


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The later rows of an id that repeats, each as one issue."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("n", n).where("n > 1")


def gauge_comparison(gauge: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Strict totals of both sides beside each other; a difference only where both are complete."""
    a = gauge.select(*keys, F.col("total").alias("gauge_total"), F.col("status").alias("gauge_status"))
    b = grid.select(*keys, F.col("total").alias("grid_total"), F.col("status").alias("grid_status"))
    out = a.join(b, keys, "full_outer")
    return out.withColumns({"difference": F.col("grid_total") - F.col("gauge_total"), "comparable": F.col("grid_total").isNotNull() & F.col("gauge_total").isNotNull()})
