"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each row of a source is repeated k times, k drawn from a Poisson distribution whose mean is the source's target
rows over its rows. The draw inverts the distribution at a uniform number hashed from the seed and the row's id,
so any lost task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written

#: Beyond so many sources, or terms of all their tables (8 bytes each), rates are joined by shuffle, not broadcast.
BROADCAST_SOURCES, BROADCAST_TERMS = 5_000, 2_500_000
#: Up to this mean the distribution is summed from exp(-mean), which must stay a normal number; above, from 12
#: deviations and 20 terms below the mean, where less than 10**-20 is left out, and divided by the sum.
LARGEST_START = 700.0


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of md5; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str) -> DataFrame:
    """mix_source, n_rows, rate, whole, cdf: one row per source (null is a source of its own). cdf[i] is the probability
    of at most whole + i copies.

    weights: a source's share, relative to the others; sources that are not named get 0. None: equal shares.
    total: target rows in all; None: as many as the input has.
    """
    counted = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = written(counted, "source_counts")  # the rows are counted once
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    counted = counted.select("*", weight.alias("w"))
    sums = counted.agg(F.sum("w").alias("w"), F.sum("n_rows").alias("n")).first()
    sum_w, wanted = float(sums.w or 0.0), float(total if total is not None else sums.n or 0)
    rate = F.col("w") / F.lit(sum_w) * F.lit(wanted) / F.col("n_rows") if sum_w > 0 else F.lit(0.0)
    rates = counted.select("mix_source", "n_rows", rate.alias("rate"))
    far = 12 * F.sqrt("rate") + 20
    whole = F.when(F.col("rate") > LARGEST_START, F.floor(F.col("rate") - far)).otherwise(F.lit(0)).cast("int")
    rates = rates.withColumn("whole", whole)
    p0 = F.when(F.col("whole") > 0, F.lit(1.0)).otherwise(F.exp(-F.col("rate")))
    start = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))
    # p(k) = p(k - 1) * mean / k; the running sum is the distribution
    grown = F.aggregate(
        F.sequence(F.col("whole") + 1, F.ceil(F.col("rate") + far).cast("int")),
        start,
        lambda acc, k: F.struct((acc["p"] * F.col("rate") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("rate") / k)).alias("cdf")),
    )
    rates = rates.select("mix_source", "n_rows", "rate", "whole", grown["cdf"].alias("cdf"))
    most = F.element_at("cdf", -1)
    return rates.withColumn("cdf", F.when(F.col("whole") > 0, F.transform("cdf", lambda c: c / most)).otherwise(F.col("cdf")))


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", shuffle: bool = True
) -> DataFrame:
    """docs' columns, each row repeated as drawn, with mix_copy (0, 1, ...), in a global random order.

    A null source is a source of its own; a null id draws as the text "null" does. Rows of one id are drawn alike. An empty table gives no
    rows. Input columns that are named as an internal one (mix_source, mix_copy, ...) are kept under their name,
    except mix_copy, which is replaced. The largest source may hold any share of the rows: rates are counted with
    partial aggregation, and the rows themselves are dealt out only by their random order.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_copy")
    names = docs.columns
    rates = source_rates(docs, weights, total, source).select(*(F.col(c).alias(f"__mix_{c}") for c in ("mix_source", "whole", "cdf")))
    rates = written(rates, "rates")
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__mix_cdf")).alias("terms")).first()
    few = size.n <= BROADCAST_SOURCES and (size.terms or 0) <= BROADCAST_TERMS
    joined = docs.join(F.broadcast(rates) if few else rates, F.col(source).eqNullSafe(F.col("__mix_mix_source")))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    u = uniform(key, seed)
    copies = F.col("__mix_whole") + F.size(F.filter("__mix_cdf", lambda c: c <= u))
    out = joined.select(*(F.col(c) for c in names), copies.alias("__mix_n")).where("__mix_n > 0")
    out = out.select(*(F.col(c) for c in names), F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)).alias("mix_copy"))
    if not shuffle:
        return out
    order = F.xxhash64(F.lit(seed), key, "mix_copy")
    # by the hash of a random number, then by the number inside: no sampling pass as for ranges
    return out.withColumn("__mix_order", order).repartition(shuffle_width(spark), "__mix_order").sortWithinPartitions("__mix_order").drop("__mix_order")
