"""The driver's tables seen as the library's abstractions, and the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LAND_COVER_CODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(ts: str | Column) -> Column:
    """A time as text, the same in every session time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def points(spark: SparkSession, d: str) -> DataFrame:
    """events as cube points."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), F.lit("EV").alias("layer"), F.col("event_type").alias("variable"),
        F.col("value").alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.col("event_id").alias("ingest_seq"),
    )


def _null(every: int, c: Column) -> Column:
    return F.when(F.col("p_partkey") % every != 0, c)


def hazard_cells(spark: SparkSession, d: str) -> DataFrame:
    """part as wide cells, some fields missing."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("cell"), _null(7, F.col("p_size") * 1.7).alias("slope"), _null(11, (k % 5 + 1).cast("double")).alias("elsus_class"), _null(13, (k % 97) / F.lit(120.0)).alias("hazard_pga"),
        _null(17, F.element_at(F.array(*map(F.lit, LAND_COVER_CODES)), (k % 44 + 1).cast("int"))).alias("clc_class"), F.when(k % 3 == 0, "rock").alias("lithology"),
        _null(5, (k % 130).cast("double")).alias("rain24h"), _null(6, (k % 300).cast("double")).alias("rain72h"),
    )


HAZARD_SQL = f"""cells AS (
  SELECT p_partkey AS cell, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1.7e0 END AS slope, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 5 + 1)::DOUBLE END AS elsus_class,
    CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 97) / 120e0 END AS hazard_pga, CASE WHEN p_partkey % 17 <> 0 THEN ([{", ".join(map(str, LAND_COVER_CODES))}])[p_partkey % 44 + 1] END AS clc_class,
    CASE WHEN p_partkey % 3 = 0 THEN 'rock' END AS lithology, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 130)::DOUBLE END AS rain24h,
    CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 300)::DOUBLE END AS rain72h
  FROM part)"""


def catchment_cells(spark: SparkSession, d: str) -> DataFrame:
    """orders as catchments, lineitem as their cells, with evidence structs."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    ev = lambda v, s: F.struct(v.cast("double").alias("value"), s.alias("status"))
    ok = F.lit("available")
    gone = (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 9 == 0)
    rain = ev(F.when(~gone, F.col("l_quantity")), F.when(gone, F.when(F.col("l_suppkey") % 2 == 0, "rate_limited").otherwise("stale")).otherwise(F.when(F.col("l_partkey") % 101 == 0, "synthetic_fixture").otherwise(ok)))
    return li.select(
        F.col("l_orderkey").alias("catchment_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), n.alias("line"), rain.alias("rain"), ev(F.col("l_discount") * 300, ok).alias("slope"), ev(100 * (1 + n % 5) + 11, ok).alias("land_cover"),
        F.col("l_extendedprice").alias("area_m2"), F.lit(1.0).alias("coverage_fraction"),
    )


CATCHMENT_SQL = """raw AS (
  SELECT l_orderkey AS catchment_id, l_returnflag = 'R' AND l_partkey % 9 = 0 AS gone, CASE WHEN l_suppkey % 2 = 0 THEN 'rate_limited' ELSE 'stale' END AS why, l_partkey % 101 = 0 AS fixture,
    l_quantity AS rain, l_discount * 300e0 AS slope, CASE l_linenumber % 5 WHEN 0 THEN 0.80e0 WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.20e0 WHEN 3 THEN 0.30e0 ELSE 1.00e0 END AS base, l_extendedprice AS area
  FROM lineitem),
cells AS (
  SELECT *, CASE WHEN NOT gone THEN rain * least(1e0, base + least(slope, 30e0) / 30e0 * 0.1e0) END AS runoff, CASE WHEN gone THEN why WHEN fixture THEN 'synthetic_fixture' ELSE 'available' END AS status FROM raw)"""


def part_grid(spark: SparkSession, d: str, width: int = 50) -> DataFrame:
    """part as a grid of 50 columns."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("idx"), F.floor(k / width).alias("row"), (k % width).alias("col"), F.lit(True).alias("inside"),
        F.when(k % 83 != 0, F.round(F.col("p_retailprice") + F.col("p_size") * 7.25, 2)).alias("elevation"), (F.col("p_size") == 50).alias("water"), F.col("p_size").alias("size"),
    )


GRID_SQL = """grid AS (
  SELECT p_partkey AS idx, p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 83 <> 0 THEN round(p_retailprice + p_size * 7.25e0, 2) END AS elevation,
    p_size = 50 AS water, p_size AS size FROM part)"""


def pipes_and_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """customer -> nation -> region as pipes; levels from balances and keys."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    level = F.when(F.col("c_custkey") % 37 != 0, F.lit(100.0) + F.round(F.col("c_acctbal") / 1000, 2))
    nodes = c.select(name("c", "c_custkey").alias("node_id"), F.lit("inlet").alias("type"), level.alias("level"))
    nodes = nodes.unionByName(n.select(name("n", "n_nationkey").alias("node_id"), F.lit("manhole").alias("type"), (F.lit(100.0) - F.col("n_nationkey") / 100).alias("level")))
    nodes = nodes.unionByName(r.select(name("r", "r_regionkey").alias("node_id"), F.lit("outfall").alias("type"), (F.lit(50.0) - F.col("r_regionkey")).alias("level")))
    pipes = c.select(name("p", "c_custkey").alias("pipe_id"), name("c", "c_custkey").alias("node_a"), name("n", "c_nationkey").alias("node_b"), (F.col("c_custkey") % 90 + 10).cast("double").alias("length_m"))
    pipes = pipes.unionByName(n.select(name("q", "n_nationkey").alias("pipe_id"), name("n", "n_nationkey").alias("node_a"), name("r", "n_regionkey").alias("node_b"), F.lit(500.0).alias("length_m")))
    return pipes, nodes


NETWORK_SQL = """nodes AS (
  SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 37 <> 0 THEN 100e0 + round(c_acctbal / 1000, 2) END AS level FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 100e0 - n_nationkey / 100e0 FROM nation UNION ALL SELECT 'r' || r_regionkey, 50e0 - r_regionkey FROM region),
pipes AS (
  SELECT 'p' || c_custkey AS pipe_id, 'c' || c_custkey AS node_a, 'n' || c_nationkey AS node_b, (c_custkey % 90 + 10)::DOUBLE AS length_m FROM customer
  UNION ALL SELECT 'q' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 500e0 FROM nation)"""


def rectangles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """supplier as source rectangles, a coarse lattice of customers as targets."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    k = F.col("s_suppkey")
    x, y, w = (k * 37 % 200).cast("double"), (k * 53 % 200 + F.floor(k / 400) * 200).cast("double"), 3 + F.abs(F.col("s_acctbal")) % 17
    sources = s.select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + F.round(w, 3)).alias("x1"), (y + 8).alias("y1"), F.when(k % 10 != 0, F.col("s_acctbal")).alias("value"), (k % 4).alias("category"))
    t = F.col("c_custkey")
    targets = c.select(t.alias("id"), (t % 20 * 10).cast("double").alias("x0"), (F.floor(t / 20) * 10).cast("double").alias("y0"), (t % 20 * 10 + 10).cast("double").alias("x1"), (F.floor(t / 20) * 10 + 10).cast("double").alias("y1"))
    return targets, sources


RECTANGLES_SQL = """src AS (
  SELECT s_suppkey AS source, (s_suppkey * 37 % 200)::DOUBLE AS x0, (s_suppkey * 53 % 200 + s_suppkey // 400 * 200)::DOUBLE AS y0, (s_suppkey * 37 % 200)::DOUBLE + round(3 + abs(s_acctbal) % 17, 3) AS x1,
    (s_suppkey * 53 % 200 + s_suppkey // 400 * 200)::DOUBLE + 8 AS y1, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS value, s_suppkey % 4 AS category FROM supplier),
tgt AS (
  SELECT c_custkey AS target, (c_custkey % 20 * 10)::DOUBLE AS x0, (c_custkey // 20 * 10)::DOUBLE AS y0, (c_custkey % 20 * 10 + 10)::DOUBLE AS x1, (c_custkey // 20 * 10 + 10)::DOUBLE AS y1
  FROM customer),
pairs AS (
  SELECT target, source, value, category, (least(t.x1, s.x1) - greatest(t.x0, s.x0)) * (least(t.y1, s.y1) - greatest(t.y0, s.y0)) AS area
  FROM tgt t JOIN src s ON least(t.x1, s.x1) > greatest(t.x0, s.x0) AND least(t.y1, s.y1) > greatest(t.y0, s.y0))"""
