"""Registered queries: cube, evidence, hazards, runoff and scalar expressions over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cube, evidence, risk, runoff
from .adapters import CATCHMENT_SQL, HAZARD_SQL, catchment_cells, hazard_cells, points, r6, shown, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Cube -------------------------------------------------------------------------------------

_LAST = "SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events"


@query(f"SELECT user_id::VARCHAR AS cell, event_type AS variable, event_id AS ingest_seq, value FROM ({_LAST}) WHERE rn = 1")
def w01_snapshot_latest(spark, d):
    return cube.latest(points(spark, d)).select("cell", "variable", "ingest_seq", F.col("value_num").alias("value"))


@query(f"SELECT user_id::VARCHAR AS cell, event_type AS variable, value FROM ({_LAST}) WHERE rn = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def w01_latest_within_tolerance(spark, d):
    return cube.latest(points(spark, d), tolerance_s=2 * 86400).select("cell", "variable", F.col("value_num").alias("value"))


@query("SELECT event_id AS ingest_seq, value FROM events WHERE user_id IN (3, 5, 8) AND event_type IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def p01_p02_cube_filter(spark, d):
    return cube.matching(points(spark, d), ["3", "5", "8"], [], ["view", "click"], "2024-01-05", "2024-01-20").select("ingest_seq", F.col("value_num").alias("value"))


@query("""
SELECT user_id::VARCHAR AS cell, event_type AS variable, event_id AS ingest_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), ts) AS rn
  FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) <= 43200000000) WHERE rn = 1""")
def p03_snapshot_near_time(spark, d):
    return cube.at_time(points(spark, d), "2024-01-15", 43200).select("cell", "variable", "ingest_seq")


@query("""
SELECT user_id::VARCHAR AS cell, event_type AS variable, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev,
  list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY ALL""")
def a02_series_stats(spark, d):
    return cube.series_stats(points(spark, d)).select("cell", "variable", "n", "min", "max", r6("mean").alias("mean"), r6("stddev").alias("stddev"), "median")


@query("SELECT count(*) AS n_points, count(DISTINCT user_id) AS n_cells, count(DISTINCT event_type) AS n_variables, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events")
def a03_cube_metadata(spark, d):
    return cube.cube_metadata(points(spark, d)).select("n_points", "n_cells", F.size("variables").cast("long").alias("n_variables"), shown("first_ts").alias("first_ts"), shown("last_ts").alias("last_ts"))


@query("""
SELECT user_id::VARCHAR AS cell, concat_ws(',', CASE WHEN count(*) FILTER (WHERE event_type = 'click') = 0 THEN 'EV:click' END, CASE WHEN count(*) FILTER (WHERE event_type = 'refund') = 0 THEN 'EV:refund' END,
  CASE WHEN count(*) FILTER (WHERE event_type = 'signup') = 0 THEN 'EV:signup' END) AS missing FROM events GROUP BY user_id""")
def a04_missing_variables(spark, d):
    return cube.missing_variables(points(spark, d), ["EV:click", "EV:signup", "EV:refund"]).select("cell", F.array_join("missing", ",").alias("missing"))


@query("""
WITH k AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id, event_type) AS m FROM events)
SELECT user_id::VARCHAR AS cell, event_type AS variable, event_id AS ingest_seq FROM k
WHERE m <= 4 OR k IN (SELECT floor(i * (m / 4e0))::BIGINT FROM range(0, 4) t(i))""")
def w03_downsample(spark, d):
    return cube.downsample(points(spark, d), 4).select("cell", "variable", "ingest_seq")


_FIELDS = {"EV:view": "slope", "EV:click": "elsus_class", "EV:purchase": "rain24h", "EV:error": "hazard_pga"}


@query(f"""
WITH last AS (SELECT * FROM ({_LAST}) WHERE rn = 1)
SELECT c.c_custkey::VARCHAR AS cell, max(value) FILTER (WHERE event_type = 'view') AS slope, max(value) FILTER (WHERE event_type = 'click') AS elsus_class,
  max(value) FILTER (WHERE event_type = 'purchase') AS rain24h, max(value) FILTER (WHERE event_type = 'error') AS hazard_pga, max(value) FILTER (WHERE event_type = 'signup') AS other
FROM customer c LEFT JOIN last ON last.user_id = c.c_custkey GROUP BY c.c_custkey""")
def x01_cell_features(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cell"))
    wide = cube.features(cube.latest(points(spark, d)), _FIELDS, cells)
    return wide.select("cell", *_FIELDS.values(), F.try_element_at("extra", F.lit("EV:signup")).cast("double").alias("other"))


@query(f"""
WITH last AS (SELECT * FROM ({_LAST}) WHERE rn = 1),
f AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS slope, max(value) FILTER (WHERE event_type = 'click') AS klass FROM last GROUP BY user_id),
m AS (SELECT user_id, least(1e0, greatest(0e0,
    0.6e0 * CASE WHEN slope IS NULL THEN 0.5e0 WHEN slope <= 0 THEN 0e0 WHEN slope <= 45 THEN slope / 45 ELSE 1 + 0.3e0 * least(slope - 45, 25e0) / 25 END
    + 0.4e0 * CASE WHEN klass IS NOT NULL THEN least(1e0, greatest(0e0, (klass - 1) / 4)) WHEN slope IS NULL THEN 0.5e0 WHEN slope < 10 THEN 0.1e0 WHEN slope < 20 THEN 0.3e0 WHEN slope < 30 THEN 0.5e0 WHEN slope < 40 THEN 0.7e0 ELSE 0.85e0 END)) AS mean FROM f)
SELECT user_id::VARCHAR AS cell, round(mean, 6) AS score FROM m ORDER BY mean DESC, user_id::VARCHAR LIMIT 50""")
def m1_top_cells(spark, d):
    """Flagship: latest snapshot -> features -> landslide score -> the 50 highest (a top-k report)."""
    wide = cube.features(cube.latest(points(spark, d)), _FIELDS)
    scored = wide.select("cell", risk.landslide()["mean"].alias("mean"))
    return scored.orderBy(F.desc("mean"), "cell").limit(50).select("cell", r6("mean").alias("score"))


@query("""
SELECT user_id::VARCHAR AS cell, event_type AS variable, sum(CASE WHEN event_id % 10 = 0 THEN 0e0 ELSE value END)::DECIMAL(20, 4)::DOUBLE AS total, count(*) AS n FROM events GROUP BY ALL""")
def s04_upsert(spark, d):
    old = points(spark, d)
    new = old.where("ingest_seq % 10 = 0").withColumns({"value_num": F.lit(0.0), "ingest_seq": F.col("ingest_seq") + 1_000_000_000})
    return cube.upsert(old, new).groupBy("cell", "variable").agg(F.sum(F.col("value_num").cast("decimal(20,4)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE NOT gone) AS n_kept, count(*) FILTER (WHERE gone) AS n_deleted FROM (SELECT event_type IN ('error') AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AS gone FROM events)")
def s05_delete(spark, d):
    stay, go = cube.delete(points(spark, d), variables=["error"], start="2024-01-10", end="2024-01-20")
    both = stay.select(F.lit(0).alias("g")).unionByName(go.select(F.lit(1).alias("g")))
    return both.agg(F.count_if(F.col("g") == 0).alias("n_kept"), F.count_if(F.col("g") == 1).alias("n_deleted"))


@query("""
SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def j21_as_of(spark, d):
    """The last view at or before each purchase."""
    p = points(spark, d)
    asked = p.where("variable = 'purchase'").select("cell", "layer", F.lit("view").alias("variable"), F.col("ts").alias("at"), "ingest_seq")
    found = cube.as_of(p.where("variable = 'view'"), asked).distinct()
    return asked.join(found, ["cell", "layer", "variable", "at"]).select(F.col("ingest_seq").alias("event_id"), F.col("value_num").alias("last_view"))


@query("""
SELECT coalesce(o.k, c.k, e.k) AS cell, o.spent, c.balance, e.n_events
FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) o
FULL JOIN (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0) c ON o.k = c.k
FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) e ON coalesce(o.k, c.k) = e.k""")
def j01_layers_full_outer(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("balance"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("n_events"))
    return o.join(c, "cell", "full_outer").join(e, "cell", "full_outer")


@query("SELECT c_custkey AS cell, EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey) AS hit FROM customer")
def j04_cache_split(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    kept = table(spark, d, "events").select(F.col("user_id").alias("cell"))
    return asked.join(kept, "cell", "left_semi").withColumn("hit", F.lit(True)).unionByName(asked.join(kept, "cell", "left_anti").withColumn("hit", F.lit(False)))


@query("SELECT user_id AS cell, event_type AS variable, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value * value), 6) AS mean_square FROM events GROUP BY ALL")
def a01_cell_means(spark, d):
    return points(spark, d).groupBy(F.col("cell").cast("long").alias("cell"), "variable").agg(F.count("value_num").alias("n"), r6(F.avg("value_num")).alias("mean"), r6(F.avg(F.col("value_num") * F.col("value_num"))).alias("mean_square"))


# Hazards ----------------------------------------------------------------------------------

_CLAMP = "least(1e0, greatest(0e0, {}))"
_LANDSLIDE = _CLAMP.format("""0.6e0 * CASE WHEN slope IS NULL THEN 0.5e0 WHEN slope <= 0 THEN 0e0 WHEN slope <= 45 THEN slope / 45 ELSE 1 + 0.3e0 * least(slope - 45, 25e0) / 25 END
  + 0.4e0 * CASE WHEN elsus_class IS NOT NULL THEN least(1e0, greatest(0e0, (elsus_class - 1) / 4)) WHEN slope IS NULL THEN 0.5e0 WHEN slope < 10 THEN 0.1e0 WHEN slope < 20 THEN 0.3e0 WHEN slope < 30 THEN 0.5e0 WHEN slope < 40 THEN 0.7e0 ELSE 0.85e0 END""")
_SEISMIC = """CASE WHEN hazard_pga IS NULL THEN 0.1e0 ELSE least(1e0, pow(least(1e0, hazard_pga * CASE WHEN lithology IS NOT NULL OR clc_class IS NULL THEN 1e0
  WHEN clc_class IN (411,412,421,422,423,511,512,521,522,523) THEN 1.8e0 WHEN clc_class IN (111,112,121,122,123,124,131,132,133,141,142) THEN 1.3e0 ELSE 1e0 END / 0.5e0), 0.8e0)) END"""
_WATER = _CLAMP.format("""CASE WHEN slope IS NULL THEN 0.5e0 ELSE least(1e0, greatest(0e0, slope / 20)) END + CASE WHEN clc_class BETWEEN 311 AND 313 THEN -0.15e0 WHEN clc_class BETWEEN 321 AND 324 THEN -0.05e0
  WHEN clc_class BETWEEN 111 AND 142 THEN 0.2e0 WHEN clc_class BETWEEN 411 AND 423 THEN -0.3e0 WHEN clc_class BETWEEN 511 AND 523 THEN -0.4e0 ELSE 0e0 END""")
_MINERAL = "CASE WHEN clc_class = 131 THEN 0.9e0 ELSE 0.1e0 END"


@query(f"""WITH {HAZARD_SQL}
SELECT cell, round({_LANDSLIDE}, 6) AS mean, 0.05e0 * (1 + 0.5e0 * ((slope IS NULL)::INT + (elsus_class IS NULL)::INT)) AS variance,
  round(greatest(0.3e0, ((slope IS NOT NULL)::INT + (elsus_class IS NOT NULL)::INT) / 2e0) * CASE WHEN elsus_class IS NULL AND slope IS NOT NULL THEN 0.8e0 ELSE 1e0 END, 6) AS confidence FROM cells""")
def p19_landslide(spark, d):
    m = hazard_cells(spark, d).select("cell", risk.landslide().alias("m"))
    return m.select("cell", r6("m.mean").alias("mean"), "m.variance", r6("m.confidence").alias("confidence"))


@query(f"""WITH {HAZARD_SQL}
SELECT cell, round({_SEISMIC}, 6) AS mean, 0.15e0 * (1 + 0.5e0 * ((hazard_pga IS NULL)::INT + (lithology IS NULL)::INT)) AS variance,
  CASE WHEN hazard_pga IS NULL THEN NULL WHEN hazard_pga < 0.1e0 THEN 'low' WHEN hazard_pga < 0.3e0 THEN 'moderate' WHEN hazard_pga < 0.5e0 THEN 'high' ELSE 'very_high' END AS pga_class FROM cells""")
def p20_seismic(spark, d):
    m = hazard_cells(spark, d).select("cell", risk.seismic().alias("m"), risk.pga_class().alias("pga_class"))
    return m.select("cell", r6("m.mean").alias("mean"), "m.variance", "pga_class")


@query(f"WITH {HAZARD_SQL} SELECT cell, round({_WATER}, 6) AS mean, 0.12e0 * (1 + 0.5e0 * ((slope IS NULL)::INT + (clc_class IS NULL)::INT)) AS variance FROM cells")
def p22_water_proxy(spark, d):
    m = hazard_cells(spark, d).select("cell", risk.water_proxy().alias("m"))
    return m.select("cell", r6("m.mean").alias("mean"), "m.variance")


@query(f"""WITH {HAZARD_SQL}, f AS (
  SELECT *, coalesce(rain72h, 3 * rain24h) AS r72, CASE WHEN clc_class BETWEEN 100 AND 199 THEN 5e0 WHEN clc_class BETWEEN 200 AND 299 THEN 15e0 WHEN clc_class BETWEEN 311 AND 313 THEN 50e0
    WHEN clc_class BETWEEN 321 AND 324 THEN 30e0 WHEN clc_class BETWEEN 331 AND 335 THEN 10e0 WHEN clc_class BETWEEN 400 AND 499 THEN 80e0 WHEN clc_class BETWEEN 500 AND 599 THEN 1000e0 ELSE 15e0 END AS inf FROM cells)
SELECT cell, round(CASE WHEN rain24h IS NULL THEN {_WATER} ELSE least(1e0, greatest(0e0, 0.6e0 * least(1e0, rain24h / (24 * inf)) + 0.4e0 * least(1e0, r72 / (72 * inf))
  + CASE WHEN rain24h > 100 THEN 0.2e0 WHEN rain24h > 60 THEN 0.1e0 ELSE 0e0 END)) END, 6) AS mean FROM f""")
def p23_water_production(spark, d):
    return hazard_cells(spark, d).select("cell", r6(risk.water_production()["mean"]).alias("mean"))


@query(f"WITH {HAZARD_SQL} SELECT cell, round({_LANDSLIDE}, 6) AS landslide, round({_SEISMIC}, 6) AS seismic, round({_WATER}, 6) AS water, {_MINERAL} AS mineral, round((({_LANDSLIDE}) + ({_SEISMIC}) + ({_WATER}) + ({_MINERAL})) / 4, 6) AS score FROM cells")
def p25_all_risks(spark, d):
    out = risk.all_risks(hazard_cells(spark, d))
    return out.select("cell", *(r6(f"{m}.mean").alias(m) for m in ("landslide", "seismic", "water", "mineral")), r6("score").alias("score"))


@query(f"""WITH {HAZARD_SQL}, m AS (SELECT cell, {_LANDSLIDE} AS m FROM cells),
t AS (SELECT cell, CASE WHEN m < 0.33e0 THEN 0.7e0 + (0.33e0 - m) / 2 WHEN m < 0.67e0 THEN 0.15e0 + 0.4e0 * (0.5e0 - m) ELSE 0.05e0 END AS l,
  CASE WHEN m < 0.33e0 THEN 0.25e0 - 0.3e0 * (0.33e0 - m) WHEN m < 0.67e0 THEN 0.7e0 - 0.6e0 * abs(m - 0.5e0) ELSE 0.25e0 - 0.3e0 * (m - 0.67e0) END AS d,
  CASE WHEN m < 0.33e0 THEN 0.05e0 WHEN m < 0.67e0 THEN 0.15e0 + 0.4e0 * (m - 0.5e0) ELSE 0.7e0 + 0.5e0 * (m - 0.67e0) END AS h FROM m)
SELECT cell, round(l / (l + d + h), 6) AS low, round(d / (l + d + h), 6) AS medium, round(h / (l + d + h), 6) AS high FROM t""")
def p16_three_classes(spark, d):
    c = hazard_cells(spark, d).select("cell", S.three_classes(risk.landslide()["mean"]).alias("c"))
    return c.select("cell", *(r6(f"c.{n}").alias(n) for n in ("low", "medium", "high")))


# Runoff and strict sums ---------------------------------------------------------------------


@query(f"WITH {CATCHMENT_SQL} SELECT status, count(*) AS n, round(sum(runoff), 4) AS total_runoff FROM cells GROUP BY status")
def p27_runoff(spark, d):
    c = catchment_cells(spark, d).select(runoff.runoff("rain", "slope", "land_cover").alias("q"))
    return c.groupBy(F.col("q.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q.value"), 4).alias("total_runoff"))


@query(f"""WITH {CATCHMENT_SQL},
s AS (SELECT catchment_id, count(*) AS n_inputs, count(*) FILTER (WHERE gone) AS n_missing, sum(runoff / 1000 * area) AS partial, count(*) FILTER (WHERE status = 'rate_limited') AS rl, count(*) FILTER (WHERE status = 'stale') AS st,
  count(*) FILTER (WHERE fixture AND NOT gone) AS fx FROM cells GROUP BY catchment_id)
SELECT catchment_id, n_inputs, n_missing, round(partial + 0.0000123456e0, 4) AS partial, CASE WHEN n_missing = 0 THEN round(partial + 0.0000123456e0, 4) END AS total,
  CASE WHEN rl > 0 THEN 'rate_limited' WHEN st > 0 THEN 'stale' WHEN fx > 0 THEN 'synthetic_fixture' ELSE 'available' END AS status FROM s""")
def a05_catchment_totals(spark, d):
    cells = catchment_cells(spark, d).withColumn("runoff", runoff.runoff("rain", "slope", "land_cover"))
    out = runoff.catchment_totals(runoff.cell_volumes(cells))
    return out.select("catchment_id", "n_inputs", "n_missing", F.round(F.col("partial") + 0.0000123456, 4).alias("partial"), F.round(F.col("value") + 0.0000123456, 4).alias("total"), "status")  # moved off halves, where engines round apart


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN imp IS NOT NULL THEN round(least(1e0, least(l_quantity / 50, 1e0) * imp * (0.5e0 + least(l_discount * 300, 30e0) / 30)), 6) END AS score
FROM (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.15e0 WHEN 3 THEN CASE WHEN l_quantity > 30 THEN 0.8e0 ELSE 0.2e0 END END AS imp FROM lineitem)""")
def p28_runoff_risk(spark, d):
    li = table(spark, d, "lineitem")
    out = runoff.runoff_risk(F.col("l_quantity"), F.col("l_discount") * 300, 100 * (1 + F.col("l_linenumber") % 5) + 11)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r6(out["score"]).alias("score"))


@query("SELECT l_orderkey AS surface, round(sum(l_quantity), 6) AS total_percent, CASE WHEN sum(l_quantity) BETWEEN 99 AND 101 THEN 'available' ELSE 'invalid_response' END AS status FROM lineitem GROUP BY 1")
def a24_allocation_check(spark, d):
    out = runoff.allocation_check(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("surface"), "l_quantity"), "surface", "l_quantity")
    return out.select("surface", r6("total_percent").alias("total_percent"), "status")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN 'stale' WHEN event_id % 11 = 0 THEN 'wrong' ELSE 'available' END AS s, CASE WHEN event_id % 3 = 0 THEN 'why' WHEN event_id % 4 = 0 THEN ' ' END AS r FROM events)
SELECT event_id, concat_ws(',', CASE WHEN s = 'wrong' THEN 'E1' END, CASE WHEN s = 'available' AND v IS NULL THEN 'E2' END, CASE WHEN s <> 'available' AND v IS NOT NULL THEN 'E3' END,
  CASE WHEN s = 'available' AND r IS NOT NULL THEN 'E4' END, CASE WHEN s <> 'available' AND coalesce(trim(r), '') = '' THEN 'E5' END) AS violations FROM e""")
def p42_evidence_violations(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(k % 7 != 0, F.col("value")).alias("value"), F.when(k % 5 == 0, "stale").when(k % 11 == 0, "wrong").otherwise("available").alias("status"), F.when(k % 3 == 0, "why").when(k % 4 == 0, " ").alias("missing_reason"))
    return e.select("event_id", F.array_join(evidence.violations(), ",").alias("violations"))


@query("""
SELECT user_id AS cell, count(DISTINCT event_type) AS n_providers, count(*) FILTER (WHERE event_type = 'error') AS n_missing, count(*) FILTER (WHERE event_type <> 'error') AS n_available FROM events GROUP BY 1""")
def a28_source_summary(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("provider"), F.lit("d").alias("dataset"), F.when(F.col("event_type") == "error", "missing").otherwise("available").alias("status"))
    return evidence.source_summary(e, ["cell"], "provider", "dataset", "status").select("cell", F.size("providers").cast("long").alias("n_providers"), "n_missing", "n_available")


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_returnflag = 'R' THEN 'stale' WHEN l_returnflag = 'N' THEN 'missing' ELSE 'available' END AS a, CASE WHEN l_linestatus = 'O' THEN 'auth_required' ELSE 'available' END AS b, l_partkey AS p FROM lineitem)
SELECT k, i, p, CASE WHEN b = 'auth_required' THEN b WHEN a <> 'available' THEN a END AS worst FROM l""")
def p43_status_precedence(spark, d):
    li = table(spark, d, "lineitem")
    a = F.when(F.col("l_returnflag") == "R", "stale").when(F.col("l_returnflag") == "N", "missing").otherwise("available")
    b = F.when(F.col("l_linestatus") == "O", "auth_required").otherwise("available")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), evidence.worst_of([a, b]).alias("worst"))


# Scalar expressions -------------------------------------------------------------------------


@query("""
SELECT s_suppkey, round(2 * 6371000e0 * atan2(sqrt(h), sqrt(greatest(1 - h, 0e0))), 3) AS distance_m FROM (
  SELECT s_suppkey, pow(sin(radians(s_nationkey * 3e0 - s_suppkey % 60) / 2), 2) + cos(radians((s_suppkey % 60)::DOUBLE)) * cos(radians(s_nationkey * 3e0)) * pow(sin(radians(s_nationkey * 5e0 - s_suppkey % 170) / 2), 2) AS h FROM supplier)""")
def p31_haversine(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(S.haversine_m(k % 60, k % 170, n * 3.0, n * 5.0), 3).alias("distance_m"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, round(sqrt(pow(px - t * 10, 2) + pow(py - t * 5, 2)), 6) AS distance FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS px, l_tax * 100 AS py, least(1e0, greatest(0e0, (l_quantity * 10 + l_tax * 100 * 5) / 125)) AS t FROM lineitem)""")
def p33_point_segment(spark, d):
    out = S.point_segment_distance("l_quantity", F.col("l_tax") * 100, F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(5.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r6(out).alias("distance"))


@query("""
SELECT c_custkey, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(abs(lat)::BIGINT::VARCHAR, 2, '0') || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lon)::BIGINT::VARCHAR, 3, '0') || '_00' AS tile
FROM (SELECT c_custkey, floor(c_acctbal / 200) AS lat, floor(c_custkey % 360 - 180.5e0) AS lon FROM customer)""")
def p10_elevation_tile(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.elevation_tile(F.col("c_acctbal") / 200, F.col("c_custkey") % 360 - 180.5).alias("tile"))


@query("""
SELECT p_partkey, round(x / 1024e0 * 360 - 180, 6) AS west, round(degrees(atan((exp(a) - exp(-a)) / 2)), 6) AS north FROM (
  SELECT p_partkey, p_partkey % 1024 AS x, pi() * (1 - 2 * (p_partkey * 7 % 1024) / 1024e0) AS a FROM part)""")
def p11_mercator_tile(spark, d):
    k = F.col("p_partkey")
    b = table(spark, d, "part").select("p_partkey", S.mercator_tile_bounds(F.lit(10), k % 1024, k * 7 % 1024).alias("b"))
    return b.select("p_partkey", r6("b.west").alias("west"), r6("b.north").alias("north"))


@query("SELECT p_partkey, CASE WHEN z < 5 THEN 2 WHEN z < 7 THEN 3 WHEN z < 9 THEN 4 WHEN z < 11 THEN 5 ELSE 6 END AS res FROM (SELECT p_partkey, p_partkey % 16 AS z FROM part)")
def p12_zoom_resolution(spark, d):
    return table(spark, d, "part").select("p_partkey", S.zoom_resolution(F.col("p_partkey") % 16).alias("res"))


@query("SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS n, round(sum(CASE WHEN value >= 20 THEN (value - 20) * 0.5e0 END), 4) AS amount FROM events GROUP BY 1")
def p34_p35_slot_amounts(spark, d):
    e = points(spark, d).select(S.floor_slot("ts").alias("slot"), S.rate_to_amount(F.col("value_num") - 20).alias("mm"))
    return e.groupBy(shown("slot").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mm"), 4).alias("amount"))


@query("SELECT o_orderkey, floor(least(1e0, greatest(0e0, (ln(1 + o_totalprice) - ln(1 + 1000e0)) / (ln(1 + 400000e0) - ln(1 + 1000e0)))) * 254 + 0.5e0)::INT AS byte FROM orders")
def p37_quantise(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.quantise("o_totalprice", 1000.0, 400000.0, log=True).alias("byte"))


@query("SELECT p_partkey, 300000 + (p_partkey % 100) * 1000 AS x0, 500000 + (p_partkey * 7 % 100) * 1000 AS y0, 300000 + (p_partkey % 100) * 1000 + 1000 AS x1 FROM part")
def p38_grid_reference(spark, d):
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    b = table(spark, d, "part").select("p_partkey", S.grid_reference_bounds(F.concat(F.lit("NY"), two(F.col("p_partkey")), two(F.col("p_partkey") * 7))).alias("b"))
    return b.select("p_partkey", "b.x0", "b.y0", "b.x1")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def p39_dates(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.date_format(t, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(t, "yyyyMMdd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(S.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("""
SELECT event_id, (['auth_required', 'auth_required', 'rate_limited', 'missing', 'upstream_error', 'auth_required', 'rate_limited', 'upstream_error', 'missing', 'missing', 'missing', 'auth_required', 'rate_limited', 'upstream_error'])[event_id % 14 + 1] AS status FROM events""")
def p40_failure_status(spark, d):
    k = F.col("event_id") % 14
    code = F.when(k == 0, 401).when(k == 1, 403).when(k == 2, 429).when(k == 3, 404).when(k == 4, 500)
    told = ["Forbidden for you", "Rate limit reached", "broken pipe", "ENOENT: no such file", "Tile Not Found", "HTTP 404 for tile", "status 403, later 404", "got 429 and 404", "Too many requests"]
    message = F.element_at(F.array(*map(F.lit, told)), F.greatest(k - 4, F.lit(1)).cast("int"))
    message = F.when(k >= 5, message).when(k == 4, "broken pipe")
    return table(spark, d, "events").select("event_id", S.failure_status(code, message).alias("status"))


@query(f"""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 44 THEN ([{", ".join(map(str, S.LAND_COVER_CODES))}])[p_size] END AS code FROM part""")
def p09_land_cover_palette(spark, d):
    return table(spark, d, "part").select("p_partkey", S.land_cover_code("p_size").alias("code"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'outfall' WHEN 1 THEN 'inlet' WHEN 2 THEN 'manhole' ELSE 'junction' END AS type FROM orders")
def p07_node_type(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", S.node_type(F.when(k == 0, "Uitlaat rivier").when(k == 1, "Straatkolk").when(k == 2, "Inspectieput")).alias("type"))


@query("""
SELECT p_partkey, round(degrees(atan(sqrt(pow((e - w) / (2 / 3600e0 * 111320 * cos(radians(46e0))), 2) + pow((n - s) / (2 / 3600e0 * 111320), 2)))), 6) AS slope FROM (
  SELECT p_partkey, p_retailprice AS w, p_retailprice + p_size AS e, p_size * 2e0 AS s, p_size * 1.5e0 AS n FROM part)""")
def p30_slope(spark, d):
    out = S.finite_difference_slope("p_retailprice", F.col("p_retailprice") + F.col("p_size"), F.col("p_size") * 2.0, F.col("p_size") * 1.5, F.lit(46.0))
    return table(spark, d, "part").select("p_partkey", r6(out).alias("slope"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(least(1e0, greatest(0e0, (l_quantity - 5) / 30)), 6) AS share, CASE WHEN l_tax = 0 THEN -1e0 ELSE round(l_discount / l_tax, 6) END AS ratio,
  greatest(0.3e0, least(1e0, (l_linenumber % 4) / 3e0)) AS confidence, 0.05e0 * (1 + 0.5e0 * (l_linenumber % 3)) AS variance FROM lineitem""")
def p14_p18_scalars(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(S.normalise("l_quantity", 5.0, 35.0)).alias("share"), r6(S.safe_divide("l_discount", "l_tax", -1.0)).alias("ratio"),
        S.confidence(n % 4, 3).alias("confidence"), S.inflated_variance(0.05, n % 3).alias("variance"),
    )
