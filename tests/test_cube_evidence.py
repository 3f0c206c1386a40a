"""Golden cases of the cube, the evidence algebra, runoff and the hazard models."""

import math

import pytest
from pyspark.sql import functions as F
from terralith.functions import scalars as S
from terralith.operators import cube, evidence, risk, runoff

POINT = "cell string, ts timestamp, layer string, variable string, value_num double, value_str string, ingest_seq long"


def points(spark, rows):
    return spark.createDataFrame(rows, "cell string, t long, v double, seq long").select(
        "cell", F.timestamp_seconds("t").alias("ts"), F.lit("L").alias("layer"), F.lit("x").alias("variable"), F.col("v").alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.col("seq").alias("ingest_seq"),
    )


def test_upsert_latest_and_tolerance(spark):
    p = points(spark, [("a", 100, 1.0, 1), ("a", 100, 2.0, 2), ("a", 200, 0.0, 3), ("b", 100, 5.0, 4)])
    up = cube.upsert(p.limit(0), p).collect()
    assert len(up) == 3 and {r.value_num for r in up if r.cell == "a" and r.ts.timestamp() == 100} == {2.0}
    last = {r.cell: r.value_num for r in cube.latest(p).collect()}
    assert last == {"a": 0.0, "b": 5.0}  # an observed zero is a value
    assert {r.cell for r in cube.latest(p, tolerance_s=50).collect()} == {"a"}


def test_delete_needs_a_criterion_and_ignores_empty_lists(spark):
    p = points(spark, [("a", 1, 1.0, 1), ("b", 2, None, 2)])
    with pytest.raises(ValueError):
        cube.delete(p, cells=[])
    stay, go = cube.delete(p, cells=["a"], layers=[])
    assert (stay.count(), go.count()) == (1, 1)


def test_series_stats_use_the_upper_median(spark):
    r = cube.series_stats(points(spark, [("a", i, float(i), i) for i in (1, 2, 3, 4)] + [("a", 9, None, 9)])).first()
    assert (r.n, r.median) == (4, 3.0) and math.isclose(r.stddev, 1.118033988749895)


def test_downsample_by_double_arithmetic(spark):
    p = points(spark, [("a", i, float(i), i) for i in range(10)])
    assert sorted(r.value_num for r in cube.downsample(p, 4).collect()) == [0, 2, 5, 7]
    for n in (7, 29, 60):
        for m in (61, 97, 119):
            q = points(spark, [("a", i, float(i), i) for i in range(m)])
            assert sorted(r.value_num for r in cube.downsample(q, n).collect()) == sorted({math.floor(i * (m / n)) for i in range(n)})
            break
    assert cube.downsample(p, 20).count() == 10


def test_features_keep_absent_cells_and_unknown_keys(spark):
    p = points(spark, [("a", 1, 0.0, 1)])
    asked = spark.createDataFrame([("a",), ("z",)], "cell string")
    rows = {r.cell: r for r in cube.features(p, {"L:x": "slope", "L:y": "rain24h"}, asked).collect()}
    assert rows["a"].slope == 0.0 and rows["z"].slope is None and rows["a"].rain24h is None
    extra = cube.features(p, {"Q:q": "slope"}).first()
    assert extra.extra == {"L:x": "0.0"}


def test_as_of_never_looks_ahead(spark):
    p = points(spark, [("a", 10, 1.0, 1), ("a", 20, 2.0, 2)])
    asked = spark.createDataFrame([("a", 5), ("a", 10), ("a", 19), ("a", 99), ("b", 1)], "cell string, t long").select("cell", F.lit("L").alias("layer"), F.lit("x").alias("variable"), F.timestamp_seconds("t").alias("at"))
    got = {(r.cell, int(r.at.timestamp())): r.value_num for r in cube.as_of(p, asked).collect()}
    assert got == {("a", 5): None, ("a", 10): 1.0, ("a", 19): 1.0, ("a", 99): 2.0, ("b", 1): None}


def test_cube_store(spark, tmp_path):
    store = cube.Cube(spark, f"{tmp_path}/cube")
    full = points(spark, [("a", 1, 1.0, 1), ("b", 1, 2.0, 2)]).select(*POINT.replace(",", "").split()[::2])
    store.write(full)
    store.write(points(spark, [("a", 1, 9.0, 3)]))
    assert {r.cell: r.value_num for r in store.points().collect()} == {"a": 9.0, "b": 2.0}
    assert store.delete(cells=["b"]) == 1 and store.delete(cells=["b"]) == 0
    assert store.points().count() == 1


def test_writes_leave_other_partitions_alone(spark, tmp_path):
    path = tmp_path / "cube"
    store = cube.Cube(spark, str(path))
    day, columns = 86_400, POINT.replace(",", "").split()[::2]
    first = points(spark, [("a", 1, 1.0, 1), ("b", 2, 2.0, 2), ("a", day + 1, 3.0, 3)]).select(*columns)
    odd = first.withColumn("layer", F.lit("M /%41:"))  # a name that needs escapes
    store.write(first.unionByName(odd))
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    before = files()
    assert len({f.rsplit("/", 1)[0] for f in before}) == 4
    store.write(points(spark, [("a", 1, 9.0, 4), ("c", 5, 7.0, 5)]).select(*columns))
    after = files()
    same = {f for f in before if "layer=L/day=0" not in f}
    assert same and all(after[f] == before[f] for f in same) and set(after) & set(before) == same
    assert {(r.cell, r.layer, int(r.ts.timestamp())): r.value_num for r in store.points().where("layer = 'L'").collect()} == {("a", "L", 1): 9.0, ("b", "L", 2): 2.0, ("c", "L", 5): 7.0, ("a", "L", day + 1): 3.0}
    assert [r.value_num for r in store.points(start=points(spark, [("a", day, 0.0, 0)]).first().ts).where("layer = 'L'").collect()] == [3.0]
    assert store.delete(layers=["M /%41:"], cells=["a"]) == 2  # one of its days is empty now, the other is not
    assert {f.split("day=")[1][0] for f in files() if not f.startswith("layer=L")} == {"0"} and store.points().count() == 5
    assert all(files()[f] == after[f] for f in after if f.startswith("layer=L"))
    store.write(first.limit(0))
    assert store.points().count() == 5
    with pytest.raises(ValueError):
        store.write(first.withColumn("layer", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        store.delete()


def test_evidence_rules(spark):
    rows = [("ok0", 0.0, "available", None), ("gone", None, "missing", "why"), ("e2", None, "available", None), ("e3", 1.0, "stale", "why"), ("e5", None, "stale", " "), ("e1", None, "odd", "x"), ("e4", 1.0, "available", "x"), ("null", None, None, None)]
    df = spark.createDataFrame(rows, "id string, value double, status string, missing_reason string")
    got = {r.id: r.v for r in df.select("id", evidence.violations().alias("v")).collect()}
    assert got == {"ok0": [], "gone": [], "e2": ["E2"], "e3": ["E3"], "e5": ["E5"], "e1": ["E1"], "e4": ["E4"], "null": ["E1", "E5"]}
    more = spark.createDataFrame([(1.0, "available", None, "synthetic", "d", None, 3.0, 1.1)], "value double, status string, missing_reason string, p string, d string, a timestamp, b double, q double")
    names = {"provider": "p", "dataset": "d", "lat": "b", "lon": "b", "source_quality": "q"}
    assert more.select(evidence.violations(names=names).alias("v")).first().v == ["E11"]


def ev(value, status="available"):
    return (value, status)


CELL = "rain struct<value:double,status:string>, slope struct<value:double,status:string>, land_cover struct<value:double,status:string>"


def test_runoff_cases(spark):
    rows = [(ev(20.0), ev(15.0), ev(111.0)), (ev(0.0), ev(15.0), ev(111.0)), (ev(20.0), ev(None, "missing"), ev(111.0)), (ev(20.0), ev(15.0), ev(0.0)), (ev(-1.0), ev(1.0), ev(111.0)), (ev(1.0), ev(91.0), ev(111.0)), (ev(None, "stale"), ev(None, "auth_required"), ev(1.0)), (ev(1.0, "synthetic_fixture"), ev(0.0), ev(511.0)), (ev(None), ev(0.0), ev(111.0))]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, CELL).coalesce(1).select(runoff.runoff()).collect()]
    assert math.isclose(got[0][0], 17.0) and got[0][1:] == ("available", None)
    assert got[1] == (0.0, "available", None)
    assert got[2][0] is None and got[2][1] == "missing" and "slope_deg=missing" in got[2][2]
    assert [g[1] for g in got[3:6]] == ["invalid_response"] * 3 and all(g[0] is None for g in got[3:6])
    assert got[6][1] == "auth_required"  # the failure that comes first in the order
    assert got[7] == (1.0, "synthetic_fixture", None) and got[8][1] == "missing"


def test_strict_totals(spark):
    rows = [("c", 10.0, "available", "w"), ("c", None, "rate_limited", "w"), ("d", 0.0, "available", "w"), ("d", 2.0, "synthetic_fixture", "w"), ("e", 1.0, "available", "w"), ("e", 1.0, "available", "v"), ("f", None, "odd", "w")]
    df = spark.createDataFrame(rows, "k string, v double, s string, w string")
    got = {r.k: r for r in evidence.strict_sum(df, ["k"], "v", "s", "w").collect()}
    assert got["c"].value is None and got["c"].partial == 10.0 and got["c"].status == "rate_limited"
    assert got["d"].value == 2.0 and got["d"].status == "synthetic_fixture"
    assert got["e"].value is None and got["e"].status == "invalid_response"
    assert got["f"].status == "invalid_response"
    cells = spark.createDataFrame([("c", 1.0, "available")], "catchment_id string, volume_m3 double, volume_status string")
    none = runoff.catchment_totals(cells, spark.createDataFrame([("c",), ("x",)], "catchment_id string")).where("catchment_id = 'x'").first()
    assert none.value is None and none.status == "missing"


def test_hazard_means(spark):
    schema = "slope double, elsus_class double, hazard_pga double, clc_class int, lithology string, rain24h double, rain72h double"
    one = lambda row, model: spark.createDataFrame([row], schema).select(model.alias("m")).first().m
    blank = (None,) * 7
    assert math.isclose(one((45.0, 3.0, *blank[2:]), risk.landslide()).mean, 0.8)
    assert math.isclose(one((70.0, 3.0, *blank[2:]), risk.landslide()).mean, 0.98)
    assert math.isclose(one((None, None, 0.2, 312, None, None, None), risk.seismic()).mean, 0.4**0.8)
    assert math.isclose(one((None, None, 0.2, 411, None, None, None), risk.seismic()).mean, 0.72**0.8)
    w = one((15.0, None, None, 312, None, None, None), risk.water_proxy())
    assert math.isclose(w.mean, 0.6) and math.isclose(w.confidence, 0.3)
    assert [one((None, None, None, k, None, None, None), risk.mineral()).mean for k in (131, 211)] == [0.9, 0.1]
    empty = one(blank, risk.landslide())
    assert (empty.mean, empty.variance, empty.missing) == (0.5, 0.1, ["slope", "elsusClass"])
    assert math.isclose(sum(empty.classes), 1)
    assert one((None, None, None, 111, None, 0.0, None), risk.water_production()).mean == 0.0


def test_scalars(spark):
    row = spark.range(1).select(
        S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"), S.elevation_tile(F.lit(-0.5), F.lit(11.2)).alias("t"), S.crs_to_utm(F.lit(44.5), F.lit(11.3), 32).alias("u"),
        S.grid_reference_bounds(F.lit("NY1234")).alias("g"), S.parse_date(F.lit("03/02/2020")).alias("d"), S.parse_date(F.lit("x")).alias("n"), S.land_cover_code(F.lit(45)).alias("c"), S.normalise(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("z"),
        S.path_length_m(F.array(*(F.struct(F.lit(0.0).alias("lat"), F.lit(float(i)).alias("lon")) for i in range(3)))).alias("p"), S.quantise(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("q"),
    ).first()
    assert math.isclose(row.h, math.radians(1) * 6371000, rel_tol=1e-9) and row.t == "S01_00_E011_00" and math.isclose(row.p, 2 * row.h, rel_tol=1e-9)
    assert abs(row.u.east - 682_800) < 500 and abs(row.u.north - 4_929_900) < 1_000
    assert tuple(row.g) == (312000, 534000, 313000, 535000) and str(row.d) == "2020-02-03" and row.n is None and row.c is None and row.z == 0.0 and row.q == 255


def test_projections(spark):
    """The worked examples that the systems' definitions are published with, and there and back."""
    from terralith.functions import projections as Pr

    dms = lambda d, m, s: d + m / 60 + s / 3600
    known = [(3035, 50.0, 5.0, 3962799.45, 2999718.85), (27700, dms(52, 39, 27.2531), dms(1, 43, 4.5177), 651409.903, 313177.270), (28992, 53.0, 6.0, 196105.283, 557057.739)]
    for epsg, lat, lon, x, y in known:
        df = spark.createDataFrame([(1, lat, lon)], "k int, lat double, lon double")
        r = Pr.projected(df, epsg, shift=False).first()
        assert math.isclose(r.x, x, abs_tol=0.006) and math.isclose(r.y, y, abs_tol=0.006), (epsg, r)
    church = spark.createDataFrame([(52.155172897, 5.387203657)], "lat double, lon double")
    r = Pr.projected(church, 28992).first()
    assert math.hypot(r.x - 155000, r.y - 463000) < 1
    norfolk = spark.createDataFrame([(dms(52, 39, 28.72), dms(1, 42, 57.79))], "lat double, lon double")
    r = Pr.projected(norfolk, 27700).first()
    assert math.hypot(r.x - 651409.9, r.y - 313177.3) < 1
    rows = [(i, 44.0 + i % 14, -5.0 + (i * 7) % 19 + i / 97) for i in range(120)] + [(500, None, 3.0), (501, 95.0, 3.0), (502, 52.0, 10.0)]
    df = spark.createDataFrame(rows, "k int, lat double, lon double")
    for epsg, off in ((3035, 2e-8), (27700, 3e-6), (28992, 3e-6), (32632, 1e-9)):
        back = {r.k: r for r in Pr.unprojected(Pr.projected(df, epsg), epsg, lat="la", lon="lo").collect()}
        assert len(back) == len(rows) and back[500].la is None and back[501].x is None
        assert all(abs(r.la - r.lat) < off and abs(r.lo - r.lon) < 2 * off for k, r in back.items() if k not in (500, 501)), epsg
    utm = Pr.projected(df.where("lon BETWEEN 6 AND 12"), 32632).select("*", S.crs_to_utm("lat", "lon", 32).alias("u")).collect()
    assert all(abs(r.x - r.u.east) < 0.01 and abs(r.y - r.u.north) < 0.01 for r in utm)
    over = Pr.reprojected(Pr.projected(df.where("k < 5"), 27700), 27700, 3035).collect()
    straight = {r.k: r for r in Pr.projected(df.where("k < 5"), 3035).collect()}
    assert all(math.hypot(r.x - straight[r.k].x, r.y - straight[r.k].y) < 0.5 for r in over)
    with pytest.raises(ValueError):
        Pr.system(4326)
    plan = Pr.projected(df, 28992)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
