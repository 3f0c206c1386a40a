"""Registered queries process all rows of their tables."""

from terralith.plans.registry import QUERIES


def test_scenarios_cover_the_whole_grid(spark):
    d = "/root/testdata/sf0.01"
    assert QUERIES["l04_scenarios"](spark, d).count() == 3 * spark.read.parquet(f"{d}/part.parquet").count()
    got = QUERIES["l04_event_scenarios"](spark, d).groupBy("scenario", "status").count().collect()
    assert {(r.scenario, r.status) for r in got} == {(s, "available") for s in ("low", "middle", "high")}
    assert sum(r["count"] for r in got) == 3 * spark.read.parquet(f"{d}/part.parquet").count()
