"""Hazard models per cell as column expressions (P19-P26, P57). Each gives struct(mean, variance, confidence, classes, used, missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, confidence, inflated_variance, three_classes

# Fixed values of the models.
SOFT_SITES = (411, 412, 421, 422, 423, 511, 512, 521, 522, 523)
BUILT_SITES = (111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142)
SITE_SOFT, SITE_BUILT, SITE_ROCK = 1.8, 1.3, 1.0
INFILTRATION_MM_H = {"forest": 50.0, "grassland": 30.0, "agricultural": 15.0, "urban": 5.0, "wetland": 80.0, "water": 1000.0, "bare": 10.0}


def _result(mean: Column, variance: Column, conf: Column, present: dict[str, Column]) -> Column:
    # bound once: the expression of the mean is long and the classes name it many times
    classes = F.transform(F.array(mean), three_classes)[0]
    used = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in present.items())))
    missing = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in present.items())))
    return F.struct(mean.alias("mean"), variance.alias("variance"), conf.alias("confidence"), classes.alias("classes"), used.alias("used"), missing.alias("missing"))


def landslide(slope: str = "slope", susceptibility: str = "elsus_class", conservative: bool = False) -> Column:
    """0.6 of the slope's share and 0.4 of the susceptibility class, which the slope stands for where it is missing."""
    s, k = F.col(slope), F.col(susceptibility)
    steep = F.when(s <= 0, 0.0).when(s <= 45, s / 45).otherwise(1 + 0.3 * F.least(s - 45, F.lit(25.0)) / 25)
    steep = F.when(s.isNull(), F.lit(0.5)).otherwise(steep)
    guess = F.when(s < 10, 0.1).when(s < 20, 0.3).when(s < 30, 0.5).when(s < 40, 0.7).otherwise(0.85)
    rank = F.when(k.isNotNull(), clamp((k - 1) / 4)).when(s.isNotNull(), guess).otherwise(F.lit(0.6 if conservative else 0.5))
    mean = clamp(0.6 * steep + 0.4 * rank)
    n = F.when(s.isNotNull(), 1).otherwise(0) + F.when(k.isNotNull(), 1).otherwise(0)
    conf = confidence(n, 2) * F.when(k.isNull() & s.isNotNull(), 0.8).otherwise(1.0)
    return _result(mean, inflated_variance(0.05, 2 - n), conf, {"slope": s.isNotNull(), "elsusClass": k.isNotNull()})


def seismic(pga: str = "hazard_pga", land_cover: str = "clc_class", lithology: str = "lithology", conservative: bool = False) -> Column:
    """P20: peak acceleration times a site factor, over 0.5 g, to the power 0.8."""
    g, k, rock = F.col(pga), F.col(land_cover), F.col(lithology)
    site = F.when(rock.isNotNull() | k.isNull(), SITE_ROCK).when(k.isin(*SOFT_SITES), SITE_SOFT).when(k.isin(*BUILT_SITES), SITE_BUILT).otherwise(SITE_ROCK)
    mean = F.when(g.isNull(), F.lit(0.2 if conservative else 0.1)).otherwise(clamp(F.pow(F.greatest(F.least(F.lit(1.0), g * site / 0.5), F.lit(0.0)), F.lit(0.8))))
    n = F.when(g.isNotNull(), 1).otherwise(0) + F.when(rock.isNotNull() | k.isNotNull(), 1).otherwise(0)
    missing = F.when(g.isNull(), 1).otherwise(0) + F.when(rock.isNull(), 1).otherwise(0)
    conf = confidence(n, 2) * F.when(rock.isNull() & k.isNotNull(), 0.7).otherwise(1.0)
    return _result(mean, inflated_variance(0.15, missing), conf, {"hazardPGA": g.isNotNull(), "lithology": rock.isNotNull()})


def pga_class(pga: str = "hazard_pga") -> Column:
    """P21."""
    g = F.col(pga)
    return F.when(g.isNull(), F.lit(None)).when(g < 0.1, "low").when(g < 0.3, "moderate").when(g < 0.5, "high").otherwise("very_high")


def water_proxy(slope: str = "slope", land_cover: str = "clc_class", conservative: bool = False) -> Column:
    """A placeholder from slope and land cover; its confidence says so."""
    s, k = F.col(slope), F.col(land_cover)
    base = F.coalesce(clamp(s / 20), F.lit(0.6 if conservative else 0.5))
    cover = F.when(k.between(311, 313), -0.15).when(k.between(321, 324), -0.05).when(k.between(111, 142), 0.2).when(k.between(411, 423), -0.3).when(k.between(511, 523), -0.4).otherwise(0.0)
    n = F.when(s.isNotNull(), 1).otherwise(0) + F.when(k.isNotNull(), 1).otherwise(0)
    return _result(clamp(base + cover), inflated_variance(0.12, 2 - n), confidence(n, 2) * 0.3, {"slope": s.isNotNull(), "clcClass": k.isNotNull()})


def cover_family(land_cover: str = "clc_class") -> Column:
    k = F.col(land_cover)
    return (
        F.when(k.between(100, 199), "urban").when(k.between(200, 299), "agricultural").when(k.between(311, 313), "forest").when(k.between(321, 324), "grassland")
        .when(k.between(331, 335), "bare").when(k.between(400, 499), "wetland").when(k.between(500, 599), "water").otherwise("agricultural")
    )


def water_production(slope: str = "slope", land_cover: str = "clc_class", rain24: str = "rain24h", rain72: str = "rain72h") -> Column:
    """Rain against what the ground takes up; without rain, the terrain proxy."""
    r24, r72 = F.col(rain24), F.coalesce(F.col(rain72), 3 * F.col(rain24))
    family = cover_family(land_cover)
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in INFILTRATION_MM_H.items() for x in kv)), family)
    share = lambda rain, hours: F.least(F.lit(1.0), rain / (hours * rate))
    stress = 0.6 * share(r24, 24) + 0.4 * share(r72, 72) + F.when(r24 > 100, 0.2).when(r24 > 60, 0.1).otherwise(0.0)
    mean = F.when(r24.isNotNull(), clamp(stress)).otherwise(water_proxy(slope, land_cover)["mean"])
    present = {"rain24h": r24.isNotNull(), "rain72h": F.col(rain72).isNotNull(), "slope": F.col(slope).isNotNull(), "clcClass": F.col(land_cover).isNotNull()}
    n = sum((F.when(c, 1).otherwise(0) for c in present.values()), F.lit(0))
    return _result(mean, inflated_variance(0.06, 4 - n), F.least(confidence(n, 4), F.lit(0.85)), present)


def runoff_coefficient(slope: str = "slope", land_cover: str = "clc_class") -> Column:
    """Part of P23: share of rain that runs off, by slope, then by what covers the ground; open water keeps it all."""
    s = F.coalesce(F.col(slope), F.lit(5.0))
    family = cover_family(land_cover)
    base = F.when(s < 2, 0.2).when(s < 10, 0.2 + 0.2 * (s - 2) / 8).when(s < 20, 0.4 + 0.2 * (s - 10) / 10).otherwise(F.lit(0.6))
    cover = F.when(family == "urban", 0.3).when(family == "forest", -0.15).when(family == "wetland", -0.1).when(family == "bare", 0.1).otherwise(0.0)
    return F.when(family == "water", 0.0).otherwise(clamp(base + cover, 0.05, 0.95))


def mineral(land_cover: str = "clc_class") -> Column:
    """An extraction site or not."""
    k = F.col(land_cover)
    n = F.when(k.isNotNull(), 1).otherwise(0)
    return _result(F.when(F.coalesce(k == 131, F.lit(False)), 0.9).otherwise(0.1), F.lit(0.15), confidence(n, 1) * 0.4, {"clcClass": k.isNotNull()})


def all_risks(cells: DataFrame) -> DataFrame:
    """Cells with the four models and their mean; the water model is the proxy, as in the bundle."""
    out = cells.select("*", landslide().alias("landslide"), seismic().alias("seismic"), water_proxy().alias("water"), mineral().alias("mineral"))
    return out.withColumn("score", (F.col("landslide.mean") + F.col("seismic.mean") + F.col("water.mean") + F.col("mineral.mean")) / 4)


def explain(name: str, result: Column) -> Column:
    """One sentence, made only where it is asked for."""
    return F.format_string(f"{name}: mean %.2f, confidence %.2f, missing [%s]", result["mean"], result["confidence"], F.array_join(result["missing"], ", "))
