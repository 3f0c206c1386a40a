"""Connected components of links, as joins and aggregations: nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: for each id in a link, the smallest id that it reaches.

    Rounds of least neighbour and of pointer jumping (a label takes its own label), each written to the shared
    folder, until none changes. A hot id has many links, but those are joined by the other end's id and the least
    label is taken with partial aggregation. Null ends are no links; an empty table has no components.
    """
    links = links.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(links.union(links.select("v", "u")).distinct(), "links")
    # the first label: the least of an id and its neighbours
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = step.select(F.col("id").alias("now"), F.col("now").alias("far"))
        step = written(step.join(jump, "now").select("id", "was", F.least("now", "far").alias("component")), "labels")
        labels = step.select("id", "component")
        if not step.where("was <> component").head(1):
            return labels
