"""Streaming ingest (an extension): the batch operators' counterparts on unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cube import Cube


def deduplicated(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Points whose key (cell, ts, layer, variable) was not seen within the lateness; state is dropped behind the watermark."""
    return points.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["cell", "ts", "layer", "variable"])


def sliding_totals(points: DataFrame, hours: int, slot_minutes: int = 30, lateness: str = "1 hour") -> DataFrame:
    """Look-back windows [end - hours, end) that end on every slot: a total only where all slots have a value."""
    expected = hours * 60 // slot_minutes
    own = F.window("ts", f"{hours} hours", f"{slot_minutes} minutes")
    slot = F.floor(F.unix_seconds("ts") / (slot_minutes * 60))
    # slots are counted as distinct by their bit in a set; a value that repeats in a slot makes the window invalid
    out = points.withWatermark("ts", lateness).groupBy(own.alias("w"), "cell", "layer", "variable")
    out = out.agg(F.count("value_num").alias("n_values"), F.size(F.collect_set(slot)).alias("n_slots"), F.sum("value_num").alias("partial"))
    whole = (F.col("n_values") == expected) & (F.col("n_slots") == expected)
    status = F.when(F.col("n_values") > F.col("n_slots"), "invalid_response").when(whole, "available").otherwise("incomplete_window")
    return out.select("cell", "layer", "variable", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.when(status == "available", F.col("partial")).alias("total"), status.alias("status"), "partial", "n_slots")


def tumbling_counts(points: DataFrame, length: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    return points.withWatermark("ts", lateness).groupBy(F.window("ts", length).alias("w"), "variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value_num").alias("total")).select("variable", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def sessions(points: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return points.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def revisions(points: DataFrame, lateness: str = "1 hour", order: tuple[str, ...] = ("final", "late", "early")) -> DataFrame:
    """Best product of each slot, as a streaming aggregation: max_by over the products' order."""
    rank = -F.array_position(F.array(*map(F.lit, order)), F.col("product"))
    return points.withWatermark("ts", lateness).groupBy("cell", "layer", "variable", "ts").agg(F.max_by(F.struct("product", "value_num"), rank).alias("p")).select("cell", "layer", "variable", "ts", "p.*")


def upsert_into(cube: Cube, points: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch upserts into the cube; a batch that is repeated after a failure gives the same cube."""

    def put(batch: DataFrame, _: int) -> None:
        cube.write(batch)

    return write(points, put, checkpoint, once)


def write(points: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
