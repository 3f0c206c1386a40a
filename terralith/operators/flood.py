"""Priority flood over tiles: where each cell drains to when depressions are filled to where they spill.

A cell's label is (spill, fill, rank, steps, terminal), the least in that order over its ways from a terminal. Such
labels as a whole can't be spread by rounds: a better label of a neighbour may lead on to a worse one. Field by field
they can. Spill levels are a minimax over all ways; once they stand, the largest fill is a minimax over the steps that
keep the spill level; once that stands too, (rank, steps, terminal) are the least over the steps that keep both.

Each of the three is spread by rounds: a tile is settled by a heap of its own, tiles exchange what their borders
offer each other, and only tiles with a better offer go on. So a task holds one tile, whatever the area.

Tables here are as long as the area, and each round joins them: the joins are hinted so that none is sent through the
driver, which a table just under the broadcast limit would be, round after round.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.intermediate import written

_LABEL = ("a", "b", "c")


def _tile(step: int):
    """Settles one tile: the least label of each cell over ways inside it. A label (a, b, c) goes on as (max(a, w), b + step, c)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        w = dict(zip(left.cell, left.w))
        label = {x: (a, int(b), None if pd.isna(c) else c) for x, a, b, c in zip(left.cell, left.a, left.b, left.c) if not pd.isna(a)}
        onward: dict = {}
        for x, n in zip(right.cell, right.nbr):
            onward.setdefault(n, []).append(x)
        heap = [(v, x) for x, v in label.items()]
        heapq.heapify(heap)
        while heap:
            v, x = heapq.heappop(heap)
            if label[x] != v:
                continue
            for y in onward.get(x, ()):
                new = (max(v[0], w[y]), v[1] + step, v[2])
                if y not in label or new < label[y]:
                    label[y] = new
                    heapq.heappush(heap, (new, y))
        none = (None, None, None)
        rows = [(t, x, wx, *label.get(x, none)) for t, x, wx in zip(left.tile, left.cell, left.w)]
        return pd.DataFrame(rows, columns=["tile", "cell", "w", *_LABEL]).astype({"b": "Int64"})

    return run


def spread(nodes: DataFrame, edges: DataFrame, step: int = 0) -> DataFrame:
    """cell, a, b, c: the least label of each cell over all ways from cells that begin with one.

    nodes: tile, cell, w, a, b, c (null a: no label to begin with); edges: tile, cell, n_tile, nbr: labels go from nbr to
    cell. Cells that no way reaches keep nulls.
    """
    edges = written(edges.select("tile", "cell", "n_tile", "nbr"), "flood_edges")
    inner, across = edges.where("tile = n_tile"), edges.where("tile <> n_tile")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"tile {kinds['tile']}, cell {kinds['cell']}, w double, a double, b long, c {kinds['c']}"
    state = written(nodes.select("tile", "cell", "w", F.col("a").cast("double"), F.col("b").cast("long"), "c", F.col("a").isNotNull().alias("fresh")), "flood")
    here = F.struct(*_LABEL)
    while True:
        busy = state.where("fresh").select("tile").distinct()
        own = state.drop("fresh").join(busy.hint("merge"), "tile", "left_semi")
        settled = own.groupBy("tile").cogroup(inner.join(busy.hint("merge"), "tile", "left_semi").groupBy("tile")).applyInPandas(_tile(step), schema)
        now = written(settled.unionByName(state.drop("fresh").join(busy.hint("merge"), "tile", "left_anti")), "flood")
        sent = now.where("a IS NOT NULL").select(F.col("cell").alias("nbr"), F.col("a").alias("na"), F.col("b").alias("nb"), F.col("c").alias("nc"))
        offers = across.join(sent.hint("merge"), "nbr").select("cell", "na", "nb", "nc").join(now.select("cell", "w").hint("merge"), "cell")
        offers = offers.groupBy("cell").agg(F.min(F.struct(F.greatest("na", "w").alias("a"), (F.col("nb") + step).alias("b"), F.col("nc").alias("c"))).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("a").isNull() | (F.col("offer") < here))
        both = now.join(offers.hint("merge"), "cell", "left").withColumn("fresh", better)
        state = written(both.select("tile", "cell", "w", *(F.when(F.col("fresh"), F.col(f"offer.{k}")).otherwise(F.col(k)).alias(k) for k in _LABEL), "fresh"), "flood")
        if not state.where("fresh").head(1):
            return now.select("cell", *_LABEL)


def priority_flood(cells: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Cell, spill, fill, terminal_rank, steps, terminal, down: the level at which each cell spills, the largest
    depth of fill on its way, and the way itself: the terminal's rank, how many steps, which terminal, the next cell.

    cells: tile, cell, elevation, terminal_rank (null: no terminal); adjacency: cell, nbr, in both directions. The least
    (spill, fill, rank, steps, terminal) wins; of neighbours that give it, the one with the least label, then id. Cells
    without an elevation are walls; cells that no terminal reaches have nulls. tile is any cut of the area into pieces
    that fit a task; ways cross tiles, and how the cut is made changes nothing.
    """
    none = F.lit(None)
    kind = cells.schema["cell"].dataType.simpleString()
    high = written(cells.where("elevation IS NOT NULL").select("tile", "cell", F.col("elevation").cast("double").alias("z"), "terminal_rank"), "flood_cells")
    near = adjacency.select("cell", "nbr").join(high.select("cell", "tile", "z").hint("merge"), "cell").join(high.select(F.col("cell").alias("nbr"), F.col("tile").alias("n_tile")).hint("merge"), "nbr")
    near = written(near.select("cell", "nbr", "tile", "n_tile", "z"), "flood_near")
    seeded = lambda value: F.when(F.col("terminal_rank").isNotNull(), value)
    spill = spread(high.select("tile", "cell", F.col("z").alias("w"), seeded(F.col("z")).alias("a"), F.lit(0).alias("b"), none.cast(kind).alias("c")), near)
    high = written(high.join(spill.select("cell", F.col("a").alias("spill")).hint("merge"), "cell").withColumn("own", F.col("spill") - F.col("z")), "flood_cells")
    level = lambda name: near.join(high.select("cell", F.col(name)).hint("merge"), "cell").join(high.select(F.col("cell").alias("nbr"), F.col(name).alias(f"n_{name}")).hint("merge"), "nbr")
    kept = written(level("spill").where(F.greatest("z", "n_spill") == F.col("spill")), "flood_near")
    fill = spread(high.where("spill IS NOT NULL").select("tile", "cell", F.col("own").alias("w"), seeded(F.lit(0.0)).alias("a"), F.lit(0).alias("b"), none.cast(kind).alias("c")), kept)
    high = written(high.join(fill.select("cell", F.col("a").alias("fill")).hint("merge"), "cell", "left"), "flood_cells")
    both = kept.join(high.select("cell", "fill", "own").hint("merge"), "cell").join(high.select(F.col("cell").alias("nbr"), F.col("fill").alias("n_fill")).hint("merge"), "nbr")
    both = written(both.where(F.greatest("n_fill", "own") == F.col("fill")), "flood_near")
    way = spread(high.where("spill IS NOT NULL").select("tile", "cell", F.lit(-math.inf).alias("w"), seeded(F.col("terminal_rank")).alias("a"), F.lit(0).alias("b"), seeded(F.col("cell")).alias("c")), both, step=1)
    way = way.select("cell", "a", F.col("b").alias("steps"), F.col("c").alias("terminal"))
    led = both.join(way.hint("merge"), "cell").join(way.select(F.col("cell").alias("nbr"), F.col("a").alias("na"), F.col("steps").alias("ns"), F.col("terminal").alias("nt")).hint("merge"), "nbr")
    led = led.where((F.col("a") == F.col("na")) & (F.col("steps") == F.col("ns") + 1) & (F.col("terminal") == F.col("nt")))
    down = led.groupBy("cell").agg(F.min(F.struct("n_spill", "n_fill", "nbr")).alias("m")).select("cell", F.col("m.nbr").alias("down"))
    out = high.join(way.hint("merge"), "cell", "left").select("cell", "spill", "fill", F.col("a").cast("int").alias("terminal_rank"), "steps", "terminal").join(down.hint("merge"), "cell", "left")
    return cells.select("cell").join(out.hint("merge"), "cell", "left").select("cell", "spill", "fill", "terminal_rank", "steps", "terminal", "down")


def depression_fill(spill: Column, elevation: Column) -> Column:
    """How far a cell is raised: its spill level above its elevation, at least 0; null where either is missing."""
    return F.when((spill - elevation).isNotNull(), F.greatest(F.lit(0.0), spill - elevation))
