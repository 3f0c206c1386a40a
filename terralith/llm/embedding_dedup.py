"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

No link is lost at the cells' borders: a vector is also shown to every other cell in which a vector that is near
enough could have its home, which the distance to the border between two centroids tells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Vectors on which the centroids are fitted, taken by the hash of their values: a bounded sample, for cells only.
SAMPLE = 20_000
#: Vectors a cell should hold, and the most cells; a cell that is larger is split into blocks.
CELL, MOST_CELLS = 4096, 1024
#: Rows of a block on either side of a product.
BLOCK = 2048
ROUNDS = 8


def fit_centroids(vectors: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors: rounds of nearest centroid by cosine and normalised mean."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        home = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        norm = np.linalg.norm(sums, axis=1)
        centroids = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(centroids: dict[int, np.ndarray], threshold: float):
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    # each distance once: all k * k differences at once would be k times the centroids' size
    apart = {d: np.stack([np.linalg.norm(c - one, axis=1) for one in c]) for d, c in centroids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                if int(d) not in centroids:  # the sample missed it: one cell around an arbitrary axis
                    centroids[int(d)], apart[int(d)] = np.eye(1, d), np.zeros((1, 1))
                for at in range(0, len(own), 1024):
                    part = own.slice(at, 1024)
                    x, c = _unit(part.column(4)), centroids[int(d)]
                    cos = x @ c.T
                    home = cos.argmax(1)
                    # to cross into the half-space of another centroid takes (cos - cos') / |c - c'| at least
                    gap = cos[np.arange(len(x)), home][:, None] - cos
                    shown = gap <= reach * apart[int(d)][home]
                    row, cell = np.nonzero(shown)
                    take = part.take(pa.array(row))
                    raw = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [take.column(0), take.column(1), take.column(2), take.column(3), pa.array(cell, pa.int32()), pa.array(home[row] == cell), raw],
                        names=["rep", "copies", "label", "dim", "cell", "home", "unit"],
                    )

    return run


def _products(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        ids = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(v.as_py() for v in table.column("unit")), np.float64).reshape(len(ids), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = np.empty((len(a), len(b)), bool)
        for at in range(0, len(a), 512):
            near[at : at + 512] = x[a[at : at + 512]] @ x[b].T >= threshold
        near &= ids[a][:, None] != ids[b][None]  # a vector's own copies are counted apart
        links = near @ copies[b].astype(np.float64)
        # components within the block: each side takes the other's least label until nothing changes
        big = np.iinfo(np.int64).max
        la, lb = ids[a].copy(), ids[b].copy()
        while True:
            na, nb = la.copy(), lb.copy()
            for at in range(0, len(a), 512):
                part = near[at : at + 512]
                na[at : at + 512] = np.minimum(na[at : at + 512], np.where(part, nb[None], big).min(1, initial=big))
                nb = np.minimum(nb, np.where(part, na[at : at + 512, None], big).min(0, initial=big))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        b_only = np.flatnonzero(lb != ids[b])
        return pa.table({
            "rep": pa.array(np.r_[ids[a], ids[b][b_only]]), "links": pa.array(np.r_[links, np.zeros(len(b_only))].astype(np.int64)), "root": pa.array(np.r_[la, lb[b_only]]),
        })

    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one dimension are linked at a cosine >= threshold, in double precision. A
    vector that is null, empty, zero, or holds a null or non-finite component, and one with a null label or id, links
    with nothing: 0 links, a component of its own. Exact copies are one class whose size counts in n_links. Rows
    that repeat an id count as further vectors. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("e").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("e", lambda v: v != 0)
    # -0.0 and 0.0 are the same number, but not the same key
    rows = rows.withColumn("e", F.when(good, F.transform("e", lambda v: v + F.lit(0.0))))
    classes = rows.where("e IS NOT NULL").groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # one id may stand for several vectors; classes have numbers of their own, fixed by being written
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "copies", "label", F.size("e").alias("dim"), "e"), "vector_classes")

    sizes = {(r.label, r.dim): r["n"] for r in classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1).collect()}
    cells = min(MOST_CELLS, max(1, math.ceil(max(sizes.values(), default=0) / CELL)))
    sample = classes.orderBy(F.xxhash64("e"), "rep").limit(SAMPLE).select("e").toArrow().column("e")
    centroids: dict[int, np.ndarray] = {}
    lengths = np.array([len(v) for v in sample])
    for d in np.unique(lengths):
        own = pa.array([v.as_py() for v, n in zip(sample, lengths) if n == d], pa.list_(pa.float64()))
        centroids[int(d)] = fit_centroids(_unit(own), cells)
    if len(centroids) == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    label_type = classes.schema["label"].dataType.simpleString()
    shown = written(classes.drop("least").mapInArrow(_cells(centroids, threshold), f"rep long, copies long, label {label_type}, dim int, cell int, home boolean, unit binary"), "cells")
    where = ["label", "dim", "cell"]
    blocks = shown.groupBy(*where).agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("na"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")).where("na > 0")
    dealt = shown.join(blocks, where).withColumn("h", F.xxhash64("rep", F.lit(11)))
    place = lambda n: F.pmod("h", n).cast("int")
    left = dealt.where("home").select(*where, place(F.col("na")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(0).alias("side"), "rep", "copies", "unit")
    right = dealt.select(*where, F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), place(F.col("nb")).alias("j"), F.lit(1).alias("side"), "rep", "copies", "unit")
    found = written(left.union(right).groupBy(*where, "i", "j").applyInArrow(_products(threshold), "rep long, links long, root long"), "block_links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = classes.drop("dim").join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("k", F.coalesce("component", "rep"))
    of_class = of_class.join(of_class.groupBy("k").agg(F.min("least").alias("component_id")), "k")
    of_class = of_class.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good_rows = rows.where("e IS NOT NULL").join(of_class, ["label", "e"]).select("vec_id", "n_links", "component_id")
    bad_rows = rows.where("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good_rows.unionByName(bad_rows).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
