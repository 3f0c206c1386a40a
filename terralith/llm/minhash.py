"""MinHash near-dedup with odd sketches: bands of MinHash values give candidates, parity bitmaps estimate their
similarity, and the full shingle sets confirm every link.

Documents with one and the same shingle set are one class from the start, so a group of copies is one row. A bucket's
classes are compared with its lead only, the class in the middle of the crowd, each class with one lead at first.
What shares a lead and is still apart is decided by its difference from the lead, which is short for near copies, in
blocks that yield merged components and no pairs. So a large group of near copies is mostly joined by the first step,
its pairs are never rows, and two classes that share a bucket and aren't in one component have always been decided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, row_key, words, written
from .components import components

#: Bands are added until a pair just at the threshold is missed less often than MISS.
MISS = 1e-7
#: MinHash values a band up to MANY documents, and one more for each STEEP times as many: unrelated texts, about a
#: twentieth alike, then share no more buckets a text in a larger table. The links that are found stay the same.
ROWS, MANY, STEEP = 4, 1_000_000, 20
#: Members streamed past one copy of their lead's set.
PART = 1024
#: Members and elements of their differences on one side of a block, and elements compared by one product.
BLOCK, BLOCK_ELEMENTS, COLUMNS = 2048, 2_000_000, 1024
#: Bits of an odd sketch, and deviations allowed when it excludes a candidate (beyond: under 1e-9).
SKETCH_LONGS = 8
DEVIATIONS = 6.0
_U = np.uint64


def band_rows(documents: int) -> int:
    return ROWS + max(0, math.ceil(math.log(max(documents, 1) / MANY, STEEP)))


def band_count(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def most_odd_bits(threshold: float, samples: int) -> int:
    """Largest XOR population count that a pair at the threshold can be expected to have.

    Of the samples, differ <= n(1 - t) plus the allowed deviations; each that differs toggles two of m bits at random.
    """
    m = 64 * SKETCH_LONGS
    differ = samples * (1 - threshold) + DEVIATIONS * math.sqrt(samples * threshold * (1 - threshold))
    mean = m / 2 * (1 - (1 - 2 / m) ** (2 * min(differ, samples)))
    return math.ceil(mean + DEVIATIONS * math.sqrt(mean / 2))


def shingle_sets(text: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles' hashes (ASCII letters lowered) of texts laid end to end, and where each set begins.

    A text with fewer than n words has its whole sequence as one; without words, none.
    """
    _, _, hashes, sizes = words(text, cuts, lower=True)
    shingles = _mixed(hashes, n)
    first = np.r_[0, np.cumsum(sizes)]
    sets = []
    for i, size in enumerate(sizes):
        a = first[i]
        if size >= n:
            sets.append(np.unique(shingles[a : a + size - n + 1]))
        elif size:
            sets.append(_mixed(hashes[a : a + size], size) + _U(size))
        else:
            sets.append(hashes[:0])
    return np.concatenate([hashes[:0], *sets]), np.r_[0, np.cumsum([len(s) for s in sets])]


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: max(0, len(hashes) - n + 1)]
    for i in range(1, n):
        out = mix(out * _U(0xD6E8FEB86659FD93)) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def _signatures(n: int, rows: int, bands: int):
    samples = bands * rows
    odd = mix(np.arange(1, samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    salt = mix(odd + _U(7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, cuts in blocks(batches):
            shingles, at = shingle_sets(text, cuts, n)
            size = np.diff(at)
            full = np.flatnonzero(size)
            heads = at[full]
            sketch = np.zeros((len(size), SKETCH_LONGS), np.uint64)
            band = np.zeros((len(size), bands), np.uint64)
            total = np.zeros((len(size), 2), np.uint64)
            if len(full):
                for i in range(2):  # a set's own hash does not depend on an order
                    total[full, i] = np.add.reduceat(mix(shingles + _U(i + 1)), heads)
                for i in range(samples):
                    least = mix(np.minimum.reduceat(shingles * odd[i] ^ (shingles >> _U(29)), heads) + salt[i])
                    band[full, i // rows] = mix(band[full, i // rows] + least)
                    bit = least >> _U(64 - 9) if SKETCH_LONGS == 8 else least % _U(64 * SKETCH_LONGS)
                    sketch[full, (bit >> _U(6)).astype(np.int64)] ^= _U(1) << (bit & _U(63))
                band[full] ^= salt[:bands]
            signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, bands, 0))].astype(np.int32)), signed(band[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), signed(total[:, 0]), signed(total[:, 1]), lists, *(signed(sketch[:, i]) for i in range(SKETCH_LONGS))],
                names=["id", "row", "n", "set1", "set2", "bands", *(f"s{i}" for i in range(SKETCH_LONGS))],
            )

    return run


def signatures(docs: DataFrame, n: int, rows: int, bands: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row, n (set size), set1, set2 (the set's hash), bands, s0... (odd sketch) of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return own.mapInArrow(_signatures(n, rows, bands), "id long, row long, n long, set1 long, set2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH_LONGS)))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, cuts in blocks(batches):
            shingles, at = shingle_sets(text, cuts, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["c", "shingles"])

    return run


def _against_lead(percent: int):
    """Sorted rows (a, part, b, shingles), the lead's own row (b null) first of its part: linked and the difference of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for batch in batches:
            rows, linked, apart = [], [], []
            for i, (b, shingles) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                x = np.frombuffer(shingles.as_buffer(), np.uint64)
                if b is None:
                    lead = x
                    continue
                at = np.minimum(np.searchsorted(lead, x), len(lead) - 1)
                both = lead[at] == x
                same = int(both.sum())
                rows.append(i)
                linked.append(100 * same >= percent * (len(x) + len(lead) - same))
                only = np.ones(len(lead), bool)
                only[at[both]] = False
                apart.append(np.concatenate([x[~both], lead[only]]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, apart)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *apart])))
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(linked, pa.bool_()), lists], names=["a", "b", "linked", "apart"])

    return run


def against_leads(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, apart of distinct pairs (a: lead, b: member): whether their full sets are similar enough, and the
    shingles that only one of them has. sets: c, shingles.

    A lead's set travels once for every PART of its members, which are streamed past it.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = members.join(sets.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "shingles")
    heads = parts.join(sets.withColumnRenamed("c", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    dealt = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_against_lead(percent), "a long, b long, linked boolean, apart array<long>")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each of y, by products of indicator matrices of the shared elements."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = [(np.concatenate([np.empty(0, np.int64), *s]), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (x, y)]
    shared = np.intersect1d(flat[0][0], flat[1][0])
    placed = []
    for value, row in flat:
        at = np.minimum(np.searchsorted(shared, value), max(len(shared) - 1, 0))
        hit = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], row[hit][order]))
    for first in range(0, len(shared), COLUMNS):
        sides = []
        for (at, row), n in zip(placed, out.shape):
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            one = np.zeros((n, min(COLUMNS, len(shared) - first)), np.float32)
            one[row[a:b], at[a:b] - first] = 1
            sides.append(one)
        out += sides[0] @ sides[1].T
    return out


def _decide(percent: int):
    """Of two blocks of one lead's members (columns side, k, n, apart): k, root for components that links join."""

    def run(table: pa.Table) -> pa.Table:
        side, k, n = (table.column(c).to_numpy() for c in ("side", "k", "n"))
        apart = [v.values.to_numpy() for v in table.column("apart")]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(v) for v in apart], np.int64)
        # |x ^ y| = |dx| + |dy| - 2 |dx & dy| for the differences dx, dy from one lead
        differ = size[a][:, None].astype(np.float32) + size[b][None] - 2 * _overlaps([apart[i] for i in a], [apart[i] for i in b])
        near = (differ <= (n[a][:, None] + n[b][None]) * (100 - percent) // (100 + percent)) & (k[a][:, None] != k[b][None])
        a, b = a[near.any(1)], b[near.any(0)]
        near = near[near.any(1)][:, near.any(0)]
        big = np.iinfo(np.int64).max
        ka, kb = k[a], k[b]
        while len(a):
            na = np.minimum(ka, np.where(near, kb[None], big).min(1, initial=big))
            nb = np.minimum(kb, np.where(near, na[:, None], big).min(0, initial=big))
            if (na == ka).all() and (nb == kb).all():
                break
            ka, kb = na, nb
        was, now = np.r_[k[a], k[b]], np.r_[ka, kb]
        moved = was != now
        return pa.table({"k": pa.array(was[moved]), "root": pa.array(now[moved])})

    return run


def _near(percent: int, samples: int) -> Column:
    """Whether two classes' sizes and odd sketches allow the similarity. Columns na, nb, sa0..., sb0..."""
    odd = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(SKETCH_LONGS)))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (odd <= most_odd_bits(percent / 100, samples))


def class_components(reps: DataFrame, texts: DataFrame, n: int, percent: int, rows: int) -> DataFrame:
    """c, k of the classes that share a bucket with any other: k names the component by the least c in it.

    reps: c, id, row, n, bands, s0...; texts: doc, row, text of all rows. Every pair of classes that share a bucket is
    decided, or in one component already, at the end:
    1. each class meets one lead, the best of its buckets' leads; a bucket's lead is its member that shares buckets
       with the most classes, so the middle of a group of near copies;
    2. classes that are then in another component than some lead of their buckets meet that lead;
    3. members of one lead that are still in different components are decided by their differences from the lead, in
       blocks of two sides; links merge components in the block, so their number is never that of the pairs.
    """
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    members = written(reps.select("c", F.explode("bands").alias("bucket")), "buckets")
    crowds = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = written(members.join(crowds, "bucket"), "crowded")
    ranked = crowded.join(crowded.groupBy("c").agg(F.sum("size").alias("degree")), "c").select("bucket", "c", F.struct("degree", "c").alias("rank"))
    ranked = written(ranked, "ranked")
    led = ranked.join(ranked.groupBy("bucket").agg(F.max("rank").alias("top")), "bucket").where("c <> top.c")
    led = written(led.select("c", "top").distinct().select("c", F.col("top.c").alias("lead"), "top"), "led")

    used = led.select("c").union(led.select("lead")).distinct()
    own = texts.join(reps.select("c", F.col("id").alias("doc"), "row").join(used, "c", "left_semi"), ["doc", "row"]).select("c", "text")
    # a repeated row gives its set more than once
    sets = written(own.mapInArrow(_sets(n), "c long, shingles binary").groupBy("c").agg(F.first("shingles").alias("shingles")), "shingle_sets")

    def linked(pairs: DataFrame) -> DataFrame:
        for side, name in (("a", "lead"), ("b", "c")):
            pairs = pairs.join(reps.select(F.col("c").alias(name), F.col("n").alias(f"n{side}"), *(F.col(s).alias(f"s{side}{s[1:]}") for s in sketch)), name)
        close = written(pairs.where(_near(percent, band_count(percent / 100, rows) * rows)).select(F.col("lead").alias("a"), F.col("c").alias("b")), "candidates")
        return against_leads(close, sets, percent).where("linked").select("a", "b")

    def labelled(df: DataFrame, name: str, k: str) -> DataFrame:
        return df.join(labels.withColumnRenamed("c", name).withColumnRenamed("k", k), name, "left").withColumn(k, F.coalesce(k, name))

    def merged(links: DataFrame) -> DataFrame:
        """labels after links a, b between components."""
        joined = components(links)
        every = used.join(labels, "c", "left").withColumn("k", F.coalesce("k", "c"))
        return written(every.join(joined.withColumnRenamed("id", "k"), "k", "left").select("c", F.coalesce("component", "k").alias("k")), "labels")

    best = led.groupBy("c").agg(F.max("top").alias("top")).select("c", F.col("top.c").alias("lead"))
    best = written(best, "best_leads")
    labels = components(written(linked(best), "links")).select(F.col("id").alias("c"), F.col("component").alias("k"))
    rest = labelled(labelled(led.select("c", "lead"), "c", "kb"), "lead", "ka").where("ka <> kb").select("c", "lead")
    more = linked(written(rest.join(best, ["c", "lead"], "left_anti"), "other_leads"))
    labels = merged(written(labelled(labelled(more, "a", "ka"), "b", "kb").select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct(), "links"))

    # leads of which two members are in different components: the largest component's members needn't meet each other
    open_ = written(labelled(led.select("c", "lead"), "c", "k"), "open")
    counts = open_.groupBy("lead", "k").agg(F.count(F.lit(1)).alias("size"))
    tops = counts.groupBy("lead").agg(F.max_by("k", F.struct("size", "k")).alias("main"), F.count(F.lit(1)).alias("ks")).where("ks > 1").select("lead", "main")
    open_ = open_.join(tops, "lead").join(reps.select("c", "n"), "c")
    open_ = written(open_, "open")
    if not open_.head(1):
        return labels
    apart = written(against_leads(open_.select(F.col("lead").alias("a"), F.col("c").alias("b")), sets, percent).select(F.col("a").alias("lead"), F.col("b").alias("c"), "apart"), "apart")
    open_ = open_.join(apart, ["lead", "c"])
    first = F.col("k") != F.col("main")
    blocks_of = lambda chosen: F.ceil(F.greatest(F.count_if(chosen) / BLOCK, F.sum(F.when(chosen, F.size("apart")).otherwise(0)) / BLOCK_ELEMENTS)).cast("int")
    sizes = open_.groupBy("lead").agg(blocks_of(first).alias("na"), blocks_of(F.lit(True)).alias("nb"))
    dealt = open_.join(sizes, "lead").withColumn("h", F.xxhash64("c", F.lit(5)))
    place = lambda m: F.pmod("h", m).cast("int")
    left = dealt.where(first).select("lead", place(F.greatest("na", F.lit(1))).alias("i"), F.explode(F.sequence(F.lit(0), F.greatest("nb", F.lit(1)) - 1)).alias("j"), F.lit(0).alias("side"), "k", "n", "apart")
    right = dealt.select("lead", F.explode(F.sequence(F.lit(0), F.greatest("na", F.lit(1)) - 1)).alias("i"), place(F.greatest("nb", F.lit(1))).alias("j"), F.lit(1).alias("side"), "k", "n", "apart")
    found = left.union(right).groupBy("lead", "i", "j").applyInArrow(_decide(percent), "k long, root long")
    return merged(written(found.select(F.col("k").alias("a"), F.col("root").alias("b")).distinct(), "links"))


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row, n_shingles, component: one row per row of docs; row is common.row_key(doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of n-word shingles. Nothing is
    linked with a text that is null or has no words, nor with a null id (its component is null).
    """
    rows = band_rows(docs.count())
    signed = written(signatures(docs, n, rows, band_count(percent / 100, rows), doc_id, text), "signatures")
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("set1", "set2").agg(F.min("id").alias("rep"))
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    # a set's least id may stand in several rows (repeated ids): any of them has this set
    reps = full.join(classes.withColumnRenamed("rep", "id"), ["id", "set1", "set2"], "left_semi").dropDuplicates(["id", "set1", "set2"])
    # one id may stand for several sets then; classes have numbers of their own, fixed by being written
    reps = written(reps.select(F.monotonically_increasing_id().alias("c"), "id", "row", "set1", "set2", "n", "bands", *sketch), "classes")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    found = class_components(reps, texts, n, percent, rows)

    of_class = reps.select("c", "set1", "set2", F.col("id").alias("rep")).join(found, "c", "left").withColumn("k", F.coalesce("k", "c"))
    least = of_class.groupBy("k").agg(F.min("rep").alias("least"))
    of_class = of_class.join(least, "k").select("set1", "set2", "least")
    out = signed.select("id", "row", F.col("n").alias("n_shingles"), "set1", "set2")
    # rows without a set or an id meet no class, so they don't gather in one place
    out = out.withColumn("k1", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("set1")))
    out = out.join(of_class.withColumnRenamed("set1", "k1"), ["k1", "set2"], "left")
    return out.select("id", "row", "n_shingles", F.coalesce("least", "id").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (the row's id is its component's least).

    Null and empty texts and texts without words have no shingles, are kept and linked with nothing; a null id has a
    null component and is kept; repeated rows are each returned; an empty table gives no rows; other columns are not
    read.
    """
    found = near_components(docs, n, percent, doc_id, text)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with one document of each group: rows whose id is the least of their component. Columns stay as they are.

    Repeated rows of a kept id all stay (they are one document); see near_duplicates for nulls.
    """
    found = near_components(docs, n, percent, doc_id, text)
    gone = found.where("id <> component").select(F.col("id").alias("__near_id"), F.col("row").alias("__near_row")).distinct()
    return docs.join(gone, (F.col(doc_id).cast("long") == F.col("__near_id")) & (row_key(doc_id, text) == F.col("__near_row")), "left_anti")
