"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and are cut from every document.

Per line hash, HyperLogLog sketches of the sites merge by aggregation; only lines whose estimate is near the
threshold get an exact distinct count. Lines of a single site are set aside before, by their least and greatest site.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

#: Sites from which a line counts as boilerplate.
MIN_SITES = 5
#: Boilerplate lines up to this number (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000
#: Lines of a document whose cuts are looked up together.
TOGETHER = 256
#: Sketch size (log2 of registers), its relative standard error, and the deviations called near.
LG_K = 11
DEVIATIONS = 4.0


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _normal(line: Column) -> Column:
    """What makes two lines the same: their words, whatever white space is between, before and after."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> tuple[DataFrame, DataFrame]:
    """(k1, k2) of the lines found on min_sites sites or more, and all lines: id, row, at, k1, k2, site.

    Null sites are no site; blank lines are no lines.
    """
    line = _normal(F.col("line"))
    lines = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row"), F.col(site).alias("site"), F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    lines = lines.select("id", "row", "at", "site", line.alias("line")).where("line <> ''")
    # two independent 64-bit hashes: by chance equal only beyond 10**18 distinct lines
    lines = written(lines.select("id", "row", "at", "site", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.reverse("line")).alias("k2")), "lines")
    if min_sites <= 1:
        return lines.where("site IS NOT NULL").select("k1", "k2").distinct(), lines
    # a line's rows become one for each site in the map tasks, so a frequent line is as many rows as it has sites
    sited = written(lines.where("site IS NOT NULL").select("k1", "k2", "site").distinct(), "line_sites")
    spread = sited.groupBy("k1", "k2").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a < b").select("k1", "k2")
    several = written(sited.join(spread, ["k1", "k2"]).select("k1", "k2", "site"), "spread_lines")
    estimate = several.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
    # a sketch of few sites is exact up to its coupons; beyond, errors are relative
    slack = max(1.0, DEVIATIONS * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    estimate = written(estimate.where(F.col("about") >= min_sites - slack), "line_spread")
    sure = estimate.where(F.col("about") > min_sites + slack).select("k1", "k2")
    near = estimate.where(F.col("about") <= min_sites + slack).select("k1", "k2")
    exact = several.join(near, ["k1", "k2"]).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("k1", "k2")), lines


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, keep_whole: bool = False, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs' columns with boilerplate lines cut from the text, n_lines and n_cut after them.

    A line is cut if it stands on min_sites distinct sites or more, in every document, even of a null site. Other
    lines stay byte for byte, in order. With keep_whole a document without any other line (blank ones aside) stays as
    it is and has n_cut 0. A null text stays null with 0 lines; an empty text has one blank line; blank lines are
    never cut; repeated rows are each returned; an empty table gives no rows. Columns of docs that are named n_lines
    or n_cut are replaced.
    """
    bad, lines = boilerplate_lines(docs, min_sites, doc_id, text, site)
    bad = written(bad, "boilerplate")
    if bad.count() <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    # copies of a row give each place more than once; places are looked up by runs of TOGETHER
    cut = lines.join(bad, ["k1", "k2"]).groupBy("id", "row", F.floor(F.col("at") / TOGETHER).cast("int").alias("chunk")).agg(F.collect_set("at").alias("cut"))
    cut = cut.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "cut"))).alias("__line_dedup_cut"), F.sum(F.size("cut")).alias("__line_dedup_n"))
    cut = cut.withColumnsRenamed({"id": "__line_dedup_id", "row": "__line_dedup_row"})
    docs = docs.drop("n_lines", "n_cut")
    names = docs.columns
    rows = docs.withColumn("__line_dedup_key", row_key(doc_id, text))
    # rows of one id are told apart by their text, so copies of a row share its cuts
    rows = rows.join(cut, (F.col("__line_dedup_key") == F.col("__line_dedup_row")) & F.col(doc_id).eqNullSafe(F.col("__line_dedup_id")), "left")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text)))).cast("long")
    in_cut = lambda i: F.coalesce(F.array_contains(F.try_element_at("__line_dedup_cut", (i / TOGETHER).cast("int")), i), F.lit(False))
    kept = F.filter(lines_of(F.col(text)), lambda line, i: ~in_cut(i))
    cuts = F.col("__line_dedup_cut").isNotNull()
    if keep_whole:
        cuts = cuts & F.exists(kept, lambda line: _normal(line) != "")
    shown = [F.when(cuts, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in names]
    return rows.select(*shown, n.alias("n_lines"), F.when(cuts, F.col("__line_dedup_n")).otherwise(0).cast("long").alias("n_cut"))
