"""The data cube: points (cell, ts, layer, variable) -> value in long form, on Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.intermediate import written

KEY = ("cell", "ts", "layer", "variable")
SERIES = ("cell", "layer", "variable")
POINT = T.StructType([
    T.StructField("cell", T.StringType(), False), T.StructField("ts", T.TimestampType(), False), T.StructField("layer", T.StringType(), False),
    T.StructField("variable", T.StringType(), False), T.StructField("value_num", T.DoubleType()), T.StructField("value_str", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("source", T.StringType()), T.StructField("quality", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("ingest_seq", T.LongType()),
])

# Fields of the wide row that layer:variable keys stand for; of several points for one, the latest wins, then the first listed.
FEATURE_OF = {
    "DEM:elevation": "elevation", "DEM:slope": "slope", "DEM:aspect": "aspect", "DEM:curvature": "curvature", "DEM:roughness": "roughness",
    "ELSUS:class": "elsus_class", "ELSUS:elsus_class": "elsus_class",
    "PGA:pga": "hazard_pga", "PGA:pga_475yr": "hazard_pga", "PGV:pgv": "hazard_pgv", "PGV:pgv_475yr": "hazard_pgv", "SEISMIC:pga": "hazard_pga", "SEISMIC:pgv": "hazard_pgv",
    "CLC:class": "clc_class", "CLC:clc_class": "clc_class", "LANDCOVER:class": "clc_class",
    "RAIN:rain_24h": "rain24h", "RAIN:rain_48h": "rain48h", "RAIN:rain_72h": "rain72h", "WEATHER:rain_24h": "rain24h", "WEATHER:rain_48h": "rain48h", "WEATHER:rain_72h": "rain72h",
    "SOIL:moisture": "soil_moisture", "SOIL:permeability": "permeability", "SNOW:swe": "swe", "GEOLOGY:lithology": "lithology", "GEOLOGY:permeability": "permeability",
}


def matching(points: DataFrame, cells: Sequence[str] | DataFrame | None = None, layers: Sequence[str] = (), variables: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """AND of the lists that aren't empty and of a time range closed at both ends. Cells in a table are semi-joined."""
    if isinstance(cells, DataFrame):
        points = points.join(cells.select("cell").distinct(), "cell", "left_semi")
    elif cells:
        points = points.where(F.col("cell").isin(*cells))
    for name, some in (("layer", layers), ("variable", variables)):
        if some:
            points = points.where(F.col(name).isin(*some))
    if start is not None:
        points = points.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        points = points.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return points


def near_time(ts: Column, seconds: float) -> Column:
    """Within a tolerance before or after."""
    return F.abs(F.unix_micros("ts") - F.unix_micros(ts)) <= int(seconds * 1e6)


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Of each key the row with the greatest ingest_seq. One aggregation; a null sequence is the oldest."""
    every = points.unionByName(new, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in KEY]
    content = F.xxhash64(F.to_json(F.struct(*rest)))  # of equal numbers always the same row
    last = F.max_by(F.struct(*rest), F.struct(F.coalesce("ingest_seq", F.lit(-1)).alias("s"), content.alias("h")))
    return every.groupBy(*KEY).agg(last.alias("p")).select(*KEY, "p.*").select(*every.columns)


def delete(points: DataFrame, cells: Sequence[str] = (), layers: Sequence[str] = (), variables: Sequence[str] = (), start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes. Empty lists are ignored; without any criterion it raises, it never wipes."""
    if not (cells or layers or variables or start is not None or end is not None):
        raise ValueError("delete needs a criterion")
    gone = F.lit(True)
    for name, some in (("cell", cells), ("layer", layers), ("variable", variables)):
        if some:
            gone &= F.col(name).isin(*some)
    if start is not None:
        gone &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end is not None:
        gone &= F.col("ts") <= F.lit(end).cast("timestamp")
    gone = F.coalesce(gone, F.lit(False))
    return points.where(~gone), points.where(gone)


def latest(points: DataFrame, cube: DataFrame | None = None, tolerance_s: float | None = None) -> DataFrame:
    """Of each series the last point; with a tolerance only those that near to the last time of the whole cube.

    An aggregation with a partial step: a hot series is reduced before the shuffle. Equal times: the greatest ingest_seq.
    """
    rest = [c for c in points.columns if c not in SERIES]
    if tolerance_s is not None:
        last = (cube if cube is not None else points).agg(F.max("ts").alias("t")).first().t  # one value
        points = points.where(near_time(F.lit(last), tolerance_s)) if last is not None else points
    order = F.struct("ts", F.coalesce("ingest_seq", F.lit(-1)).alias("s"))
    return points.groupBy(*SERIES).agg(F.max_by(F.struct(*rest), order).alias("p")).select(*SERIES, "p.*").select(*points.columns)


def at_time(points: DataFrame, when, tolerance_s: float = 0.0) -> DataFrame:
    """Snapshot at a time: equal, or of each series the nearest within the tolerance (the earlier of two)."""
    t = F.lit(when).cast("timestamp")
    rest = [c for c in points.columns if c not in SERIES]
    found = points.where(near_time(t, tolerance_s))
    return found.groupBy(*SERIES).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.unix_micros("ts") - F.unix_micros(t)).alias("d"), "ts")).alias("p")).select(*SERIES, "p.*").select(*points.columns)


def as_of(points: DataFrame, times: DataFrame, max_age_s: float | None = None) -> DataFrame:
    """J21 (an extension): each request (cell, layer, variable, at) with the last point at or before it.

    Requests and points share one shuffle and one sort by series and time; no pairs are made.
    """
    asked = times.select(*SERIES, F.col("at").alias("ts"), F.lit(1).alias("__ask"), F.lit(None).cast("double").alias("value_num"))
    both = points.select(*SERIES, "ts", F.lit(0).alias("__ask"), "value_num").unionByName(asked)
    w = Window.partitionBy(*SERIES).orderBy("ts", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__ask") == 0, F.struct("ts", "value_num")), ignorenulls=True).over(w)
    out = both.withColumn("__seen", seen).where("__ask = 1").select(*SERIES, F.col("ts").alias("at"), F.col("__seen.ts").alias("point_ts"), F.col("__seen.value_num").alias("value_num"))
    if max_age_s is not None:
        old = F.unix_micros("at") - F.unix_micros("point_ts") > int(max_age_s * 1e6)
        out = out.withColumns({c: F.when(~F.coalesce(old, F.lit(True)), F.col(c)) for c in ("value_num", "point_ts")})
    return out


def features(snapshot: DataFrame, mapping: dict[str, str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One wide row per cell; keys without a field stay in `extra`. With `cells` every requested cell
    appears, with nulls where the cube has nothing. Of several points for one field the latest wins, then the mapping's order."""
    mapping = FEATURE_OF if mapping is None else mapping
    fields = list(dict.fromkeys(mapping.values()))
    key = F.concat_ws(":", "layer", "variable")
    place = {k: i for i, k in enumerate(mapping)}
    names = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    ranks = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))
    rows = snapshot.select("cell", "ts", key.alias("k"), "value_num", "value_str").withColumn("field", F.try_element_at(names, F.col("k"))).withColumn("rank", -F.coalesce(F.try_element_at(ranks, F.col("k")), F.lit(0)))
    pick = lambda f, v: F.max_by(F.when(F.col("field") == f, F.col(v)), F.when((F.col("field") == f) & F.col(v).isNotNull(), F.struct("ts", "rank")))
    extra = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNull(), F.struct("k", F.coalesce(F.col("value_num").cast("string"), F.col("value_str")).alias("v"))))))
    wide = rows.groupBy("cell").agg(*(pick(f, "value_str" if f == "lithology" else "value_num").alias(f) for f in fields), extra.alias("extra"))
    return wide if cells is None else cells.select("cell").distinct().join(wide, "cell", "left")


def missing_variables(points: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per cell the required layer:variable keys that it doesn't have."""
    have = F.collect_set(F.concat_ws(":", "layer", "variable"))
    return points.groupBy("cell").agg(F.array_sort(F.array_except(F.array(*map(F.lit, required)), have)).alias("missing"))


def downsample(points: DataFrame, n: int) -> DataFrame:
    """Of each series the points number floor(i * (m / n)), i < n, by time; series of n points or fewer stay whole.

    The index is computed in double arithmetic. One sort per series; a row decides for itself whether it is taken.
    """
    w = Window.partitionBy(*SERIES)
    rows = points.withColumns({"__k": F.row_number().over(w.orderBy("ts", "ingest_seq")) - 1, "__m": F.count(F.lit(1)).over(w)})
    step = F.col("__m") / F.lit(float(n))
    about = F.floor(F.col("__k") / step).cast("int")
    # k is taken if one of the i around k / step leads to it
    taken = F.exists(F.array(*(about + d for d in (-1, 0, 1, 2))), lambda i: (i >= 0) & (i < n) & (F.floor(i * step) == F.col("__k")))
    return rows.where((F.col("__m") <= n) | taken).drop("__k", "__m")


def series_stats(points: DataFrame) -> DataFrame:
    """Per series count, min, max, mean, upper median sorted[n / 2], population deviation; numbers only.

    The upper median is exact: a percentile over the counts of the distinct values.
    """
    rows = points.where(F.col("value_num").isNotNull() & ~F.isnan("value_num"))
    by_value = rows.groupBy(*SERIES, "value_num").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*SERIES)
    upto = F.sum("n").over(w.orderBy("value_num").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    median = by_value.withColumns({"upto": upto, "total": total}).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*SERIES).agg(F.min("value_num").alias("median"))
    stats = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.min("value_num").alias("min"), F.max("value_num").alias("max"), F.avg("value_num").alias("mean"), F.stddev_pop("value_num").alias("stddev"))
    return stats.join(median, list(SERIES))


def time_series(points: DataFrame) -> DataFrame:
    """Per series its points in time order, for series that fit a row; use the long form beyond that."""
    return points.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("ts", "value_num", "quality"))).alias("points"))


def cube_metadata(points: DataFrame) -> DataFrame:
    """One row: points, cells, layers, variables, first and last time."""
    return points.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("cell").alias("n_cells"), F.array_sort(F.collect_set("layer")).alias("layers"),
        F.array_sort(F.collect_set("variable")).alias("variables"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


class Cube:
    """A cube stored as Parquet, partitioned by layer and by day (of UTC, counted from 1970). Keys must not be null.

    A write or delete reads and replaces only the partitions it touches; all other files stay as they are. Each
    partition's new files are complete before they take the place of the old ones; partitions change one after the other,
    so a reader meanwhile may see some changed and some not, and a driver lost between a removal and its rename leaves that
    partition in the staging folder. One writer at a time.
    """

    PARTS = ("layer", "day")
    #: So many touched partitions, counted, are sent to every task; more are joined by shuffle.
    MOST_SENT = 10_000

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def points(self, start=None, end=None) -> DataFrame:
        """All points; with times (both inclusive) only the days between are read, and only points between returned."""
        return matching(self._stored(start, end), start=start, end=end).drop("day")

    @staticmethod
    def _day(ts: Column) -> Column:
        return F.floor(F.unix_seconds(ts) / 86_400).cast("int")

    def _stored(self, start=None, end=None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*POINT.fields, T.StructField("day", T.IntegerType())])).parquet(self.path)
        if start is not None:
            rows = rows.where(F.col("day") >= self._day(F.lit(start).cast("timestamp")))
        if end is not None:
            rows = rows.where(F.col("day") <= self._day(F.lit(end).cast("timestamp")))
        return rows

    def _within(self, parts: DataFrame, n: int) -> DataFrame:
        """The stored points of n partitions."""
        keys = parts.select(*self.PARTS)
        return self._stored().join(F.broadcast(keys) if n <= self.MOST_SENT else keys, list(self.PARTS), "left_semi")

    def _overwrite(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.PARTS).parquet(self.path)

    def write(self, new: DataFrame) -> None:
        """Upsert on the key. Columns that POINT doesn't have are not stored; a null in the key raises."""
        # written first, so that the partitions to replace and the rows put there come from the same points
        new = written(new.select(*(F.col(c) for c in POINT.names if c in new.columns)), "points").withColumn("day", self._day(F.col("ts")))
        parts = new.select(*self.PARTS).distinct()
        some = new.agg(F.count_if(F.greatest(*(F.col(c).isNull() for c in KEY))).alias("bad"), F.count(F.lit(1)).alias("n")).first()
        if some.bad:
            raise ValueError(f"{some.bad} points have a null in their key")
        if not some.n:
            return
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        old = self._within(parts, parts.count()) if there else new.limit(0)
        self._overwrite(upsert(old.drop("day"), new.drop("day")).withColumn("day", self._day(F.col("ts"))))

    def delete(self, start=None, end=None, **criteria) -> int:
        """The number of points that went."""
        file = F.min(F.col("_metadata.file_path"))
        gone = delete(self._stored(start, end), start=start, end=end, **criteria)[1]
        parts = written(gone.groupBy(*self.PARTS).agg(F.count(F.lit(1)).alias("n"), file.alias("file")), "touched")
        found = parts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).first()
        if not found.n:
            return 0
        touched = self._within(parts, found.parts)
        empty = parts.join(touched.groupBy(*self.PARTS).agg(F.count(F.lit(1)).alias("all")), list(self.PARTS)).where("n = all")
        folders = [r.file for r in empty.select("file").collect()]  # one name a partition, whose folder goes
        self._overwrite(delete(touched, start=start, end=end, **criteria)[0])
        jvm = self.spark.sparkContext._jvm
        for name in folders:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(name)).getParent()
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return found.n
