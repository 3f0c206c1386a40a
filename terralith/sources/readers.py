"""Readers and writers: files to rows of fixed schemas, with a status instead of a guess where something is wrong."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_CSV = "lat double, lon double, water_score double, landslide_score double, seismic_score double, mineral_score double, elevation double"


def read_points_csv(spark: SparkSession, path: str, schema: str = POINT_CSV) -> DataFrame:
    """A CSV with a header by place; rows that are short or don't parse are left out."""
    return spark.read.option("columnPruning", False).csv(path, schema=schema, header=True, mode="DROPMALFORMED", enforceSchema=True)  # every column is parsed, also for a count


def read_keyed_csv(spark: SparkSession, path: str, key: str, fields: list[str]) -> DataFrame:
    """Key and numeric fields of a CSV; a path that doesn't exist is an empty table, what isn't a number is null."""
    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(f, T.DoubleType()) for f in fields)])
    try:
        raw = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    have = set(raw.columns)
    return raw.select(F.col(key), *(F.expr(f"try_cast(`{f}` AS double)").alias(f) if f in have else F.lit(None).cast("double").alias(f) for f in fields)).where(F.col(key).isNotNull())


def write_json(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, nulls kept out."""
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A relational store in `parts` ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})


# GeoJSON ----------------------------------------------------------------------------------

_GEOJSON = "struct<features:array<struct<id:string,type:string,geometry:struct<type:string,coordinates:variant>,properties:variant>>>"


def geojson_features(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per feature: feature_id, kind, geometry_type, coordinates (variant), properties (variant).

    files: text of whole files. A file that isn't a feature collection gives one row with a null feature_id and kind
    "unreadable".
    """
    parsed = F.try_parse_json(F.col(content))
    features = F.try_variant_get(parsed, "$.features", "array<variant>")
    one = files.select("*", F.posexplode_outer(features).alias("place", "f"))
    get = lambda path, kind: F.try_variant_get(F.col("f"), path, kind)
    return one.select(
        *(c for c in files.columns if c != content), "place", F.coalesce(get("$.id", "string"), get("$.properties.id", "string")).alias("feature_id"),
        F.when(F.col("f").isNull(), "unreadable").otherwise(get("$.properties.type", "string")).alias("kind"), get("$.geometry.type", "string").alias("geometry_type"),
        get("$.geometry.coordinates", "variant").alias("coordinates"), get("$.properties", "variant").alias("properties"),
    )


def network_of(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node_id, type, lat, lon, level), pipes (pipe_id, path, diameter_mm, start, finish), areas (area_id,
    rings, outlet). Kinds that aren't known, and features whose geometry doesn't fit, go to none of them."""
    get = lambda c, path, kind: F.try_variant_get(F.col(c), path, kind)
    point = features.where("geometry_type = 'Point'")
    nodes = point.select(F.col("feature_id").alias("node_id"), F.coalesce(get("properties", "$.nodeType", "string"), F.col("kind")).alias("type"), get("coordinates", "$[1]", "double").alias("lat"), get("coordinates", "$[0]", "double").alias("lon"), get("properties", "$.elevation", "double").alias("level"))
    line = features.where("geometry_type = 'LineString'").withColumn("xy", get("coordinates", "$", "array<array<double>>"))
    path = F.transform("xy", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    pipes = line.select(F.col("feature_id").alias("pipe_id"), path.alias("path"), get("properties", "$.diameter", "double").alias("diameter_mm")).where("size(path) > 1").withColumns({"start": F.col("path")[0], "finish": F.element_at("path", -1)})
    area = features.where("geometry_type = 'Polygon'").withColumn("xy", get("coordinates", "$", "array<array<array<double>>>"))
    rings = F.transform("xy", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    areas = area.select(F.col("feature_id").alias("area_id"), rings.alias("rings"), get("properties", "$.outletNodeId", "string").alias("outlet"))
    return nodes, pipes, areas


# Gauges and stations ------------------------------------------------------------------------


def gauge_readings(files: DataFrame, start, end, content: str = "content") -> DataFrame:
    """Gauge, ts, value, status of readings in [start, end) from JSON {items: [{measure, dateTime, value}]}; values
    that aren't numbers or are negative are invalid, and times that repeat are."""
    items = F.from_json(F.col(content), "struct<items:array<struct<measure:string,dateTime:string,value:string>>>")["items"]
    rows = files.select(F.explode(items).alias("i")).select(F.col("i.measure").alias("gauge"), F.try_to_timestamp("i.dateTime").alias("ts"), F.expr("try_cast(i.value AS double)").alias("value"))
    rows = rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    one = rows.groupBy("gauge", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    ok = (F.col("n") == 1) & (F.col("value") >= 0)
    return one.select("gauge", "ts", F.when(ok, F.col("value")).alias("value"), F.when(F.coalesce(ok, F.lit(False)), "available").otherwise("invalid_response").alias("status"))


def station_sections(lines: DataFrame) -> DataFrame:
    """Station, kind, start, end, value, line of files with several sections. lines: file, line, text.

    A section starts with "# station;kind"; its rows are "start;end;value". A blank value is missing, negative rain is
    invalid. The header that a row belongs to is the last one above it in its file.
    """
    from pyspark.sql.window import Window

    head = F.col("text").startswith("#")
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.trim("text") != "").withColumn("head", F.last(F.when(head, F.col("text")), ignorenulls=True).over(w)).where(~head)
    part = F.split("text", ";")
    name = F.split(F.regexp_replace("head", r"^#\s*", ""), ";")
    value = F.expr("try_cast(nullif(trim(split(text, ';')[2]), '') AS double)")
    rows = rows.select("file", F.trim(F.get(name, 0)).alias("station"), F.trim(F.get(name, 1)).alias("kind"), F.try_to_timestamp(F.trim(F.get(part, 0))).alias("start"), F.try_to_timestamp(F.trim(F.get(part, 1))).alias("end"), value.alias("value"), "line")
    bad = F.col("start").isNull() | F.col("end").isNull() | ((F.col("kind") == "rain") & (F.col("value") < 0))
    return rows.withColumns({"status": F.when(F.coalesce(bad, F.lit(False)), "invalid_response").when(F.col("value").isNull(), "missing").otherwise("available"), "value": F.when(~F.coalesce(bad, F.lit(False)), F.col("value"))})


# Rasters and geometry in bytes --------------------------------------------------------------

RASTER_TYPES = {"f32": "<f4", "f64": "<f8", "i16": "<i2", "u8": "u1"}


def raster_rows(files: DataFrame, kind: str, width: int, height: int, missing: float | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """Key, idx, row, col, value of headerless little-endian rasters, gzip or plain. A file of another length gives
    one row with a null idx. `missing` and NaN are null. Rows leave in blocks, so a file's cells never stand as objects."""
    import gzip

    dtype, n = np.dtype(RASTER_TYPES[kind]), width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = raw.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                if len(data) != n * dtype.itemsize:
                    nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *nothing], names=["key", "idx", "row", "col", "value"])
                    continue
                values = np.frombuffer(data, dtype)
                for at in range(0, n, 65_536):
                    v = values[at : at + 65_536].astype(np.float64)
                    idx = np.arange(at, at + len(v))
                    gone = np.isnan(v) | (v == missing if missing is not None else False)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(idx), pa.array((idx // width).astype(np.int32)), pa.array((idx % width).astype(np.int32)), pa.array(v, mask=gone)], names=["key", "idx", "row", "col", "value"])

    return files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInArrow(run, "key string, idx long, row int, col int, value double")


def rgba_classes(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels (r, g, b, a) with the code of their colour: transparent is missing; half transparent or another colour is an error."""
    out = pixels.join(palette.select("r", "g", "b", "code"), ["r", "g", "b"], "left")
    status = F.when(F.col("a") == 0, "missing").when(F.col("a") < 255, "invalid_response").when(F.col("code").isNull(), "invalid_response").otherwise("available")
    return out.withColumns({"status": status, "code": F.when(status == "available", F.col("code"))})


RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


@F.pandas_udf(RINGS)
def wkb_rings(column):
    """Rings of WKB or GeoPackage polygons and multipolygons (the rings of all parts in order); others are null."""
    import struct

    def read(b: bytes, at: int) -> tuple[list, int]:
        order = "<" if b[at] else ">"
        (kind,) = struct.unpack_from(order + "I", b, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        dims += {1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
        kind %= 1000
        (n,) = struct.unpack_from(order + "I", b, at)
        at += 4
        rings = []
        if kind == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", b, at)
                at += 4
                flat = struct.unpack_from(f"{order}{m * dims}d", b, at)
                at += 8 * m * dims
                rings.append([{"x": x, "y": y} for x, y in zip(flat[::dims], flat[1::dims])])
        elif kind == 6:
            for _ in range(n):
                part, at = read(b, at)
                rings += part
        else:
            raise ValueError(kind)
        return rings, at

    def one(b):
        if b is None:
            return None
        b = bytes(b)
        try:
            if b[:2] == b"GP":  # a header with an envelope of 0, 4, 6, 6 or 8 numbers
                b = b[8 + 8 * (0, 4, 6, 6, 8)[b[3] >> 1 & 7] :]
            return read(b, 0)[0]
        except (ValueError, IndexError, struct.error):
            return None

    return column.map(one)


# Artifacts ----------------------------------------------------------------------------------


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, bytes, sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", r"^[a-z]+:/+", "/").alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_content_addressed(df: DataFrame, base: str) -> str:
    """Df as JSON in a folder named by the hash of its rows in order; what is there already is never replaced."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j"))
    # the hash of all rows' hashes by order-free sums in two moduli: no task holds all rows
    word = lambda a: F.conv(F.substring(F.sha2("j", 256), a, 12), 16, 10).cast("decimal(38,0)")
    one = rows.agg(F.sum(word(1)).alias("a"), F.sum(word(13)).alias("b"), F.count(F.lit(1)).alias("n")).select(F.sha2(F.concat_ws(":", "a", "b", "n"), 256).alias("h")).first().h
    path = f"{base.rstrip('/')}/{one}"
    try:
        df.write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return path


def zip_entries_safe(entries: DataFrame, name: str = "name") -> DataFrame:
    """Entries with the reasons for which an archive is refused: leaves its folder, is absolute, repeats."""
    from pyspark.sql.window import Window

    p = F.col(name)
    twice = F.count(F.lit(1)).over(Window.partitionBy(F.lower(p))) > 1
    rules: dict[str, Column] = {"absolute": p.rlike(r"^([/\\]|[A-Za-z]:)"), "leaves_folder": p.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "repeats": twice}
    return entries.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))))


def failed_requests(log: DataFrame) -> DataFrame:
    """One row per asked cell and window length: exactly one answer is available; none, several, or one that
    nobody asked for is an invalid response. log: cell, hours, asked (boolean), answers (long)."""
    bad = F.when(~F.col("asked"), "unexpected").when(F.col("answers") == 0, "omitted").when(F.col("answers") > 1, "duplicate")
    return log.withColumns({"problem": bad, "status": F.when(bad.isNull(), "available").otherwise("invalid_response")})
