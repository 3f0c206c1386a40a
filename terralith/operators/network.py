"""Pipe networks as vertices and edges: snapping, validation, orientation, reachability and no-loss accumulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import METRES_PER_DEGREE, haversine_m
from ..sources.intermediate import written
from .cells import valid
from .evidence import CARRYING, violations

#: Two candidates whose distances differ by less are ambiguous.
SNAP_AMBIGUITY_M = 1e-6


def snap_pairs(points: DataFrame, nodes: DataFrame, tolerance_m: float, ident: str = "point_id") -> DataFrame:
    """ident, node_id, d of all points (ident, lat, lon) and nodes (node_id, lat, lon) within a distance.

    An equi-join on square buckets as wide as the tolerance: a node is put into its own and the eight around. Bands
    of longitude are as wide as the tolerance at the band's own latitude, so nothing near is missed below 89 degrees.
    """
    step = tolerance_m / METRES_PER_DEGREE * 1.01
    by = lambda lat: F.floor(lat / step)
    width = lambda b: step / F.cos(F.radians(F.least(F.abs(b * step) + 2 * step, F.lit(89.0))))
    p = points.select(F.col(ident), F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumn("by", by(F.col("plat")))
    p = p.withColumn("bx", F.floor(F.col("plon") / width(F.col("by"))))
    n = nodes.select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("dy"))
    n = n.withColumn("by", by(F.col("nlat")) + F.col("dy"))
    n = n.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("dx")).withColumn("bx", F.floor(F.col("nlon") / width(F.col("by"))) + F.col("dx"))
    pairs = p.join(n, ["by", "bx"]).withColumn("d", haversine_m("plat", "plon", "nlat", "nlon")).where(F.col("d") <= tolerance_m)
    return pairs.groupBy(ident, "node_id").agg(F.min("d").alias("d"))


def snapped(points: DataFrame, nodes: DataFrame, tolerance_m: float, ident: str = "point_id") -> DataFrame:
    """Each point with the nearest node within a tolerance: node_id, distance_m, status (snapped, ambiguous, none)."""
    pairs = snap_pairs(points, nodes, tolerance_m, ident)
    best = pairs.groupBy(ident).agg(F.min_by("node_id", F.struct("d", "node_id")).alias("node_id"), F.min("d").alias("distance_m"))
    close = pairs.join(best.select(ident, "distance_m"), ident).where(F.col("d") - F.col("distance_m") < SNAP_AMBIGUITY_M).groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    out = points.select(ident).join(best, ident, "left").join(close, ident, "left")
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("snapped")
    return out.select(ident, F.when(status == "snapped", F.col("node_id")).alias("node_id"), "distance_m", status.alias("status"))


# Node types, origins of infrastructure data, and how a municipal register names pipes that carry storm water.
NODE_TYPES = ("inlet", "manhole", "outfall", "junction")
ORIGINS = ("observed_public_record", "user_supplied", "derived", "synthetic_fixture")
IN_SERVICE = {"status": "In bedrijf", "type_leiding": "Hemelwaterriool", "stelsel_type": "Hemelwaterstelsel"}


def in_service(features: DataFrame, **columns: str) -> DataFrame:
    """Features whose status, and type_leiding and stelsel_type where such columns exist, are those of storm water
    pipes in service. columns maps these three names to the table's own; a null never matches."""
    have = {k: columns.get(k, k) for k in IN_SERVICE}
    for name, column in have.items():
        if column in features.columns:
            features = features.where(F.col(column) == IN_SERVICE[name])
    return features


def _fields(df: DataFrame, column: str) -> set[str]:
    kind = df.schema[column].dataType
    return set(kind.names) if hasattr(kind, "names") else set()


def _evidence_broken(df: DataFrame, column: str) -> Column:
    known = ("provider", "dataset", "acquired_at", "observed_at", "window_start", "window_end", "lat", "lon", "cell", "source_quality")
    have = _fields(df, column)
    needs = {"provider": "dataset", "lat": "lon", "window_start": "window_end"}
    names = {k: f"{column}.{k}" for k in known if k in have and needs.get(k, k) in have}
    return F.size(violations(f"{column}.value", f"{column}.status", f"{column}.reason", names)) > 0


def _source_broken(df: DataFrame, column: str) -> Column:
    have = _fields(df, column)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    out = F.col(column).isNull()
    for name in ("provider", "dataset", "source_crs", "output_crs", "transformation", "transformation_version", "source_record_id"):
        if name in have:
            out |= blank(F.col(f"{column}.{name}"))
    if "acquired_at" in have:
        out |= F.try_to_timestamp(f"{column}.acquired_at").isNull()
    if "origin" in have:
        made = F.col(f"{column}.origin") == "synthetic_fixture"
        provider, dataset = F.col(f"{column}.provider") == "synthetic-fixture", F.col(f"{column}.dataset").startswith("fixture:")
        out |= F.coalesce(F.when(made, ~(provider & dataset)).otherwise(provider | dataset), F.lit(True)) | ~F.coalesce(F.col(f"{column}.origin").isin(*ORIGINS), F.lit(False))
    return out


def _broken(df: DataFrame, ident: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule that a row breaks, all rules in one scan."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules)))
    return df.select(F.explode(found).alias("code"), F.col(ident).cast("string").alias("ident"), F.lit(1).cast("long").alias("n"))


def _repeats(df: DataFrame, code: str, ident: Column) -> DataFrame:
    out = df.select(ident.cast("string").alias("ident")).where("ident IS NOT NULL").groupBy("ident").agg(F.count(F.lit(1)).alias("n"))
    return out.where("n > 1").select(F.lit(code).alias("code"), "ident", (F.col("n") - 1).alias("n"))


def issues(nodes: DataFrame, pipes: DataFrame, attachments: DataFrame | None = None, network_id: str | None = None) -> DataFrame:
    """All issues of a network as rows (code, ident, n); none stops another.

    nodes: node_id, type, lat, lon; pipes: pipe_id, node_a, node_b, length_m; attachments: catchment_id, outlet_node_id.
    Further rules apply where their columns exist: nodes' cell (an id of `cells`), elevation (evidence, with a field cell
    it must be the node's) and source; pipes' diameter_mm (null is allowed), path (array of lat, lon), invert_a and
    invert_b (evidence with a unit, metres) and source (structs). An id that repeats is one row, n its further
    occurrences; other issues are one row each. Null ids, which a table can hold, have codes of their own.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    on_globe = lambda lat, lon: F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    node_rules = [("null_node_id", F.col("node_id").isNull()), ("invalid_node_type", ~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))), ("invalid_position", ~on_globe(F.col("lat"), F.col("lon")))]
    if "cell" in nodes.columns:
        node_rules.append(("invalid_h3", ~F.coalesce(valid(F.col("cell")), F.lit(False))))
    if "elevation" in nodes.columns:
        node_rules.append(("invalid_elevation_evidence", _evidence_broken(nodes, "elevation")))
        if "cell" in nodes.columns and "cell" in _fields(nodes, "elevation"):
            node_rules.append(("elevation_h3_mismatch", F.col("elevation.cell").isNotNull() & ~F.col("elevation.cell").eqNullSafe(F.col("cell"))))
    if "source" in nodes.columns:
        node_rules.append(("invalid_node_source", _source_broken(nodes, "source")))
    pipe_rules = [
        ("null_pipe_id", F.col("pipe_id").isNull()), ("self_loop", F.col("node_a") == F.col("node_b")),
        ("missing_pipe_endpoint", F.col("__a").isNull() | F.col("__b").isNull()), ("invalid_pipe_length", ~(finite(F.col("length_m")) & (F.col("length_m") > 0))),
    ]
    if "diameter_mm" in pipes.columns:
        pipe_rules.append(("invalid_pipe_diameter", F.col("diameter_mm").isNotNull() & ~(finite(F.col("diameter_mm")) & (F.col("diameter_mm") > 0))))
    if "path" in pipes.columns:
        pipe_rules.append(("invalid_pipe_path", F.col("path").isNull() | (F.size("path") < 2) | F.exists("path", lambda p: ~on_globe(p["lat"], p["lon"]))))
    for end in ("invert_a", "invert_b"):
        if end in pipes.columns:
            unit = F.coalesce(F.col(f"{end}.unit") != "m", F.lit(True)) if "unit" in _fields(pipes, end) else F.lit(False)
            pipe_rules.append(("invalid_pipe_invert_evidence", _evidence_broken(pipes, end) | unit))
    if "source" in pipes.columns:
        pipe_rules.append(("invalid_pipe_source", _source_broken(pipes, "source")))
    ids = nodes.select("node_id").where("node_id IS NOT NULL").distinct()
    ends = pipes
    for side in "ab":
        ends = ends.join(ids.select(F.col("node_id").alias(f"node_{side}"), F.lit(True).alias(f"__{side}")), f"node_{side}", "left")
    pair = F.concat_ws("|", F.least("node_a", "node_b"), F.greatest("node_a", "node_b"))
    whole = nodes.limit(1).agg(F.count(F.lit(1)).alias("__n"), F.lit("network").alias("network"))
    unnamed = network_id is not None and not network_id.strip()
    found = [
        _broken(whole, "network", [("empty_network_id", F.lit(unnamed)), ("empty_network", F.col("__n") == 0)]), _broken(nodes, "node_id", node_rules), _repeats(nodes, "duplicate_node_id", F.col("node_id")),
        _broken(ends, "pipe_id", pipe_rules), _repeats(pipes, "duplicate_pipe_id", F.col("pipe_id")), _repeats(pipes, "duplicate_pipe_endpoints", F.when(F.col("node_a").isNotNull() & F.col("node_b").isNotNull(), pair)),
    ]
    if attachments is not None:
        lost = attachments.join(ids, F.col("outlet_node_id") == ids.node_id, "left_anti")
        found += [_repeats(attachments, "duplicate_catchment_attachment", F.col("catchment_id")), _broken(lost, "catchment_id", [("missing_catchment_outlet", F.lit(True))])]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def direction(level_a: Column, level_b: Column, length: Column, min_drop: float) -> Column:
    """struct(status, reason, downhill (a_to_b, b_to_a), drop_m, grade) of a pipe from the levels at its ends.

    A missing or non-finite level is unknown; a drop of 0, or one below the least drop by more than the tolerance, is
    ambiguous.
    """
    tol = min(1e-6, 0.01 * min_drop)
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    drop = F.abs(level_a - level_b)
    status = F.when(level_a.isNull() | level_b.isNull(), "unknown").when(odd(level_a) | odd(level_b), "unknown").when((drop == 0) | (drop + tol < min_drop), "ambiguous").otherwise("known")
    reason = F.when(level_a.isNull() | level_b.isNull(), "missing level").when(odd(level_a) | odd(level_b), "invalid level").when(status == "ambiguous", "drop too small")
    known = status == "known"
    return F.struct(status.alias("status"), reason.alias("reason"), F.when(known, F.when(level_a > level_b, "a_to_b").otherwise("b_to_a")).alias("downhill"), F.when(known, drop).alias("drop_m"), F.when(known & (length > 0), drop / length).alias("grade"))


def oriented(pipes: DataFrame, nodes: DataFrame, level: str = "level", min_drop: float = 0.1) -> DataFrame:
    """Pipes with direction, and from_node, to_node where it is known."""
    for side in "ab":
        pipes = pipes.join(nodes.select(F.col("node_id").alias(f"node_{side}"), F.col(level).alias(f"level_{side}")), f"node_{side}", "left")
    out = pipes.withColumn("direction", direction(F.col("level_a"), F.col("level_b"), F.col("length_m"), min_drop))
    down = F.col("direction.downhill")
    return out.withColumns({"from_node": F.when(down == "a_to_b", F.col("node_a")).when(down == "b_to_a", F.col("node_b")), "to_node": F.when(down == "a_to_b", F.col("node_b")).when(down == "b_to_a", F.col("node_a"))})


def legacy_direction(pipes: DataFrame, level_a: str = "level_a", level_b: str = "level_b") -> DataFrame:
    """Uphill pipes are turned; a slope under 0.1 % is unknown."""
    slope = (F.col(level_a) - F.col(level_b)) / F.col("length_m")
    known = F.abs(slope) >= 0.001
    return pipes.withColumns({"slope": slope, "flow": F.when(~known | slope.isNull(), "unknown").when(slope > 0, "forward").otherwise("reversed")})


def direction_counts(pipes: DataFrame) -> DataFrame:
    """A21."""
    return pipes.groupBy(F.col("direction.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def upstream_of(edges: DataFrame, outfalls: DataFrame) -> DataFrame:
    """outfall_id, node_id, steps: every node from which an outfall is reached along known edges, by rounds that
    add only new pairs; cycles end by themselves. edges: from_node, to_node."""
    edges = written(edges.where("from_node IS NOT NULL AND to_node IS NOT NULL").select("from_node", "to_node").distinct())
    new = written(outfalls.select(F.col("node_id").alias("outfall_id"), "node_id", F.lit(0).alias("steps")).distinct())
    seen, step = new, 0
    while True:
        step += 1
        next_ = new.join(edges, new.node_id == edges.to_node).select("outfall_id", F.col("from_node").alias("node_id"), F.lit(step).alias("steps")).distinct()
        new = written(next_.join(seen, ["outfall_id", "node_id"], "left_anti"))
        if not new.head(1):
            return seen
        seen = seen.unionByName(new)
        if step % 8 == 0:
            seen = written(seen)


def outfall_paths(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (outfall_id, kind, ident) of what belongs to each outfall: known_upstream_node, known_upstream_pipe (ends
    at the outfall or at a node upstream), unresolved_boundary_pipe (touches one of them, its direction isn't known) and
    outward_known_pipe (leaves the outfall). pipes: oriented()."""
    pipes = written(pipes.select("pipe_id", "node_a", "node_b", "from_node", "to_node", (F.col("direction.status") == "known").alias("known")))
    outfalls = nodes.where("type = 'outfall'").select("node_id").distinct()
    reach = written(upstream_of(pipes.where("known"), outfalls).select("outfall_id", "node_id"))
    kind = lambda df, name, ident: df.select("outfall_id", F.lit(name).alias("kind"), F.col(ident).alias("ident"))
    up = reach.join(pipes.where("known").select(F.col("to_node").alias("node_id"), "pipe_id"), "node_id")
    touch = pipes.where("NOT known").select("pipe_id", F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node_id"))
    out = outfalls.select(F.col("node_id").alias("outfall_id")).join(pipes.where("known").select(F.col("from_node").alias("outfall_id"), "pipe_id"), "outfall_id")
    return (
        kind(reach.where("node_id <> outfall_id"), "known_upstream_node", "node_id").unionByName(kind(up, "known_upstream_pipe", "pipe_id"))
        .unionByName(kind(reach.join(touch, "node_id").select("outfall_id", "pipe_id").distinct(), "unresolved_boundary_pipe", "pipe_id")).unionByName(kind(out, "outward_known_pipe", "pipe_id"))
    )


def outfall_connectivity(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per outfall its status and the counts of what outfall_paths() found. A known pipe out of an outfall is a
    conflict, whatever else there is; then known paths count, then unresolved pipes; else the outfall is isolated."""
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}s")
    kinds = ("known_upstream_node", "known_upstream_pipe", "unresolved_boundary_pipe", "outward_known_pipe")
    per = nodes.where("type = 'outfall'").select(F.col("node_id").alias("outfall_id")).distinct().join(paths, "outfall_id", "left").groupBy("outfall_id").agg(*map(n, kinds))
    some = lambda kind: F.col(f"n_{kind}s") > 0
    status = F.when(some(kinds[3]), "direction_conflict").when(some(kinds[1]), "known_upstream_path").when(some(kinds[2]), "blocked_by_unresolved_direction").otherwise("isolated")
    return per.select("outfall_id", status.alias("status"), *(f"n_{k}s" for k in kinds))


def connectivity_counts(paths: DataFrame, states: DataFrame) -> DataFrame:
    """Outfalls by status, and distinct nodes, pipes and boundary pipes of all; nodes and pipes of known paths include
    those of outfalls with a conflict, and each outfall that something flows to."""
    one = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("ident")))
    ends = paths.where("kind = 'known_upstream_pipe'").select("outfall_id", F.lit("known_upstream_node").alias("kind"), F.col("outfall_id").alias("ident")).distinct()
    seen = paths.unionByName(ends).agg(one("known_upstream_node").alias("n_nodes"), one("known_upstream_pipe").alias("n_pipes"), one("unresolved_boundary_pipe").alias("n_boundary_pipes"))
    per = states.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("outfalls "), "status").alias("what"), "n")
    return per.unionByName(seen.select(F.explode(F.create_map(*(x for c in ("n_nodes", "n_pipes", "n_boundary_pipes") for x in (F.lit(c), F.col(c))))).alias("what", "n")))


def forest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, own, total, terminal, cyclic, steps (to the terminal): what accumulates at each node of a graph in which every
    node has one way out at most. edges: node_id, down; sources: node_id, own (every node once).

    Pointer doubling: total covers all nodes upstream within 2 ** k steps, each once; jump leads 2 ** k steps down.
    Rows stay one a node. Nodes whose jump doesn't end after log2(nodes) rounds run into a cycle: no total. Nodes that
    have ended are kept out of the join by jump, where all of them would meet at null. Both joins are hinted, as the
    tables are as long as the graph: none is sent through the driver.
    """
    start = sources.join(edges.where("down IS NOT NULL").groupBy("node_id").agg(F.min("down").alias("jump")).hint("merge"), "node_id", "left")
    state = written(start.select("node_id", "own", "jump", F.col("own").alias("total"), F.coalesce("jump", "node_id").alias("terminal"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    rounds = max(1, state.count().bit_length() + 1)
    for _ in range(rounds):
        if not state.where("jump IS NOT NULL").head(1):
            break
        going = state.where("jump IS NOT NULL")
        add = going.groupBy(F.col("jump").alias("node_id")).agg(F.sum("total").alias("__add"))
        far = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("__far"), F.col("terminal").alias("__end"), F.col("steps").alias("__steps"))
        moved = going.join(far.hint("merge"), "jump", "left").select("node_id", "own", F.col("__far").alias("jump"), "total", F.coalesce("__end", "terminal").alias("terminal"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"))
        moved = moved.unionByName(state.where("jump IS NULL")).join(add.hint("merge"), "node_id", "left")
        state = written(moved.select("node_id", "own", "jump", (F.col("total") + F.coalesce("__add", F.lit(0.0))).alias("total"), "terminal", "steps"))
    # what still jumps is upstream of a cycle or on it; what such a node leads to has no total either
    cyclic = F.col("jump").isNotNull()
    return state.select("node_id", "own", F.when(~cyclic, F.col("total")).alias("total"), F.when(~cyclic, F.col("terminal")).alias("terminal"), cyclic.alias("cyclic"), F.when(~cyclic, F.col("steps")).alias("steps"))


def accumulation(pipes: DataFrame, node_sources: DataFrame) -> tuple[str, DataFrame | None]:
    """(status, per-node totals): checks in order that all directions are known, sources valid, no node has two
    ways out, and no cycle; only then volumes. pipes: oriented(); node_sources: node_id, value, status."""
    if pipes.where("direction.status <> 'known'").head(1):
        return "incomplete_direction", None
    if node_sources.where(~F.coalesce(F.col("status").isin(*CARRYING) & F.col("value").isNotNull(), F.lit(False))).head(1):
        return "incomplete_evidence", None
    if pipes.groupBy("from_node").agg(F.count_distinct("to_node").alias("n")).where("n > 1").head(1):
        return "unsupported_divergence", None
    totals = forest(pipes.select(F.col("from_node").alias("node_id"), F.col("to_node").alias("down")), node_sources.select("node_id", F.col("value").cast("double").alias("own")))
    if totals.where("cyclic").head(1):
        return "cyclic", None
    return "complete", totals


def mass_balance(totals: DataFrame) -> DataFrame:
    """What went in, what arrived at terminals, and whether the difference is within max(1e-9, 1e-12 * in)."""
    out = totals.agg(F.sum("own").alias("volume_in"), F.sum(F.when(F.col("terminal") == F.col("node_id"), F.col("total"))).alias("volume_out"))
    return out.withColumn("balanced", F.abs(F.col("volume_in") - F.col("volume_out")) <= F.greatest(F.lit(1e-9), F.abs("volume_in") * 1e-12))


def damped_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 20, stop: float = 0.01) -> DataFrame:
    """node_id, load: local load plus damped inflow, decaying with length, until it changes by less than stop.
    edges: from_node, to_node, length_m, known; nodes: node_id, own."""
    edges = written(edges.select("from_node", "to_node", (F.exp(-0.001 * F.col("length_m")) * F.when(F.col("known"), 1.0).otherwise(0.5) * 0.5).alias("k")))
    state = written(nodes.select("node_id", "own", F.col("own").alias("load")))
    for _ in range(rounds):
        inflow = edges.join(state.select(F.col("node_id").alias("from_node"), "load"), "from_node").groupBy(F.col("to_node").alias("node_id")).agg(F.sum(F.col("load") * F.col("k")).alias("__in"))
        step = written(state.join(inflow, "node_id", "left").select("node_id", "own", F.col("load").alias("was"), (F.col("own") + F.coalesce("__in", F.lit(0.0))).alias("load")))
        change = step.agg(F.max(F.abs(F.col("load") - F.col("was")))).first()[0]
        state = step.select("node_id", "own", "load")
        if change is None or change < stop:
            break
    return state.select("node_id", "load")


def attached(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Inflow records (record_id, code) on pipes by exact alias (alias, pipe_id): pipe_id, status, reason."""
    per = aliases.groupBy(F.col("alias").alias("code")).agg(F.count_distinct("pipe_id").alias("n"), F.min("pipe_id").alias("pipe_id"))  # a code's pipes are counted before any record meets them
    hit = rows.select("record_id", "code").distinct().join(per, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 1, "available").when(F.col("n") == 0, "missing").otherwise("invalid_response")
    return hit.select("record_id", "code", F.when(F.col("n") == 1, F.col("pipe_id")).alias("pipe_id"), status.alias("status"), F.when(F.col("n") == 0, "no pipe has this code").when(F.col("n") > 1, "several pipes have this code").alias("reason"))
