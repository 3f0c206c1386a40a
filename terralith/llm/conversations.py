"""Repair of conversation structure: the cheapest edits after which roles alternate, `(s?(ua)+)?`.

A rank-compressed dynamic program. A macro edit is a run of inserts and then one edit of a turn; the letters of macro
edits (D, IK, IIR, ...) are a prefix-free code, so that the audits of as many turns compare letter by letter before
either ends. A layer therefore holds for each state of the role automaton a cost, the rank of its audit among the
layer's, and the state it came from; audits are spelled out afterwards, along those pointers.

The program composes: what a run of turns costs from each state to each state, with the ranks, is again an item of the
same program. A conversation is cut into segments of at most SEGMENT turns, whichever tasks hold them, segments are
combined SEGMENT at a time until one is left, and the states chosen at the top go down again to each segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Of so many remainders those that damage a row, by what they do.
DAMAGES = 20
DROP, EMPTY, STRIP, REPEAT, USER = range(5)
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
_GAP = " \t\n\x0b\x0c\r"

#: Rows of a segment, and segments of a segment of segments.
SEGMENT = 4096
#: States of the role automaton: nothing yet, after a system turn, after a user's, after an assistant's.
START, S, U, A = range(4)
#: Faults of a turn as the program sees them: none, truncated, must go.
SOUND, CUT_OFF, GONE = range(3)
_NEVER = 1 << 55
_ROLES = {"s": 0, "u": 1, "a": 2}
_NAMES = {U: "user", A: "assistant"}


def _after(state: int, initial: str) -> int | None:
    """The state after a turn of that role, or None where the roles would no longer do."""
    if initial == "s":
        return S if state == START else None
    if initial == "u":
        return U if state != U else None
    return A if state == U else None


def _turned(state: int) -> int:
    """After an inserted or renamed turn: its role is the one that may follow."""
    return A if state == U else U


def _macros() -> dict[tuple[int, int], list]:
    """(role's place, fault): from each state to each, the cheapest macro edit as (cost, letters), of equals the least
    letters. Runs of up to two inserts reach every state; longer ones repeat a state."""
    out = {}
    for role, fault in product(range(4), range(3)):
        best = [[None] * 4 for _ in range(4)]
        for begin, run in product(range(4), range(3)):
            at = begin
            for _ in range(run):
                at = _turned(at)
            penalty = TRUNCATED_COST if fault == CUT_OFF else 0
            ends = [("D", at, 0)]
            if fault != GONE:
                kept = _after(at, "sua"[role]) if role < 3 else None
                ends += [("R", _turned(at), penalty)] + ([("K", kept, penalty)] if kept is not None else [])
            for letter, end, more in ends:
                macro = (run * COSTS["I"] + COSTS[letter] + more, "I" * run + letter)
                if best[begin][end] is None or macro < best[begin][end]:
                    best[begin][end] = macro
        out[role, fault] = best
    return out


MACROS = _macros()
CODES = sorted({m[1] for best in MACROS.values() for row in best for m in row if m})
#: By kind (3 * role's place + fault), state before, state after: the macro's cost, its place among CODES.
KIND_COSTS = np.array([[[m[0] if m else _NEVER for m in row] for row in MACROS[k]] for k in sorted(MACROS)], np.int64)
KIND_RANKS = np.array([[[CODES.index(m[1]) if m else 0 for m in row] for row in MACROS[k]] for k in sorted(MACROS)], np.int64)
#: A run of inserts after the last turn, by state: what it costs, its letters.
FINAL = {START: (0, ""), A: (0, ""), U: (COSTS["I"], "I"), S: (2 * COSTS["I"], "II")}


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` decides. Null roles, texts, and ids and
    turns in that string are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", spaced(conv_id), spaced(turn)).cast("binary")) % DAMAGES
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), how.alias("how"))
    body = F.when(F.col("how") == EMPTY, F.lit("")).when(F.col("how") == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("how") == DROP, 0).when(F.col("how") == REPEAT, 2).otherwise(1)
    own = own.select("conv_id", "turn", F.when(F.col("how") == USER, F.lit("user")).otherwise(F.col("role")).alias("role"), body.alias("text"), times.alias("times"))
    return own.where("times > 0").select("conv_id", "turn", "role", "text", "times")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in order with their fault: conv_id, turn, role, text, fault (blank, duplicate, truncated or null), kind, at.

    rows: conv_id, turn, role, text, times. Rows stand by turn (nulls first), of one turn by role and text. `at` grows
    in that order, over all tasks: the rows are sorted by range, so a conversation of any length is spread.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    seen = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # nulls first
    first = same.groupBy("conv_id", F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("same")).agg(F.min(seen).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    own = same.withColumn("same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    own = own.join(first.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (own["same"] == first["same"]), "left").drop(first["same"])
    own = own.withColumn("again", F.coalesce(seen > F.col("first"), F.lit(False)))
    own = own.select("conv_id", "turn", "role", "text", "again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    solid = F.rtrim("text", F.lit(_GAP))
    blank = F.length(solid) == 0
    fault = F.when(blank, "blank").when(F.col("again") | (F.col("copy") > 1), "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    own = own.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))
    place = F.element_at(F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv)), F.substring("role", 1, 1))
    seen_as = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT_OFF).otherwise(SOUND)
    own = written(own.withColumn("kind", (3 * F.coalesce(place, F.lit(3)) + seen_as).cast("int")), "turns")
    order = ["conv_id", "turn", "role", "text", "copy"]
    return written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("copy"), "turns")


# The program ----------------------------------------------------------------------------


def _advance(cost: np.ndarray, rank: np.ndarray, item_cost: np.ndarray, item_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One layer further. cost, rank: (runs, states entered, states); items: (runs, states, states). Also the state
    each came from. Ranks of one entry's states never tie: equal audits from one state end in one state."""
    sums = np.minimum(cost[:, :, :, None] + item_cost[:, None], _NEVER)
    came = (sums * 4 + rank[:, :, :, None]).argmin(2)
    new = np.take_along_axis(sums, came[:, :, None], 2)[:, :, 0]
    of = np.take_along_axis(rank, came, 2)
    own = np.take_along_axis(np.broadcast_to(item_rank[:, None], sums.shape), came[:, :, None], 2)[:, :, 0]
    # reachable states first, by the audit before them and then by the last macro
    key = (new >= _NEVER) * (1 << 20) + of * (1 << 10) + own
    return new, key.argsort(2, kind="stable").argsort(2, kind="stable"), came.astype(np.int8)


def _program(sizes: np.ndarray, item, entries: np.ndarray, keep: bool = False):
    """Runs of items together, layer by layer. item(place) gives costs and ranks of items at those places, the runs being
    end to end. entries: (runs, k) states that each run is entered in. With keep, also the states that layers came from."""
    heads = np.cumsum(sizes) - sizes
    by = np.argsort(-sizes, kind="stable")
    cost = np.full((*entries.shape, 4), _NEVER, np.int64)
    np.put_along_axis(cost, entries[:, :, None], 0, 2)
    rank = np.broadcast_to(np.arange(4), cost.shape).copy()
    came = np.zeros((int(sizes.sum()), entries.shape[1], 4), np.int8) if keep else None
    left = -sizes[by]
    for layer in range(int(sizes.max(initial=0))):
        live = by[: np.searchsorted(left, -layer, "left")]
        place = heads[live] + layer
        cost[live], rank[live], back = _advance(cost[live], rank[live], *item(place))
        if keep:
            came[place] = back
    return cost, rank, came


def _path(sizes: np.ndarray, came: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each item of each run, entered in its only entry and left in `ends`."""
    heads = np.cumsum(sizes) - sizes
    by = np.argsort(-sizes, kind="stable")
    before, after = np.zeros(int(sizes.sum()), np.int8), np.zeros(int(sizes.sum()), np.int8)
    now = ends.astype(np.int8).copy()
    left = -sizes[by]
    for layer in range(int(sizes.max(initial=0)) - 1, -1, -1):
        live = by[: np.searchsorted(left, -layer, "left")]
        place = heads[live] + layer
        after[place] = now[live]
        before[place] = now[live] = came[place, 0, now[live]]
    return before, after


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Sizes of runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64)
    cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return np.diff(np.r_[cut, n])


def _matrices(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, 2, 4, 4)


def _whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Sorted batches again, cut only between runs of equal keys."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0) if batch.num_rows > 1 else np.zeros(0, bool)
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        part = pa.Table.from_batches([batch])
        if last or not same:
            if held and not same:
                yield pa.concat_tables(held)
                held = []
            if last:
                yield pa.concat_tables([*held, part.slice(0, last)])
                held = []
        held.append(part.slice(last))
    if held:
        yield pa.concat_tables(held)


_EVERY = np.arange(4)
_SUMMED = "conv long, block long, at long, m binary"
_STATES = "conv long, block long, enter int, leave int"


def _summed(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation and block as one item each: costs and ranks from every state to every state."""
    for table in _whole_runs(batches, "conv", "block"):
        conv, block, at = (table.column(c).to_numpy() for c in ("conv", "block", "at"))
        sizes = _runs(conv, block)
        if level:
            m = _matrices(table.column("m"))
            item = lambda place, m=m: (m[place, 0], m[place, 1])
        else:
            kind = table.column("kind").to_numpy()
            item = lambda place, kind=kind: (KIND_COSTS[kind[place]], KIND_RANKS[kind[place]])
        cost, rank, _ = _program(sizes, item, np.broadcast_to(_EVERY, (len(sizes), 4)))
        heads = np.cumsum(sizes) - sizes
        m = [x.tobytes() for x in np.stack([cost, rank], 1)]
        yield pa.RecordBatch.from_arrays([pa.array(conv[heads]), pa.array(block[heads]), pa.array(at[heads]), pa.array(m, pa.binary())], names=["conv", "block", "at", "m"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the item of a whole conversation the state that it is left in: cheapest, of equals with the least audit."""
    for batch in batches:
        if batch.num_rows:
            m = _matrices(batch.column(batch.schema.get_field_index("m")))[:, :, START]
            more = np.array([FINAL[s][0] for s in range(4)])
            left = (np.minimum(m[:, 0] + more, _NEVER) * 4 + m[:, 1]).argmin(1)
            n = len(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, START, np.int32)), pa.array(left.astype(np.int32))], names=["conv", "block", "enter", "leave"])


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states each item of a run is entered and left in, from those of the run."""
    for table in _whole_runs(batches, "conv", "up"):
        conv, up, block = (table.column(c).to_numpy() for c in ("conv", "up", "block"))
        sizes = _runs(conv, up)
        heads = np.cumsum(sizes) - sizes
        m = _matrices(table.column("m"))
        _, _, came = _program(sizes, lambda place: (m[place, 0], m[place, 1]), table.column("enter").to_numpy()[heads][:, None], keep=True)
        before, after = _path(sizes, came, table.column("leave").to_numpy()[heads])
        yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(block), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], names=["conv", "block", "enter", "leave"])


def _marked(items: DataFrame) -> DataFrame:
    """whole: the only item of its conversation."""
    items = written(items, "segments")
    parts = items.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv", F.lit(False).alias("one"))
    return items.join(parts, "conv", "left").withColumn("whole", F.coalesce("one", F.lit(True))).drop("one")


def segment_states(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, block, enter, leave: the states in which the cheapest repair enters and leaves each segment of `segment`
    turns at most. turns: conv (a number for each conversation), kind, at."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv", F.expr(f"at div {segment}").alias("block"), "at", "kind")
    levels, alone = [], []
    while True:
        placed = rows.repartition(n, "conv", "block").sortWithinPartitions("conv", "block", "at")
        deep = len(levels)
        items = placed.mapInArrow(lambda batches, deep=deep: _summed(batches, deep), _SUMMED)
        items = written(_marked(items), "segments")
        levels.append(items)
        alone.append(items.where("whole").select("conv", "block", "m").mapInArrow(_chosen, _STATES))
        if not items.where("NOT whole").head(1):
            break
        rows = items.where("NOT whole").select("conv", F.expr(f"block div {segment}").alias("block"), "at", "m")
    states = alone[-1]
    for items, finished in zip(levels[-2::-1], alone[-2::-1]):
        own = items.where("NOT whole").withColumn("up", F.expr(f"block div {segment}"))
        led = own.join(states.withColumnRenamed("block", "up"), ["conv", "up"]).repartition(n, "conv", "up").sortWithinPartitions("conv", "up", "block")
        led = led.select("conv", "up", "block", "m", "enter", "leave").mapInArrow(_descended, _STATES)
        states = written(finished.unionByName(led), "states")
    return states


# Writing it out -------------------------------------------------------------------------

_DONE = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order: the counts, the audit, and a running hash of what is left of each. A segment of turns is
    held at a time, and of a conversation its audit."""
    names = [x.split()[0] for x in _DONE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    open_one: dict | None = None

    def closed(c: dict) -> list:
        cost, tail = FINAL[c["state"]]
        audit = "".join(c["audit"]) + tail
        state = c["state"]
        for _ in tail:
            state = _turned(state)
            c["line"](f"{_NAMES[state]}:")
        gaps = c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0
        return [c["conv"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"] + cost, audit, c["sha"].hexdigest()]

    def begin(conv: int) -> dict:
        sha, empty = hashlib.sha256(), [True]

        def line(x: str) -> None:
            sha.update((x if empty[0] else "\n" + x).encode())
            empty[0] = False

        return {"conv": conv, "sha": sha, "line": line, "audit": [], "state": START, "cost": 0, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}

    for table in _whole_runs(batches, "conv", "block"):
        conv, block, kind, enter, leave = (table.column(c).to_numpy() for c in ("conv", "block", "kind", "enter", "leave"))
        sizes = _runs(conv, block)
        heads = np.cumsum(sizes) - sizes
        _, _, came = _program(sizes, lambda place: (KIND_COSTS[kind[place]], KIND_RANKS[kind[place]]), enter[heads][:, None], keep=True)
        before, after = _path(sizes, came, leave[heads])
        costs = KIND_COSTS[kind, before, after].tolist()
        codes = KIND_RANKS[kind, before, after].tolist()
        turns, roles, texts, faults = (table.column(c).to_pylist() for c in ("turn", "role", "text", "fault"))
        done = []
        for i, (own, state) in enumerate(zip(conv.tolist(), before.tolist())):
            if open_one is None or open_one["conv"] != own:
                if open_one is not None:
                    done.append(closed(open_one))
                open_one = begin(own)
            c = open_one
            if faults[i]:
                c[faults[i]] += 1
            if turns[i] is not None and turns[i] != c["last"]:
                c["turns"] += 1
                c["first"] = turns[i] if c["first"] is None else c["first"]
                c["last"] = turns[i]
            if c["role"] is not None and (c["role"], roles[i][:1]) not in _LEGAL:
                c["illegal"] += 1
            c["role"] = roles[i][:1]
            c["cost"] += costs[i]
            code = CODES[codes[i]]
            c["audit"].append(code)
            for letter in code:
                if letter == "K":
                    c["line"](f"{roles[i]}:{texts[i]}")
                elif letter != "D":
                    state = _turned(state)
                    c["line"](f"{_NAMES[state]}:{texts[i] if letter == 'R' else ''}")
            c["state"] = int(after[i])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=names)
    if open_one is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(closed(open_one)), kinds)], names=names)


def _conv_key(column: Column) -> Column:
    """A number for a conversation; nulls are one conversation."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")), column.isNull())


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, damage: bool = True) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (`damage`; see `damaged`), nulls being one space. Then they stand by turn, nulls first; rows
    of one turn by role and text. A row's first fault counts: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (role and
    text seen earlier), truncated (its last such character isn't one of `.!?`). gaps are the turn numbers that are
    missing between the least and the largest; illegal counts neighbours whose roles' initials aren't su, ua or au. The
    audit has the initials of the cheapest edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate
    rows must go), Insert an empty turn 5; a truncated row that stays adds 5; the roles that are left must read
    `(s?(ua)+)?`; of equal costs the least audit. An empty role has no initial and can't be kept.

    A conversation without rows after the damage has zeros, an empty audit and the hash of an empty text; a null id is
    one conversation; an empty table gives no rows; other columns are not read. Conversations are told apart by 64-bit
    hashes of their ids. The hash of one conversation is a serial function of its text, so it is taken by one task,
    which streams the turns; all else of a long conversation is spread over tasks.
    """
    spark = rows.sparkSession
    ids = rows.select(F.col(conv_id).alias("conv_id")).distinct().withColumn("conv", _conv_key(F.col("conv_id")))
    if damage:
        own = damaged(rows, conv_id, turn, role, text)
    else:
        spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(1).alias("times"))
    turns = numbered(own).withColumn("conv", _conv_key(F.col("conv_id"))).withColumn("turn", F.col("turn").cast("long"))
    states = segment_states(turns.select("conv", "kind", "at"), segment)
    placed = turns.withColumn("block", F.expr(f"at div {segment}")).join(states, ["conv", "block"])
    placed = placed.select("conv", "block", "at", "turn", "role", "text", "fault", "kind", "enter", "leave")
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "block", "at")
    done = placed.mapInArrow(_written_out, _DONE)
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(done, "conv", "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )
