"""Media columns in Matroska: documents' bytes stored as 8-bit audio, and any Matroska bytes parsed to packets.

Everything is per row and map-only: one row's file is built or parsed at a time, so memory is bounded by the
largest file, and a lost executor only repeats its own rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: element identifiers.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING_FLAG, DEFAULT_DURATION, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Stored form: samples a second, samples a frame, frames a block, blocks a cluster. Timestamps are milliseconds.
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16
PAD = 64

# Writing ----------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; width 0: the shortest that holds n and isn't the reserved all-ones."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING_FLAG, 1) + number(DEFAULT_DURATION, FRAME * 10**9 // SAMPLE_RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing bits and body of a block: none for one frame, fixed for equal sizes, else EBML lacing."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 3, head + b"".join(frames)


def audio_file(payload: bytes) -> bytes:
    """payload, one byte a sample, as a Matroska file of one PCM track with laced blocks, clusters and cues."""
    info = element(INFO, number(TIMESTAMP_SCALE, 10**6) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"terralith") + element(WRITER, b"terralith"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    for first in range(0, len(payload), per_cluster):
        ms = first * 1000 // SAMPLE_RATE
        body = [number(TIMESTAMP, ms)]
        for start in range(first, min(first + per_cluster, len(payload)), block):
            kind, data = laced([payload[i : i + FRAME] for i in range(start, min(start + block, len(payload)), FRAME)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + (start * 1000 // SAMPLE_RATE - ms).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# Parsing ----------------------------------------------------------------------------------


class Malformed(ValueError):
    pass


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value and next offset; None for a size whose bits are all ones (unknown)."""
    first = data[at] if at < end else 0
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise Malformed(f"no variable-length number at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the (offset, size) of each frame in a block."""
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise Malformed(f"cut block at {at}")
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, rel, flags, [(at, end - at)]
    if at >= end:
        raise Malformed(f"cut lacing at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise Malformed(f"uneven fixed lacing at {at}")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"cut lacing at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            begin = at
            v, at = read_vint(data, at, end)
            if v is None:
                v = (1 << 7 * (at - begin)) - 1
            sizes.append(v if i == 0 else sizes[-1] + v - ((1 << 7 * (at - begin) - 1) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"lacing is longer than its block at {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, rel, flags, out


def parse(data: bytes) -> dict:
    """Tracks, packets and cues of a Matroska file. What comes before a malformed or cut part is kept; error says where it is."""
    out: dict = {"tracks": [], "packets": [], "cues": [], "clusters": 0, "blocks": 0, "duration_ms": None, "error": None}
    scale, state = 10**6, {"time": 0, "cluster": 0, "segment": 0, "track": None, "cue": None}
    stack = [len(data)]  # ends of the open elements; a child can't pass its parent's end
    kinds = [0]
    at = 0
    try:
        if not data:
            raise Malformed("empty")
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1]:
                stack.pop()
                kinds.pop()
            begin, end = at, stack[-1]
            ident, at = read_vint(data, at, end, keep_marker=True)
            size, at = read_vint(data, at, end)
            if kinds[-1] == CLUSTER and ident in (CLUSTER, CUES, TRACKS, INFO):  # ends a cluster of unknown size
                stack.pop()
                kinds.pop()
                end = stack[-1]
            stop = end if size is None else at + size
            if stop > end or (size is None and ident not in (SEGMENT, CLUSTER)):
                raise Malformed(f"element {ident:X} at {begin} passes its parent's end")
            if ident in MASTERS:
                if ident == SEGMENT:
                    state["segment"] = at
                elif ident == CLUSTER:
                    state["cluster"] = begin - state["segment"]
                    out["clusters"] += 1
                elif ident == TRACK_ENTRY:
                    out["tracks"].append({"track": None, "type": None, "codec": None, "rate": 8000.0, "channels": 1, "bits": None, "step": 0})
                elif ident == CUE_POINT:
                    out["cues"].append({"time_ms": None, "track": None, "cluster": None})
                elif ident == BLOCK_GROUP:
                    state["group"] = len(out["packets"])
                stack.append(stop)
                kinds.append(ident)
                continue
            body = data[at:stop] if ident not in (SIMPLE_BLOCK, BLOCK) else b""
            n = int.from_bytes(body, "big") if len(body) <= 8 else 0
            real = lambda b: struct.unpack(">f" if len(b) == 4 else ">d", b)[0] if len(b) in (4, 8) else 0.0
            if ident in (SIMPLE_BLOCK, BLOCK):
                track, rel, flags, frames = block_frames(data, at, stop)
                step = next((t["step"] for t in out["tracks"] if t["track"] == track), 0)
                base = (state["time"] + rel) * scale
                out["blocks"] += 1
                for i, (where, length) in enumerate(frames):
                    out["packets"].append((track, base + i * step, where, length, ident == BLOCK or bool(flags & 0x80), LACINGS[flags >> 1 & 3], state["cluster"]))
            elif ident == REFERENCE:  # the group's frames need another one
                out["packets"][state.get("group", 0) :] = [(*p[:4], False, *p[5:]) for p in out["packets"][state.get("group", 0) :]]
            elif ident == TIMESTAMP:
                state["time"] = n
            elif ident == TIMESTAMP_SCALE:
                scale = n
            elif ident == DURATION:
                out["duration_ms"] = real(body) * scale / 10**6
            elif out["cues"] and ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                out["cues"][-1][{CUE_TIME: "time_ms", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[ident]] = n
            elif out["tracks"]:
                own = out["tracks"][-1]
                if ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
                    own[{TRACK_NUMBER: "track", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "step"}[ident]] = n
                elif ident == CODEC_ID:
                    own["codec"] = body.decode("ascii", "replace")
                elif ident == RATE:
                    own["rate"] = real(body)
            at = stop
    except (Malformed, IndexError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


# DataFrames -------------------------------------------------------------------------------

PACKET = T.StructType([
    T.StructField("track", T.LongType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("key", T.BooleanType()), T.StructField("lacing", T.StringType()), T.StructField("cluster", T.LongType()),
])
PARSED = T.StructType([
    T.StructField("packets", T.ArrayType(PACKET)), T.StructField("clusters", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("cues", T.LongType()),
    T.StructField("cues_at_clusters", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("rate", T.DoubleType()), T.StructField("bits", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("payload", T.BinaryType()),
])
_PACKET_NAMES = PACKET.fieldNames()
#: Rows handed on at once; their bytes are bounded by OUT_BYTES and one row.
OUT_BYTES = 4 << 20


def _column(df: DataFrame, column: str, name: str, kind: T.DataType, make) -> DataFrame:
    """df with another column made from a binary one, a few megabytes of rows at a time. An equal name is replaced."""
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            values, first, held = [], 0, 0
            source = batch.column(batch.schema.get_field_index(column))
            for i, x in enumerate(source):
                raw = x.as_py()
                values.append(None if raw is None else make(raw))
                held += len(raw or b"")
                if held >= OUT_BYTES or i == len(source) - 1:
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(values, arrow)], names=[*own.schema.names, name])
                    values, first, held = [], i + 1, 0

    return df.mapInArrow(run, schema)


def to_matroska(df: DataFrame, content: str = "payload", media: str = "media") -> DataFrame:
    """df with `media`: the bytes of `content` as a Matroska file, a sample for each byte (null stays null)."""
    return _column(df, content, media, T.BinaryType(), lambda raw: audio_file(bytes(raw)))


def read_matroska(df: DataFrame, media: str = "media", name: str = "parsed") -> DataFrame:
    """df with `parsed`: packets (track, timestamp, byte range, lacing), counts, and the bytes of the first track.

    Null media give null. Malformed, cut and empty files give the packets before the fault, and `error`.
    Rows that repeat and other columns are kept as they are.
    """

    def make(raw: bytes) -> dict:
        raw = bytes(raw)
        found = parse(raw)
        track = found["tracks"][0] if found["tracks"] else {}
        starts = {p[6] for p in found["packets"]}
        return {
            "packets": [dict(zip(_PACKET_NAMES, p)) for p in found["packets"]], "clusters": found["clusters"], "blocks": found["blocks"], "cues": len(found["cues"]),
            "cues_at_clusters": sum(c["cluster"] in starts for c in found["cues"]), "codec": track.get("codec"), "rate": track.get("rate"), "bits": track.get("bits"),
            "duration_ms": found["duration_ms"], "error": found["error"], "payload": b"".join(raw[p[2] : p[2] + p[3]] for p in found["packets"] if p[0] == track.get("track")),
        }

    return _column(df, media, name, PARSED, make)


def packet_table(df: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """One row per packet: keys, packet (0, 1, ... in file order), track, timestamp_ns, first_byte, n_bytes, key, lacing, cluster."""
    parsed = read_matroska(df.select(*keys, media), media, "__parsed")
    return parsed.select(*keys, F.posexplode("__parsed.packets").alias("packet", "__p")).select(*keys, "packet", "__p.*")


def media_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text (null: empty) padded, stored and read back: the columns of the contract.

    Equal texts give equal values; a null id stays null; an empty table gives no rows.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    pad = F.when(size == 0, F.lit(PAD)).otherwise(F.pmod(-size, F.lit(PAD)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("n_bytes"), F.concat(raw, F.substring(F.lit(bytes(PAD)), F.lit(1), pad)).alias("payload"))
    rows = read_matroska(to_matroska(rows).drop("payload"))
    p = F.col("parsed")
    each = lambda kind: F.size(F.filter(p["packets"], lambda x: x["lacing"] == kind))
    lacings = F.concat_ws(",", *(F.concat(F.lit(f"{k}:"), each(k)) for k in LACINGS))
    return rows.select(
        "doc_id", "n_bytes",
        F.octet_length(p["payload"]).cast("long").alias("payload_bytes"), F.sha2(p["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(p["payload"], F.octet_length(p["payload"]) - PAD + 1, F.lit(PAD))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.concat(F.lit("codec="), p["codec"]), F.concat(F.lit("rate="), p["rate"].cast("long")), F.concat(F.lit("bits="), p["bits"]), F.concat(F.lit("packets="), F.size(p["packets"])),
            F.concat(F.lit("blocks="), p["blocks"]), F.concat(F.lit("clusters="), p["clusters"]), F.concat(F.lit("cues="), p["cues"], F.lit("/"), p["cues_at_clusters"]), F.concat(F.lit("lacing="), lacings),
            F.concat(F.lit("ms="), p["duration_ms"].cast("long")), F.concat(F.lit("last_ns="), F.element_at(p["packets"], -1)["timestamp_ns"]), F.concat(F.lit("error="), p["error"]),
        ).alias("feature"),
    )
