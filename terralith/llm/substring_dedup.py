"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged to maximal removal intervals.

A window is removed where an earlier document (a smaller id) has it too. Hashes travel packed: each map task drops
what it can already decide (a window repeated within the task's own documents), and sends the rest once per window
and document, in runs of windows that follow each other and share an anchor, the least hash of eight words within the
window. Equal windows share it and neighbours mostly share it too; it gives the run's bucket and is compared beside the
window's own hash, so equality rests on 128 bits while the shuffle carries about 8 bytes a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, rolling, row_key, shuffle_width, words

WINDOW = 50
#: Words for whose windows a map task decides locally and packs at once; a longer document is alone.
FLUSH_WORDS = 1_500_000
#: Buckets for each shuffle partition: enough that partitions are even, few enough that a row is worth its overhead.
BUCKETS_PER_PARTITION = 8
#: Words of an anchor: so many that no frequent phrase draws many windows into one bucket.
_ANCHOR = 8
_PACKED = "bucket int, ids binary, keys binary, starts binary, sizes binary, anchors binary, hashes binary"
_ANCHOR_BASE = np.uint64(0xA24BAED4963EE407)  # another one than the windows' own
_HITS = "sub_id long, sub_key long, runs binary"


def window_hashes(text: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each window's hash, text, first word, its place among all words; and the hashes of all words."""
    _, _, hashes, sizes = words(text, cuts)
    n = len(hashes)
    first = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - np.repeat(first[:-1], sizes)
    whole = np.flatnonzero(place + k <= np.repeat(sizes, sizes))  # the window stays within its text
    return rolling(hashes, k)[whole], doc[whole], place[whole], whole, hashes


def _anchors(hashes: np.ndarray, k: int) -> np.ndarray:
    """The least hash of _ANCHOR consecutive words in each window of k, by doubling."""
    small = rolling(hashes, min(_ANCHOR, k), _ANCHOR_BASE)
    width = k - min(_ANCHOR, k) + 1
    have, least = 1, small
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return least


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run begins: any key differs from the one before (the last key: isn't its successor)."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[-1][1:] != keys[-1][:-1] + 1
    for key in keys[:-1]:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether any key differs from the one before."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in sorted_keys], axis=0)
    return new


def _pack(k: int, n_buckets: int):
    """Documents to packed runs of window hashes; bucket < 0 holds the windows that are already decided."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x[0] for x in held])
        keys = np.concatenate([x[1] for x in held])
        doc_from = np.cumsum([0, *(len(x[0]) for x in held)])
        hashes = np.concatenate([x[2] for x in held])
        doc = np.concatenate([x[3] + at for x, at in zip(held, doc_from)])
        start = np.concatenate([x[4] for x in held])
        anchor = np.concatenate([x[5] for x in held])
        held.clear()
        if not len(hashes):
            return
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        order = np.lexsort((start, rank[doc], anchor, hashes))
        h, d = hashes[order], doc[order]
        new = _changes(h, anchor[order])
        least = ids[d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]]  # the least id with this window here
        later = ids[d] > least
        repeat = ~new & ~later
        repeat[1:] &= d[1:] == d[:-1]  # the same window again in the same document: its first place stands for it
        decided, sent = np.sort(order[later]), np.sort(order[~later & ~repeat])
        rows: dict[str, list] = {c: [] for c in ("bucket", "ids", "keys", "starts", "sizes", "anchors", "hashes")}

        def add(b: int, which: np.ndarray, heads: np.ndarray, ends: np.ndarray, with_hashes: bool) -> None:
            rows["bucket"].append(b)
            rows["ids"].append(ids[doc[which[heads]]].tobytes())
            rows["keys"].append(keys[doc[which[heads]]].tobytes())
            rows["starts"].append(start[which[heads]].astype(np.int32).tobytes())
            rows["sizes"].append((ends - heads).astype(np.int32).tobytes())
            rows["anchors"].append(anchor[which[heads]].tobytes() if with_hashes else b"")
            rows["hashes"].append(hashes[np.concatenate([which[a:b] for a, b in zip(heads, ends)])].tobytes() if with_hashes and len(heads) else b"")

        if len(decided):
            heads = _runs(doc[decided], start[decided])
            ends = np.r_[heads[1:], len(decided)]
            for at in range(0, len(heads), 4096):  # any bucket will do
                add(-1 - int(mix(ids[doc[decided[heads[at : at + 1]]]].astype(np.uint64))[0] % np.uint64(n_buckets)), decided, heads[at : at + 4096], ends[at : at + 4096], False)
        if len(sent):
            heads = _runs(doc[sent], anchor[sent], start[sent])
            ends = np.r_[heads[1:], len(sent)]
            own = (mix(anchor[sent[heads]]) % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(own, kind="stable")
            cut = np.flatnonzero(np.r_[True, own[by][1:] != own[by][:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(by)]):
                add(int(own[by[a]]), sent, heads[by[a:b]], ends[by[a:b]], True)
        for at in range(0, len(rows["bucket"]), 256):
            kinds = [pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 256], t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch, text, cuts in blocks(batches):
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            h, doc, start, at, hashes = window_hashes(text, cuts, k)
            if not len(h):
                continue
            held.append((ids, keys, h, doc, start, _anchors(hashes, k)[at]))
            n += len(h)
            if n >= FLUSH_WORDS:
                yield from flush(held)
                n = 0
        if held:
            yield from flush(held)

    return run


def _decide(table: pa.Table) -> pa.Table:
    """All packed rows of one bucket: the windows of which a document with a smaller id has the same."""
    col = {c: [x.as_py() for x in table.column(c)] for c in ("ids", "keys", "starts", "sizes", "anchors", "hashes")}
    both = lambda c, kind: np.frombuffer(b"".join(col[c]), kind)
    ids, keys, starts, sizes, hashes = both("ids", np.int64), both("keys", np.int64), both("starts", np.int32), both("sizes", np.int32), both("hashes", np.uint64)
    if len(hashes):
        run = np.repeat(np.arange(len(ids)), sizes)
        anchor = both("anchors", np.uint64)[run]
        place = starts[run] + np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((ids[run], anchor, hashes))
        h = hashes[order]
        new = _changes(h, anchor[order])
        least = ids[run[order]][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        hit = np.sort(order[ids[run[order]] > least])
        ids, keys, place = ids[run[hit]], keys[run[hit]], place[hit].astype(np.int64)
        heads = _runs(ids, keys, place)
        starts, sizes = place[heads].astype(np.int32), np.diff(np.r_[heads, len(hit)]).astype(np.int32)
        ids, keys = ids[heads], keys[heads]
    order = np.lexsort((starts, keys, ids))  # one row for each document
    ids, keys, runs = ids[order], keys[order], np.stack([starts[order], sizes[order]], 1) if len(ids) else np.empty((0, 2), np.int32)
    cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]) if len(ids) else np.empty(0, np.int64)
    out = [runs[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(ids)])]
    return pa.table([pa.array(ids[cut], pa.int64()), pa.array(keys[cut], pa.int64()), pa.array(out, pa.binary())], names=["sub_id", "sub_key", "runs"])


def repeated_windows(docs: DataFrame, k: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """sub_id, sub_key, runs: for documents that repeat windows of earlier ones, pairs of int32 (first window, how many).

    Only a window's first place in a document is given; the others have the same hash.
    """
    n = BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("sub_id"), row_key(doc_id, text).alias("sub_key"), F.col(text).alias("text"))
    packed = rows.mapInArrow(_pack(k, n), _PACKED)
    place = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    packed = packed.withColumn("bucket", F.struct(place, F.col("bucket") < 0))
    return packed.groupBy("bucket").applyInArrow(_decide, _HITS)


def _cut(k: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch, text, cuts in blocks(batches):
            all_runs = batch.column(batch.schema.get_field_index("__sub_runs"))
            starts, ends, hashes, sizes = words(text, cuts)
            first = np.r_[0, np.cumsum(sizes)]
            removed, shas, kept_texts, spans = [], [], [], []
            raw = text.tobytes()
            for i, n in enumerate(sizes):
                a, b = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
                gone = np.zeros(n, bool)
                found = b"".join(x.as_py() for x in (all_runs[i].values or [])) if all_runs[i].is_valid else b""
                if found:
                    runs = np.frombuffer(found, np.int32).reshape(-1, 2)
                    h = rolling(hashes[first[i] : first[i + 1]], k)
                    at = np.concatenate([np.arange(s, s + c) for s, c in runs])
                    hit = np.isin(h, h[at])
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, np.flatnonzero(hit), 1)
                    np.add.at(depth, np.flatnonzero(hit) + k, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                kept = b" ".join(raw[x:y] for x, y in zip(a[~gone], b[~gone]))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                spans.append([{"first_word": int(x), "n_words": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
                if keep_text:
                    kept_texts.append(kept)
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])))]
            if keep_text:
                new.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            own = [c for c in batch.schema.names if c not in ("__sub_runs", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *new], names=[*own, "n_words", "n_removed", "kept_sha256", "intervals", *["kept_text"] * keep_text])

    return run


def substring_dedup(docs: DataFrame, k: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, intervals (first_word, n_words), kept_text.

    Removes each word covered by a window of k words that also starts in a document with a smaller id. Windows are
    judged on the input. A null text has no words; a text shorter than k words is kept whole; a row with a null id
    is kept whole and stands against no other; rows of one id never stand against each other; an empty table gives
    no rows; other columns are not read. Windows are compared by 64-bit hashes of the window and of its anchor: of n
    distinct windows with one anchor about n * n / 2**65 pairs are taken for equal by chance, of n others n * n / 2**129.
    """
    hits = repeated_windows(docs, k, doc_id, text).groupBy("sub_id", "sub_key").agg(F.collect_list("runs").alias("__sub_runs"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("sub_key"))
    rows = rows.join(hits.withColumnRenamed("sub_id", "doc_id"), ["doc_id", "sub_key"], "left").select("doc_id", "text", "__sub_runs")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<first_word:long,n_words:long>>" + ", kept_text string" * keep_text
    return rows.mapInArrow(_cut(k, keep_text), schema)
