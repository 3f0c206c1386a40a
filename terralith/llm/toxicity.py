"""Toxicity by compression distance: what a zstandard dictionary of toxic text saves against one of ordinary text.

Two dictionaries are trained, on toxic and on ordinary documents. The toxic one learns from what sets toxic documents
apart, so that both don't spend themselves on the same common words. A document is cut into windows of WINDOW words;
the window's distance is how many bytes shorter the toxic dictionary makes it than the ordinary one. The largest
distances of a document, weighed on labelled documents that no dictionary has seen, give its score: 0.5 is the
threshold that this calibration sets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: One fold in so many by crc32 of the id is held out (remainder 0); the last is for calibration, the others for the dictionaries.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Labelled documents that are fitted on, those with the least hash of their id: of each label for the dictionaries, of
#: any label for the calibration; longer documents are not fitted on, nor those beyond so many characters together.
MOST_DOCS, MOST_CALIBRATION, MOST_CHARS, MOST_TOTAL = 2_000, 4_000, 200_000, 24_000_000
#: Words of a window. Longer windows hold more of chance: the bytes that ordinary words save here or there outweigh
#: what one toxic word saves (4 words: half of the toxic documents stand out, 1 word: all).
WINDOW = 1
#: Bytes of the dictionaries; the toxic one is small, so that it holds only what many toxic documents share.
TOXIC_BYTES, ORDINARY_BYTES = 2048, 65_536
#: Words that the toxic dictionary learns from stand in so large a part of the toxic documents, in so many at least, and
#: in so many times the part of the ordinary ones.
LEAST_PART, LEAST_DOCS, TIMES = 0.02, 3, 4
LEVEL = 3
#: zstandard looks for no match in the last bytes of its input; these stand behind every window.
_PAD = b"\0" * 12
#: Largest distances of different windows that are weighed, and the bytes beyond which a distance counts no more.
TOP, CLIP = 3, 12
#: Bytes that a chance word saves at most, mostly.
CHANCE = 3
#: Windows whose distances a task remembers; then it starts anew.
REMEMBERED = 400_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Runs of `size` words (letters, digits and bytes beyond ASCII; A-Z as a-z), a space around each word. The last may be shorter."""
    found = _WORD.findall(text.lower())
    if size == 1:
        return found
    return [b" ".join(found[i : i + size]) for i in range(0, len(found), size)]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    #: is `toxic` a dictionary of zstandard's trainer, or plain text where there was too little of it
    trained: tuple[bool, bool]
    weights: tuple[float, ...]
    window: int = WINDOW

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Distances:
    """How many bytes of a window the toxic dictionary saves; a window's distance is remembered."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes, trained: bool):
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            own = zstandard.ZstdCompressionDict(content, dict_type=kind)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False)

        self.toxic, self.ordinary = compressor(model.toxic, model.trained[0]), compressor(model.ordinary, model.trained[1])
        self.known: dict[bytes, int] = {}
        self.window = model.window

    def of(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            laid = b" " + window + b" " + _PAD
            found = self.known[window] = len(self.ordinary.compress(laid)) - len(self.toxic.compress(laid))
        return found

    def features(self, text: bytes) -> tuple[int, ...]:
        """The TOP largest distances of different windows, 0 to CLIP each."""
        top = [0] * TOP
        for d in map(self.of, set(windows(text, self.window))):
            if d > top[-1]:
                top[-1] = min(d, CLIP)
                top.sort(reverse=True)
        return tuple(top)


def _shaped(features: np.ndarray) -> np.ndarray:
    """What is weighed: the distances, and how far the first two are beyond what chance words save."""
    f = np.asarray(features, float).reshape(-1, TOP)
    return np.column_stack([f, np.maximum(f[:, 0] - CHANCE, 0), np.maximum(f[:, 1] - CHANCE, 0)])


def _fitted(features: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    ridge = np.r_[1e-6, np.full(x.shape[1] - 1, 0.5)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (label - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _apart(texts: list[bytes]) -> list[list[bytes]]:
    """The distinct words of each text, without near copies of texts before it (an equal least hash of word pairs)."""
    seen, out = set(), []
    for text in texts:
        found = windows(text, 1)
        pairs = {a + b" " + b for a, b in zip(found, found[1:])} or {b" ".join(found)}
        least = {(seed, min(zlib.crc32(p, seed) for p in pairs)) for seed in range(4)}
        if not least & seen:
            out.append(list(dict.fromkeys(found)))
        seen |= least
    return out


def _dictionary(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """zstandard's dictionary of the samples; where they are too few or short for its trainer, their last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), True
    except zstandard.ZstdError:
        return (b"".join(samples)[-size:] or b" " * 8).rjust(8), False


def train(toxic: list[bytes], ordinary: list[bytes], window: int = WINDOW) -> Model:
    """The two dictionaries, without weights yet."""
    toxic_words, ordinary_words = _apart(toxic), _apart(ordinary)
    n, m = Counter(w for ws in toxic_words for w in ws), Counter(w for ws in ordinary_words for w in ws)
    nt, no = max(1, len(toxic_words)), max(1, len(ordinary_words))
    telling = {w for w, k in n.items() if k >= max(LEAST_DOCS, LEAST_PART * nt) and k / nt >= TIMES * (m[w] + 0.5) / no}
    joined = lambda ws: b" " + b" ".join(ws) + b" "
    samples = [joined(own) for ws in toxic_words if (own := [w for w in ws if w in telling])]
    a, b = _dictionary(samples, TOXIC_BYTES), _dictionary([joined(ws) for ws in ordinary_words if ws], ORDINARY_BYTES)
    return Model(a[0], b[0], (a[1], b[1]), (0.0,) * (TOP + 3), window)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _samples(docs: DataFrame, labels: DataFrame) -> dict[str, list]:
    """Per part (toxic, ordinary, calibration) the (text, label) of at most as many labelled documents as it may have.

    Ids are chosen from the labels alone, so that no text is shuffled: the documents are read once beside those ids.
    Of rows with one id the least text stands for it.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    f = fold(F.col("doc_id"))
    part = F.when(f == CALIBRATION, "calibration").when(F.col("toxic") == 1, "toxic").otherwise("ordinary")
    labels = labels.where(f != HELD_OUT).select("doc_id", "toxic", part.alias("part"), F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")).alias("h"))
    most = {"toxic": MOST_DOCS, "ordinary": MOST_DOCS, "calibration": MOST_CALIBRATION}
    ids = reduce(DataFrame.unionByName, [labels.where(F.col("part") == k).orderBy("h", "doc_id").limit(n) for k, n in most.items()])
    own = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS).join(F.broadcast(ids), "doc_id")
    own = written(own.groupBy("part", "h", "doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxicity_sample")
    sizes = own.select("part", "h", "doc_id", F.length("text").alias("size")).collect()  # a few thousand rows of numbers
    taken, total = [], Counter()
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        total[r.part] += r.size
        if total[r.part] <= MOST_TOTAL:
            taken.append((r.doc_id,))
    kept = docs.sparkSession.createDataFrame(taken, docs.select("doc_id").schema)
    rows = own.join(F.broadcast(kept), "doc_id").select("part", "h", "doc_id", "toxic", F.encode("text", "utf-8").alias("text")).collect()
    out: dict[str, list] = {k: [] for k in most}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        out[r.part].append((bytes(r.text), r.toxic))
    return out


def fit(docs: DataFrame, labels: DataFrame, window: int = WINDOW) -> Model:
    """The model of labelled documents outside the held-out fold. docs: doc_id, text; labels: doc_id, toxic (0, 1; others don't count)."""
    own = _samples(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), labels)
    model = train([t for t, _ in own["toxic"]], [t for t, _ in own["ordinary"]], window)
    known = own["calibration"]
    if not known or not own["toxic"]:
        return Model(model.toxic, model.ordinary, model.trained, (-30.0, *model.weights[1:]), window)  # nothing says toxic
    distances = Distances(model)
    weights = _fitted(_shaped([distances.features(t) for t, _ in known]), np.array([y for _, y in known], float))
    return Model(model.toxic, model.ordinary, model.trained, weights, window)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            features = np.array([distances.features(texts[i].as_py() or b"") for i in range(batch.num_rows)], float).reshape(-1, TOP)
            score = model.score(_shaped(features))
            own = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(features[:, 0].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["doc_id", "held_out", "score", "predicted", "distance"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, distance.

    labels (doc_id, toxic) are learned from only where crc32 of the id modulo FOLDS isn't 0; held_out tells the
    others. score is from 0 to 1, predicted is 1 from 0.5 on, distance the largest one of a window in bytes. Every whole text is scored, from the
    text alone: equal texts get equal scores. A null text is an empty one, which gets the score of a document without
    distances; a null id is held out and not learned from; without toxic labels all scores are 0; repeated rows are each scored; of several labels
    of one id the toxic one holds; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(own, labels, window)
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = own.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double, predicted int, distance long")
