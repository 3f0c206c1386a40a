"""LM scoring by masked pseudo-likelihood: a small network predicts every word from the words on both its sides.

Word counts over the whole corpus give the vocabulary and the output's starting bias. The network is trained in numpy
on every partition's own documents, each round on every word of them; after a round, the
partitions' weights are averaged by their words. Every word of every document is then predicted, and a document's
score is the sum of the log probabilities. A word outside the vocabulary has the probability of its ending times its
own share of that ending's words, from the counts of all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, words, written

#: Outputs: CLASSES of WITHIN tokens each. The most frequent words are tokens; ENDINGS more tokens stand for all
#: other words, by their last three bytes.
CLASSES, WITHIN, ENDINGS = 32, 32, 256
TOKENS = CLASSES * WITHIN
#: Words on each side, size of an embedding, hidden units.
SIDE, EMBEDDING, HIDDEN = 2, 16, 32
#: Rounds (each predicts every word once; a word is never in its own context), step size, words a step.
ROUNDS, RATE, BATCH = 2, 3e-3, 2048
#: Words scored at once; words whose counts are gathered before they are handed on; numbers in a row of weights.
TOGETHER, FLUSH_WORDS, CHUNK = 2048, 2_000_000, 4096
#: Weights averaged by one task at once.
FAN_IN = 64
_U = np.uint64
_SHAPES = {"embed": (TOKENS + 1, EMBEDDING), "w1": (2 * SIDE * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (HIDDEN, WITHIN), "bw": (CLASSES, WITHIN)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


@dataclass
class Network:
    vocabulary: np.ndarray  # hashes of the words that are tokens, sorted
    token: np.ndarray  # their tokens
    weights: np.ndarray  # all parameters, flat
    rest: np.ndarray | None = None  # how often words outside the vocabulary occur, by ending

    def parts(self) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            out[name] = self.weights[at : at + n].reshape(shape)
            at += n
        return out


def _ending(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ending of each word: a number below ENDINGS from its last three bytes."""
    last = np.zeros(len(starts), np.uint64)
    for back in range(1, 4):
        inside = ends - back >= starts
        last = last * _U(257) + np.where(inside, text[np.maximum(ends - back, 0)].astype(np.uint64) + _U(1), _U(0))
    return (mix(last) % _U(ENDINGS)).astype(np.int64)


def _tokens(net: Network, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token of each word, how many words each text has, and each word's hash."""
    starts, ends, hashes, sizes = words(text, cuts)
    if not len(hashes):
        return np.empty(0, np.int64), sizes, hashes
    # words of the vocabulary are found by their hash's first 16 bits, where few or none share them
    out = np.full(len(hashes), -1)
    first = np.searchsorted(net.vocabulary >> _U(48), np.arange((1 << 16) + 1, dtype=np.uint64))
    begin, n = first[:-1], np.diff(first)
    slot = (hashes >> _U(48)).astype(np.int64)
    for k in range(int(n.max())):
        maybe = np.flatnonzero(n[slot] > k)
        at = begin[slot[maybe]] + k
        same = net.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = net.token[at[same]]
    rare = np.flatnonzero(out < 0)
    out[rare] = TOKENS - ENDINGS + _ending(text, starts[rare], ends[rare])
    return out, sizes, hashes


def tokens_of(net: Network, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token of each word, and how many words each text has."""
    return _tokens(net, text, cuts)[:2]


def windows(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with SIDE edges (token TOKENS) between texts, and the place of each word there."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(tokens)) + SIDE * (doc + 1)
    laid = np.full(len(tokens) + SIDE * (len(sizes) + 1), TOKENS, np.int64)
    laid[place] = tokens
    return laid, place


_OFFSETS = np.array([i for i in range(-SIDE, SIDE + 1) if i])


def forward(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each target given its 2 * SIDE neighbours, and what the gradient needs.

    Words lie along the last axis of all but x, so that sums and maxima over classes run along whole rows; both levels
    of the softmax are one array.
    """
    x = p["embed"].take(context, 0).reshape(len(context), -1)
    h = p["w1"].T @ x.T
    h += p["b1"][:, None]
    # tanh by exp, which numpy computes many numbers at a time; beyond its range the limit is exact
    h *= -2
    with np.errstate(over="ignore"):
        np.exp(h, out=h)
    h += 1
    np.divide(2, h, out=h)
    h -= 1
    a, b = target // WITHIN, target % WITHIN
    row = np.arange(len(target))
    both = np.concatenate([p["wc"], p["ww"]], 1)
    soft = both.T @ h
    soft[:CLASSES] += p["bc"][:, None]
    soft[CLASSES:] += p["bw"].take(a, 0).T
    out = np.zeros(len(target), np.float32)
    for e, y in ((soft[:CLASSES], a), (soft[CLASSES:], b)):
        e -= e.max(0)
        out += e[y, row]
        np.exp(e, out=e)
        total = e.sum(0)
        out -= np.log(total)
        e /= total
    return out, (x, h, a, b, row, soft, both)


def gradient(p: dict[str, np.ndarray], context: np.ndarray, kept: tuple) -> np.ndarray:
    """Gradient of the mean negative log probability, flat."""
    x, h, a, b, row, soft, both = kept
    soft[a, row] -= 1
    soft[CLASSES + b, row] -= 1
    one = np.zeros((CLASSES, len(row)), np.float32)
    one[a, row] = 1
    w, bias = h @ soft.T, soft.sum(1)
    g = {"wc": w[:, :CLASSES], "bc": bias[:CLASSES], "ww": w[:, CLASSES:], "bw": one @ soft[CLASSES:].T}
    dh = both @ soft
    dh *= 1 - h * h
    g["w1"], g["b1"] = x.T @ dh.T, dh.sum(1)
    dx = (p["w1"] @ dh).reshape(2 * SIDE, EMBEDDING, len(row))
    flat = context.T.ravel()
    g["embed"] = np.stack([np.bincount(flat, dx[:, i].ravel(), TOKENS + 1) for i in range(EMBEDDING)], 1)
    return np.concatenate([g[name].ravel() for name in _SHAPES]).astype(np.float32) / np.float32(len(row))


class Trainer:
    """Adam on a copy of the weights."""

    def __init__(self, net: Network) -> None:
        self.net = Network(net.vocabulary, net.token, net.weights.copy())
        self.m, self.v, self.step, self.seen = np.zeros(_SIZE, np.float32), np.zeros(_SIZE, np.float32), 0, 0

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        p = self.net.parts()
        g = gradient(p, context, forward(p, context, target)[1])
        self.step += 1
        self.seen += len(target)
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.net.weights -= np.float32(RATE) * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + np.float32(1e-8))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    endings: list[np.ndarray] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        value, first, count = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        ending = np.concatenate(endings)[first].astype(np.int64)
        for at in range(0, len(value), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(value[part].view(np.int64)), pa.array(ending[part]), pa.array(count[part].astype(np.int64))], names=["word", "ending", "n"])

    for _, text, cuts in blocks(batches):
        starts, ends, hashes, _ = words(text, cuts)
        held.append(hashes)
        endings.append(_ending(text, starts, ends).astype(np.int16))
        n += len(hashes)
        if n >= FLUSH_WORDS:
            yield from flush()
            held, endings, n = [], [], 0
    if n:
        yield from flush()


def _train(shared, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        contexts, targets, n = [], [], 0
        for _, text, cuts in blocks(batches):
            tokens, sizes = tokens_of(trainer.net, text, cuts)
            laid, place = windows(tokens, sizes)
            # the order of a block's words comes from its own content, so a repeated task takes them in the same order
            seed = int(tokens[:64].sum()) * 1_000_003 + len(tokens)
            place = np.random.default_rng([turn, seed]).permutation(place)
            contexts.append(laid[place[:, None] + _OFFSETS])
            targets.append(laid[place])
            n += len(place)
            if n >= BATCH:
                c, t = np.concatenate(contexts), np.concatenate(targets)
                whole = n // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    trainer.learn(c[at : at + BATCH], t[at : at + BATCH])
                contexts, targets, n = [c[whole:]], [t[whole:]], n - whole
        if n:
            trainer.learn(np.concatenate(contexts), np.concatenate(targets))
        if trainer.seen:
            shard = TaskContext.get().partitionId()
            for i, at in enumerate(range(0, _SIZE, CHUNK)):
                part = trainer.net.weights[at : at + CHUNK].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([shard]), pa.array([float(trainer.seen)]), pa.array([part.tobytes()], pa.binary())], names=["chunk", "shard", "weight", "numbers"])

    return run


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")  # so that the sums don't depend on which task ends first
    weight = table.column("weight").to_numpy()
    numbers = np.stack([np.frombuffer(x.as_py(), np.float64) for x in table.column("numbers")])
    mean = (numbers * weight[:, None]).sum(0) / weight.sum()
    return pa.table({"chunk": table.column("chunk")[:1], "shard": pa.array([table.column("shard")[0].as_py() // FAN_IN]), "weight": pa.array([weight.sum()]), "numbers": pa.array([mean.tobytes()], pa.binary())})


def fit(texts: DataFrame) -> tuple[Network, DataFrame]:
    """The network, and word, n: the count of every word. texts: one column, text. What is gathered are the counts of
    the vocabulary and of the endings, and each partition's weights."""
    counts = texts.mapInArrow(_counts, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    counts = written(counts, "word_counts")
    top = counts.orderBy(F.desc("n"), "word").limit(TOKENS - ENDINGS).toArrow()
    rest = np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        rest[r.ending] = r.n
    np.subtract.at(rest, top.column("ending").to_numpy(), top.column("n").to_numpy())
    hashes = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    often = top.column("n").to_numpy().astype(np.float64)
    order = np.argsort(hashes)
    rng = np.random.default_rng(11)
    share = np.full(TOKENS, 0.5)
    share[: len(often)] += often
    share[TOKENS - ENDINGS :] += rest
    share = share.reshape(CLASSES, WITHIN)
    start = {name: np.zeros(shape) for name, shape in _SHAPES.items()}
    start["embed"] = rng.normal(0, 0.3, _SHAPES["embed"])
    start["w1"] = rng.normal(0, (2 * SIDE * EMBEDDING) ** -0.5, _SHAPES["w1"])
    start["wc"], start["ww"] = rng.normal(0, 0.01, _SHAPES["wc"]), rng.normal(0, 0.01, _SHAPES["ww"])
    start["bc"], start["bw"] = np.log(share.sum(1)) - np.log(share.sum()), np.log(share) - np.log(share.sum(1, keepdims=True))
    net = Network(hashes[order], order.astype(np.int64), np.concatenate([start[n].ravel() for n in _SHAPES]).astype(np.float32), rest)
    for turn in range(ROUNDS):
        made = texts.mapInArrow(_train(texts.sparkSession.sparkContext.broadcast(net), turn), "chunk long, shard long, weight double, numbers binary")
        made = written(made, "weights")
        most = (made.agg(F.max("shard")).first()[0] or 0) + 1
        while True:
            most = -(-most // FAN_IN)
            made = made.groupBy("chunk", F.floor(F.col("shard") / FAN_IN).alias("group")).applyInArrow(_average, "chunk long, shard long, weight double, numbers binary")
            if most <= 1:
                break
        rows = made.orderBy("chunk").toArrow()  # the weights once: _SIZE numbers
        if len(rows):
            net = Network(net.vocabulary, net.token, np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in rows.column("numbers")]).astype(np.float32), rest)
    return net, counts.select("word", "n")


def log_probabilities(net: Network, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every word's token given its neighbours, and how many words each text has."""
    tokens, sizes = tokens_of(net, text, cuts)
    return _predicted(net, tokens, sizes), sizes


def _predicted(net: Network, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    laid, place = windows(tokens, sizes)
    p = net.parts()
    out = [forward(p, laid[place[at : at + TOGETHER, None] + _OFFSETS], tokens[at : at + TOGETHER])[0] for at in range(0, len(tokens), TOGETHER)]
    return np.concatenate([np.empty(0, np.float32), *out])


def _score(shared):
    """Of every text the log probability of its endings and tokens, less the log count of each ending's words; and the
    words outside the vocabulary, with how often they occur in it: their own log counts are still to be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        # a word that was never counted has the share of one that was counted once
        less = np.log(np.maximum(net.rest, 1.0))
        row = TaskContext.get().partitionId() << 33
        for batch, text, cuts in blocks(batches):
            tokens, sizes, hashes = _tokens(net, text, cuts)
            logp = _predicted(net, tokens, sizes).astype(np.float64)
            rare = np.flatnonzero(tokens >= TOKENS - ENDINGS)
            logp[rare] -= less[tokens[rare] - (TOKENS - ENDINGS)]
            total = np.r_[0.0, np.cumsum(logp)]
            ends = np.cumsum(sizes)
            doc, word = np.repeat(np.arange(len(sizes)), sizes)[rare], hashes[rare]
            order = np.lexsort((word, doc))
            doc, word = doc[order], word[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])][: len(doc)])
            times = np.diff(np.r_[first, len(doc)])
            at = pa.array(np.searchsorted(doc[first], np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (word[first].view(np.int64), times.astype(np.int64))]
            rows = pa.array(row + np.arange(len(sizes), dtype=np.int64))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(sizes, pa.int64()), pa.array(total[ends] - total[ends - sizes]), *lists], names=["row", "doc_id", "n_tokens", "logp", "words", "times"])

    return run


def score(docs: DataFrame, net: Network, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, pseudo_logp (summed, natural), pseudo_perplexity (null without words).

    net and counts: from fit. A null or empty text, or one of white space, has 0 tokens and a sum of 0; a null id stays null; repeated rows are
    each returned; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)
    # written, so that the rows' numbers stay as they are whichever task is repeated
    made = written(rows.mapInArrow(_score(shared), f"row long, doc_id {kind}, n_tokens long, logp double, words array<long>, times array<long>"), "token_scores")
    each = made.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # the log of one is 0, so words that were counted once add nothing
    own = each.join(counts.where("n > 1"), "word").select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), (F.col("times") * F.log("n")).alias("logp"))
    scored = made.select("row", "doc_id", "n_tokens", "logp").unionByName(own).groupBy("row").agg(F.any_value("doc_id", True).alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("logp").alias("logp"))
    mean = F.when(F.col("n_tokens") > 0, F.round(F.exp(-F.col("logp") / F.col("n_tokens")), 4))
    return scored.select("doc_id", "n_tokens", F.round("logp", 3).alias("pseudo_logp"), mean.alias("pseudo_perplexity"))


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The network fitted on docs' own texts, and every document's score by it: see score for its columns and edges.

    Each input partition trains its own copy between two averages, so scores depend on how the table is split into
    files, within what another order of training would change; for one layout they are repeatable.
    """
    return score(docs, *fit(docs.select(F.col(text).alias("text"))), doc_id, text)
