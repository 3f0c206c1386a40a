"""SentencePiece encoding and decoding as batched numpy Viterbi.

Distinct words of equal length advance together through their characters: hashes of all substrings that end at a
character probe the sorted hashes of the pieces, and the maxima over the substrings give each word's backpointer.

A unigram model maximises the sum of the pieces' scores. In a BPE model a path is allowed (score 0, else minus
infinity) where every two neighbouring pieces stay apart when they are merged on their own; exactly one path of a
word has that property, and it is the one that merging the whole word gives. So both kinds return the ids that the
model's own library returns.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

#: Place of the vocabulary file; on a cluster a path on every machine, or a name given to SparkContext.addFile.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words advanced together, and words whose ids a task remembers before it starts anew.
TOGETHER, REMEMBERED = 20_000, 300_000
#: A word with more characters is encoded alone, character by character: no other word advances with it.
LONG = 512
#: Text encoded at once: the more words advance together, the less each costs.
TEXT_BYTES = 4 << 20
#: Size of the tables that tell quickly which hashes are no piece's, and which pair of pieces was looked at already.
_SIEVE = 1 << 21  # as _slot has it
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: What the format takes off the least score for a character that is no piece.
UNKNOWN_PENALTY = 10.0


def read_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """The vocabulary, and what Viterbi needs of it."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    unigram: bool
    dummy_prefix: bool
    remove_extra: bool
    keys: np.ndarray = field(init=False)  # sorted hashes of ordinary pieces
    ids: np.ndarray = field(init=False)
    longest: int = field(init=False)

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (self.NORMAL, self.USER)]
        hashed = np.array([_hash(np.array([ord(c) for c in self.pieces[i]], np.uint64)) for i in usable], np.uint64)
        order = np.argsort(hashed)
        self.keys, self.ids = hashed[order], np.array(usable, np.int64)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have the same hash")
        self.sieve, self.slots = np.zeros(_SIEVE, bool), np.zeros(_SIEVE, np.int32)
        slot, n = np.unique(_slot(self.keys), return_counts=True)
        self.slots[_slot(self.keys)] = np.arange(len(self.keys))
        self.sieve[slot], self.slots[slot[n > 1]] = True, -1
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.unknown = int(np.flatnonzero(self.kinds == self.UNKNOWN)[0])
        of_byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == self.BYTE}
        self.bytes = np.array([of_byte[b] for b in range(256)]) if len(of_byte) == 256 else None
        self.lookup = {self.pieces[i]: i for i in usable}
        self.least = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        self.pairs = np.full(_SIEVE, -1, np.int64)  # BPE: at a pair's slot the code of the last one there, and whether it stays apart
        self.stay = np.zeros(_SIEVE, bool)
        self.known: dict[int, bool] = {}  # the same, for pairs whose slot another has taken
        self.memory: dict[str, bytes] = {}  # ids of words, as bytes of int32
        self.spelled = [self._spelled(i) for i in range(len(self.pieces))]

    def _spelled(self, i: int) -> bytes:
        """The bytes that an id stands for in a decoded text."""
        kind = self.kinds[i]
        if kind == self.BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return " ⁇ ".encode() if kind == self.UNKNOWN else b"" if kind == self.CONTROL else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbouring pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if (i := self.lookup.get(a + b)) is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """BPE: which pairs of pieces are left as they are (left < 0: nothing stands before)."""
        code = (left + 1) * (1 << 22) + right
        slot = _slot(code.view(np.uint64))
        new, out = np.flatnonzero(self.pairs[slot] != code), self.stay[slot]
        if len(new):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            some, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            stay = []
            for c in some.tolist():
                if (known := self.known.get(c)) is None:
                    parts = [self.pieces[x] for x in ((c >> 22) - 1, c & (1 << 22) - 1) if x >= 0]
                    known = self.merged("".join(parts)) == parts
                stay.append(known)
            stay = np.array(stay)
            place = slot[new[first]]
            codes, stays = np.r_[self.pairs[place], some], np.r_[self.stay[place], stay]
            self.pairs[place], self.stay[place] = some, stay
            out_of = (codes >= 0) & (codes != np.r_[self.pairs[place], self.pairs[place]])
            self.known.update(zip(codes[out_of].tolist(), stays[out_of].tolist()))
            out[new] = stay[back]
        return out

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Where in keys each hash stands, if it is there; keys that share a slot are searched for."""
        at = self.slots[_slot(hashed)]
        shared = np.flatnonzero(at < 0)
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self.keys, hashed[shared]), len(self.keys) - 1)
        return at


def _slot(x: np.ndarray) -> np.ndarray:
    """The place of a hash or code in a table of _SIEVE."""
    return (x * _U(0xD1342543DE82EF95) >> _U(43)).view(np.int64)


def _hash(points: np.ndarray) -> np.uint64:
    h = _U(0)
    with np.errstate(over="ignore"):
        for c in points:
            h = h * _BASE + (_U(c) + _U(1))
    return h


def load(path: str) -> Pieces:
    """The pieces of a SentencePiece model file. Its text must be taken unchanged (no character map): others are refused."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, trainer, normal = [], [], [], {}, {}
    for number, value in read_fields(data):
        if number == 1:
            own = dict(read_fields(value))
            pieces.append(own[1].decode())
            scores.append(np.frombuffer(own.get(2, bytes(4)), "<f4")[0])
            kinds.append(own.get(3, 1))
        elif number == 2:
            trainer = dict(read_fields(value))
        elif number == 3:
            normal = dict(read_fields(value))
    if normal.get(2):
        raise ValueError("the model maps characters; only identity models are supported")
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return Pieces(pieces, np.array(scores, np.float32), np.array(kinds), kind == 1, bool(normal.get(3, 1)), bool(normal.get(4, 1)))


def _viterbi(p: Pieces, points: np.ndarray) -> list[bytes]:
    """points: a row of code points for each word, all of one length. The ids of each word, as bytes."""
    n, length = points.shape
    least = np.float32(-np.inf)
    best = np.full((length + 1, n), least, np.float32)
    best[0] = 0
    take = np.zeros((length + 1, n), np.int64)  # length of the piece that ends here
    piece = np.full((length + 1, n), -1, np.int64)  # and its id; -1 at the start
    unit = p.unknown
    letters = np.ascontiguousarray(points.T) + _U(1)
    for end in range(1, length + 1):
        h = np.zeros(n, np.uint64)
        power = _U(1)
        for size in range(1, min(end, p.longest) + 1):
            start = end - size
            # extended to the left: hash of points[start : end]
            h = h + letters[start] * power
            power = _U(int(power) * int(_BASE) & (1 << 64) - 1)
            rows = np.flatnonzero(p.sieve[_slot(h)]) if size > 1 else np.arange(n)
            rows = rows[best[start, rows] > least]
            if not len(rows):
                continue
            at = p.places(h[rows])
            hit = p.keys[at] == h[rows]
            if size > 1:
                rows, at = rows[hit], at[hit]
                i = p.ids[at]
            else:
                i = np.where(hit, p.ids[at], unit)
            if p.unigram:
                value = best[start, rows] + np.where(i != unit, p.scores[i], np.float32(p.least))
                better = value >= best[end, rows]  # of equals the longest, as the library has it
            else:
                before = piece[start, rows]
                value = np.zeros(len(rows), np.float32)
                better = best[end, rows] == least
                # an unknown character merges with nothing on either side
                free = (before == unit) | (i == unit)
                if free.any():
                    look = np.flatnonzero(better & free)
                    better[look] = _alone(p, np.where(before[look] == unit, i[look], before[look]))
                bound = np.flatnonzero(better & ~free)
                if len(bound):
                    better[bound] = p.apart(before[bound], i[bound])
            rows = rows[better]
            best[end, rows], take[end, rows], piece[end, rows] = value[better], size, i[better]
    # all words go back together, a piece each round
    at, column = np.full(n, length), np.arange(n)
    rounds, fallback = [], np.zeros(n, bool)
    while (at > 0).any():
        own = np.where(at > 0, piece[at, column], -2)
        fallback |= own == unit
        rounds.append(own)
        step = take[at, column]
        if ((at > 0) & (step == 0)).any():
            raise ValueError("a word has no path")
        at = at - step
    ids = np.stack(rounds[::-1], 1) if rounds else np.empty((n, 0), np.int64)
    kept = ids != -2
    flat, ends = ids[kept].astype(np.int32).tobytes(), np.cumsum(kept.sum(1)) * 4
    out = [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
    for r in np.flatnonzero(fallback).tolist():
        out[r] = _with_fallback(p, points[r], piece[:, r], take[:, r])
    return out


def _with_fallback(p: Pieces, points: np.ndarray, piece: np.ndarray, take: np.ndarray) -> bytes:
    """Ids of a word with unknown characters: their bytes, or the unknown piece once for a run of them."""
    ids: list[int] = []
    end = len(points)
    while end > 0:
        i = int(piece[end])
        if i == p.unknown and p.bytes is not None:
            ids.extend(reversed(p.bytes[list(chr(int(points[end - 1])).encode("utf-8", "surrogatepass"))].tolist()))
        elif not (i == p.unknown and ids and ids[-1] == p.unknown):
            ids.append(i)
        end -= int(take[end])
    return np.array(ids[::-1], np.int32).tobytes()


def _alone(p: Pieces, i: np.ndarray) -> np.ndarray:
    """BPE: which pieces are what merging their own text gives (-1: the start, which is)."""
    ok = np.ones(len(i), bool)
    real = np.flatnonzero((i >= 0) & (i != p.unknown))
    ok[real] = p.apart(np.full(len(real), -1), i[real])
    return ok


def _long_word(p: Pieces, word: str) -> bytes:
    """The ids of one long word, in time linear in its length but for a logarithm."""
    n = len(word)
    piece, take = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    if p.unigram:
        best = [0.0] + [-math.inf] * n
        for end in range(1, n + 1):
            for size in range(1, min(end, p.longest) + 1):
                i = p.lookup.get(word[end - size : end])
                if i is None and size > 1:
                    continue
                value = best[end - size] + (p.least if i is None else float(p.scores[i]))
                if value >= best[end]:  # of equals the longest
                    best[end], piece[end], take[end] = value, p.unknown if i is None else i, size
    else:
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))  # by first character; size 0: merged away
        heap: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                both = size[at] + size[after[at]]
                i = p.lookup.get(word[at : at + both])
                if i is not None:
                    heapq.heappush(heap, (-float(p.scores[i]), at, both))

        for at in range(n):
            offer(at)
        while heap:
            _, at, both = heapq.heappop(heap)
            other = after[at]
            if not size[at] or other >= n or size[at] + size[other] != both:
                continue  # one of the two has merged since
            size[at], size[other], after[at] = both, 0, after[other]
            if after[at] < n:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        for at in range(n):
            if size[at]:
                i = p.lookup.get(word[at : at + size[at]])
                piece[at + size[at]], take[at + size[at]] = p.unknown if i is None else i, size[at]
    return _with_fallback(p, np.array([ord(c) for c in word], np.uint64), piece, take)


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode(p: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text. A word is a run of spaces and what follows it: no piece goes beyond."""
    split, same = [], {}  # a word is held once, however often it stands in the texts
    for text in texts:
        if p.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        words = _WORD.findall(((SPACE if p.dummy_prefix else "") + text).replace(" ", SPACE)) if text else []
        split.append(list(map(same.setdefault, words, words)))
    if len(p.memory) > REMEMBERED:
        p.memory.clear()
    new: dict[int, list[str]] = {}
    for word in same.keys() - p.memory.keys():
        new.setdefault(len(word), []).append(word)
    for length, words in new.items():
        if length > LONG:
            p.memory.update((w, _long_word(p, w)) for w in words)
            continue
        step = max(1, min(TOGETHER, (1 << 19) // length))
        for at in range(0, len(words), step):
            some = words[at : at + step]
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length).astype(np.uint64)
            for w, ids in zip(some, _viterbi(p, points)):
                p.memory[w] = ids
    get = p.memory.__getitem__
    return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]


def decode(p: Pieces, ids: np.ndarray) -> str:
    """The text of ids: bytes join to characters (U+FFFD where they are none), unknowns are ' ⁇ ', controls nothing."""
    text = b"".join(map(p.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if p.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        import os

        _LOADED[path] = load(path if os.path.exists(path) else SparkFiles.get(path))
    return _LOADED[path]


def _with(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, column: str, model: str, make) -> DataFrame:
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model)
        for batch, values in make(p, batches, column):
            yield pa.RecordBatch.from_arrays([*batch.columns, values if isinstance(values, pa.Array) else pa.array(values, arrow)], names=[*batch.schema.names, name])
        p.memory.clear()  # the worker lives on for other stages
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _encoded(p: Pieces, batches: Iterator[pa.RecordBatch], column: str):
    for batch, _, _ in blocks(batches, column, TEXT_BYTES):
        source = batch.column(batch.schema.get_field_index(column))
        ids = encode(p, [x or "" for x in source.to_pylist()])
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])), mask=source.is_null())
        yield batch, lists


def _decoded(p: Pieces, batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield part, [decode(p, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(part.schema.get_field_index(column))]


def encode_column(df: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """df with `ids`: array<int> of the text's pieces. Null stays null, empty gives no ids; a column of that name is replaced."""
    return _with(df, ids, T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32()), text, model, _encoded)


def decode_column(df: DataFrame, ids: str = "token_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with `text`: what the ids spell. Null stays null; a column of that name is replaced."""
    return _with(df, text, T.StringType(), pa.string(), ids, model, _decoded)


def token_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the ids joined by commas), round_trip (decoding gives the text).

    A null text has null tokens and round trip; U+2581 in a text decodes to a space, so such a text has no round trip.
    """
    rows = encode_column(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", model=model)
    rows = decode_column(rows, model=model)
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
