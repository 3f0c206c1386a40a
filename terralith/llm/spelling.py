"""Spelling variants: words one edit apart, each led to the most frequent of its near words.

One edit leaves a half of a word intact, so near words stand together either in the forward dictionary (their first
halves agree) or in the reversed one (their last halves do). Halves are taken of the shorter length of a pair, which
makes four blocks a word: prefix and suffix, as the shorter and as the longer one. A block with many words is divided
again in the same way - of what is still unknown, the first half or the last half is intact - in Spark as long as it
is large, then in numpy; that ends where one code point is left, where the alphabet bounds a block. Pairs are
verified in numpy and only what they come to for a word leaves a task: no pairs are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shuffle_width, written

#: The runs that are words; one in so many occurrences loses a code point; least length and occurrences;
#: how many times as frequent a form is.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A block of more words is divided in Spark, one of more than PAIRED in numpy; words of one task's table.
LARGE, PAIRED, TABLE = 20_000, 48, 50_000
#: Bytes of words that are compared at once.
_COMPARED = 1 << 23
_MET = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """word: a row for each run of letters of each whole text (null: none), A-Z in small letters.

    A run whose crc32 of `<doc_id>:<run>` the number `damaged` divides loses the code point at that crc32 modulo its
    length. A null id is an empty one in that text.
    """
    small = F.translate(F.col(text), _CAPITALS, _SMALL)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(small, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)  # a loss only shortens
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences, counted over all documents."""
    counted = occurrences(docs, doc_id, text).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# Blocks ---------------------------------------------------------------------------------


def _divided(rows: DataFrame) -> DataFrame:
    """Each row in its two sub-blocks. Of a row (word, n, m, lo, r, path) the first lo and the last m - lo - r code
    points are known to agree; the first or the last half of the r others (r + 1 in a longer word) agrees too."""
    head = F.floor(F.col("r") / 2).cast("int")
    tail = (F.col("r") - head).cast("int")
    first = F.struct((F.col("lo") + head).alias("lo"), tail.alias("r"), F.concat("path", F.lit("P")).alias("path"), F.substr("word", F.col("lo") + 1, head).alias("key"))
    end = F.length("word") - (F.col("m") - F.col("lo") - F.col("r"))
    last = F.struct(F.col("lo").alias("lo"), head.alias("r"), F.concat("path", F.lit("S")).alias("path"), F.substr("word", end - tail + 1, tail).alias("key"))
    out = rows.select("word", "n", "m", "bid", F.explode(F.array(first, last)).alias("x"))
    return out.select("word", "n", "m", F.xxhash64("bid", "m", "x.path", "x.key").alias("bid"), "x.lo", "x.r", "x.path")


def word_blocks(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n, m, bid, lo, r, path: every word in the blocks it shares with what may be near it, none of more than
    `large` words unless a single code point is left to differ."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    rows = _divided(rows.select("word", "n", "m", F.lit(0).cast("long").alias("bid"), F.lit(0).alias("lo"), F.col("m").alias("r"), F.lit("").alias("path")))
    done = None
    while True:
        crowded = written(rows.where("r > 1").groupBy("bid").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large).select("bid"), "crowded")
        if not crowded.head(1):
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(crowded, "bid", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        done = written(done, "blocks")
        rows = written(_divided(rows.join(crowded, "bid", "left_semi")), "blocks")


# Verification ---------------------------------------------------------------------------


class _Met:
    """Near pairs as they come, added up for each word."""

    def __init__(self, words: list, n: np.ndarray, order: np.ndarray):
        self.words, self.n, self.order = words, n, order  # order: place of a word in code-point order
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            np.add.at(self.near, x, 1)
            by = np.lexsort((self.order[y], -self.n[y], x))
            first = by[np.r_[True, x[by][1:] != x[by][:-1]]] if len(by) else by
            i, new = x[first], y[first]
            old = self.best[i]
            better = (old < 0) | (self.n[new] > self.n[old]) | ((self.n[new] == self.n[old]) & (self.order[new] < self.order[old]))
            self.best[i[better]] = new[better]


def _verify(chars: np.ndarray, short: np.ndarray, m: int, steps: list[tuple[bool, int]], rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, met: _Met) -> None:
    """All pairs of each block that are one edit apart and belong to this block. rows: blocks end to end, of `sizes`.

    A pair stands in several blocks; it belongs to the one whose every step it takes: prefix where its common prefix
    allows that, else suffix.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    later = ends - np.arange(len(rows)) - 1
    most = max(1, _COMPARED // (m + 1))
    first = 0
    reach = np.cumsum(later)
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(reach, (reach[first - 1] if first else 0) + most, "right")))
        take = later[first:last]
        i = np.repeat(np.arange(first, last), take)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
        first = last
        a, b = rows[i], rows[j]
        keep = short[a] | short[b]
        a, b = a[keep], b[keep]
        swap = ~short[a]
        a, b = np.where(swap, b, a), np.where(swap, a, b)  # a is the shorter one
        same = short[b]
        x, y = chars[a, :m], chars[b]
        off = x != y[:, :m]
        lcp = np.where(off.any(1), off.argmax(1), m)
        back = np.where(same[:, None], off, x != y[:, 1:])[:, ::-1]
        lcs = np.where(back.any(1), back.argmax(1), m)
        near = (lcp + lcs >= m - same) & ~(same & (lcp == m))
        for is_prefix, least in steps:
            near &= (lcp >= least) == is_prefix
        met.add(ids[a[near]], ids[b[near]])


def _divide(chars: np.ndarray, short: np.ndarray, m: int, lo: int, r: int, steps: list, rows: np.ndarray, block: np.ndarray, ids: np.ndarray, met: _Met) -> None:
    """Blocks of one path: the small ones are verified, the others divided until they are small or one code point is left."""
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[heads, len(block)])
    each = np.repeat(sizes, sizes)
    small = (each <= PAIRED) if r > 1 else np.ones(len(rows), bool)
    if small.any():
        _verify(chars, short, m, steps, rows[small], sizes[sizes <= PAIRED] if r > 1 else sizes, ids, met)
    rows, block = rows[~small], block[~small]
    if not len(rows):
        return
    head = r // 2
    for is_prefix in (True, False):
        width = head if is_prefix else r - head
        begin = np.full(len(rows), lo) if is_prefix else np.where(short[rows], lo + head, lo + head + 1)
        key = block.astype(np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(257) + chars[rows, begin + k] + np.uint64(1))
        _divide(chars, short, m, lo + head if is_prefix else lo, r - head if is_prefix else head, [*steps, (is_prefix, lo + head)], rows, key, ids, met)


def _steps(m: int, path: str) -> tuple[int, int, list[tuple[bool, int]]]:
    """lo, r and the steps of a path."""
    lo, r, steps = 0, m, []
    for c in path:
        head = r // 2
        steps.append((c == "P", lo + head))
        lo, r = (lo + head, r - head) if c == "P" else (lo, head)
    return lo, r, steps


def _meet(table: pa.Table) -> pa.Table:
    """Whole blocks: for each word how many near words it has here, and the most frequent of them."""
    col = {c: table.column(c).to_numpy() for c in ("n", "m", "bid")}
    words = table.column("word").to_pylist()
    paths = np.array(table.column("path").to_pylist(), object)
    known = {w: i for i, w in enumerate(sorted(set(words)))}
    ids = np.fromiter((known[w] for w in words), np.int64, len(words))
    n = np.zeros(len(known), np.int64)
    n[ids] = col["n"]
    met = _Met(list(known), n, np.arange(len(known)))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    by = np.lexsort((paths.astype(str), col["m"]))
    cut = np.flatnonzero(np.r_[True, (col["m"][by][1:] != col["m"][by][:-1]) | (paths[by][1:] != paths[by][:-1])])
    for a, b in zip(cut, np.r_[cut[1:], len(by)]):
        own, m = by[a:b], int(col["m"][by[a]])
        # letters up to U+00FF: a byte each
        chars = np.frombuffer(b"".join(words[i].encode("latin-1").ljust(m + 1, b"\0") for i in own), np.uint8).reshape(-1, m + 1)
        lo, r, steps = _steps(m, paths[own[0]])
        _divide(chars, sizes[own] == m, m, lo, r, steps, np.arange(len(own)), col["bid"][own].view(np.uint64), ids[own], met)
    hit = np.flatnonzero(met.near)
    return pa.table([pa.array([met.words[i] for i in hit], pa.string()), pa.array(met.near[hit]), pa.array(n[met.best[hit]]), pa.array([met.words[i] for i in met.best[hit]], pa.string())], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n_near, best, best_n: of each word with near ones, how many, and the most frequent (ties: the least). words: word, n."""
    blocks = word_blocks(words, large)
    n_tables = max(shuffle_width(words.sparkSession), 4 * words.count() // TABLE + 1)
    met = blocks.select("word", "n", "m", "bid", "path", F.pmod(F.xxhash64("bid"), F.lit(n_tables)).alias("part")).groupBy("part").applyInArrow(_meet, _MET)
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), "best")).alias("b")).select("word", "n_near", "b.best", "b.best_n")


# Forms and roots ------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word along its forms to the last. forms: word, form; every form is more frequent than its
    word, so there are no circles. A root takes its own root in each round, so log2 of the longest way are needed."""
    led = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = led.join(led.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
        step = written(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        led = step.select("word", "root")
        if not step.where("moved").head(1):
            return led


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
    near word of largest n (of equals the least in code-point order) if that is at least `times` the word's own n;
    the root is where following forms ends, the word itself without a form. Null and empty texts hold no words; rows
    that repeat count as often as they stand; an empty table gives no rows; other columns are not read. A text of any
    length is one run of code points; words of any length are compared whole.
    """
    words = written(frequent_words(docs, doc_id, text), "words")
    near = near_words(words)
    out = words.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    out = written(out.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    led = roots(out.where("form IS NOT NULL"))
    return out.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
