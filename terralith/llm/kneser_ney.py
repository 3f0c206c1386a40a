"""Quality classifier: an interpolated modified Kneser-Ney model of characters per language, trained on trusted text.

N-gram counts, continuation counts and context totals are tables sharded by n-gram, joined in Spark to a probability
for every n-gram that was seen and a back-off weight for every context. All characters and all languages with enough
trusted text are in it. Documents look their n-grams up by the same key: up to MOST_GRAMS rows the tables are sent
to the tasks, else the documents' distinct n-grams are joined with them by shuffle; both give the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, mix, written

ORDER = 4
#: Rows of the model's tables (12 bytes each) up to which they are sent to every task.
MOST_GRAMS = 8_000_000
#: Trusted documents (8 bytes each) up to which their ids are sent to every task.
MOST_IDS = 1_000_000
#: Text whose n-grams are sorted, or looked up, at once.
COUNTED_BYTES = 256 << 10
#: Distinct n-grams (72 bytes each) that a task holds before it passes their counts on.
HELD_GRAMS = 400_000
#: Trusted characters from which a language has a model of its own. Others use the pooled model.
LEAST_CHARS = 20_000
POOLED = ""
#: Characters of average text that are added to every document, so that short ones are not judged by a few characters.
PRIOR_CHARS = 64
#: A document is rejected above MARGIN times this quantile of its language's trusted perplexities.
QUANTILE, MARGIN = 0.995, 1.1
#: Steps a nat of the histogram from which quantiles are read, and the least trusted documents for an own threshold.
STEPS, LEAST_DOCS = 2000, 20
#: One in so many trusted documents, by the hash of its id, is never fitted on: thresholds come from unseen documents.
HELD_OUT = 5
_U = np.uint64
#: What stands before a text.
_EDGE = 0x110000


@dataclass
class Model:
    order: int
    #: numbers of the languages with a model of their own (POOLED among them); their distinct characters and one
    langs: dict[str, int]
    letters: dict[str, int]
    #: by length k: gram, logp of the n-grams that were seen; context, logw of their contexts
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)

    def of(self, lang: str | None) -> str:
        return lang if lang in self.langs else POOLED


def _points(data: np.ndarray, a: int, b: int) -> np.ndarray:
    text = data[a:b].tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def keys(points: np.ndarray, lang: int, order: int) -> list[np.ndarray]:
    """For k = 0 .. order: a number for the k characters that end at each character and their language. The
    context of the k characters at i is what keys[k - 1] has for i - 1, which the place before gives."""
    laid = np.full(len(points) + order, _EDGE, np.uint64)
    laid[order:] = points
    start = mix(np.array([lang + 1], np.uint64))[0]
    out = [np.full(len(laid), start)]
    for k in range(1, order + 1):
        # the k-gram ending here: its first k - 1 characters' number, which ended one place before, and the character
        before = np.r_[start, out[-1][:-1]]
        out.append(mix(before * _U(0xD6E8FEB86659FD93) + laid + _U(k)))
    return out


def _texts(batch: pa.RecordBatch, data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[str | None, np.ndarray]]:
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    for i, lang in enumerate(langs):
        yield lang, _points(data, cuts[i], cuts[i + 1])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _count_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        total: dict[str, list] = {}
        for lang, points in _texts(*block):
            total.setdefault(lang if lang is not None else POOLED, []).append(points)
        for lang, parts in total.items():
            value, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "point", "n"])


def _together(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers, counts last: columns with the same first number become one, and their counts are added."""
    _, first, at = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
    out = np.zeros((len(parts[0]), len(first)), np.uint64)
    for i in range(len(out) - 1):  # a row at a time, so that they are not all held twice
        out[i] = np.concatenate([x[i] for x in parts])[first]
    np.add.at(out[-1], at, np.concatenate([x[-1] for x in parts]))
    return out


def _count_grams(order: int, langs: dict[str, int], most: int = HELD_GRAMS):
    names = ["lang", *(f"g{k}" for k in range(order, 0, -1)), *(f"c{k}" for k in range(order, 0, -1)), "n"]
    edge = np.full(order, _EDGE, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def passed(least: int) -> Iterator[pa.RecordBatch]:
            """Counts of blocks are added; those of `least` n-grams or more leave the task."""
            for lang, parts in held.items():
                held[lang] = [_together(parts)]
            if sum(parts[0].shape[1] for parts in held.values()) >= least:
                for lang, (rows,) in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], langs[lang], np.int64)), *map(_signed, rows)], names=names)
                held.clear()

        for block in blocks(batches, most=COUNTED_BYTES):
            total: dict[str, list] = {}
            for lang, points in _texts(*block):
                for name in {POOLED, lang} & langs.keys():
                    total.setdefault(name, []).extend((edge, points))
            for lang, parts in total.items():
                # texts laid end to end, each after its own edge, whose n-grams are left out
                laid = np.concatenate(parts)
                own, at = keys(laid, langs[lang], order), np.flatnonzero(laid != _EDGE) + order
                _, first, n = np.unique(own[order][at], return_index=True, return_counts=True)
                at = at[first]
                # contexts: the (k - 1)-gram that ended one place before
                held.setdefault(lang, []).append(np.stack([*(own[k][at] for k in range(order, 0, -1)), *(own[k - 1][at - 1] for k in range(order, 0, -1)), n.astype(np.uint64)]))
            if sum(x.shape[1] for parts in held.values() for x in parts) > most:
                yield from passed(most // 2)
        yield from passed(0)

    return run


def smoothed(counts: DataFrame, order: int, letters: dict[int, int]) -> tuple[list[DataFrame], list[DataFrame]]:
    """From the counts of the longest n-grams (lang, g4 .. g1, c4 .. c1, n): for each length from 1 gram, logp of every
    n-gram seen, and context, logw of its contexts: an unseen n-gram has the weight times the probability of what is
    left without its first character."""
    parts: list[tuple[DataFrame, DataFrame]] = []
    for k in range(order, 0, -1):
        counts = counts.withColumnsRenamed({f"g{k}": "gram", f"c{k}": "context"})
        of = counts.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # few or uniform counts give no estimate: then the plain discount
        d = lambda i: F.least(F.greatest(F.coalesce(F.lit(i) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)), F.lit(0.1)), F.lit(float(i))).alias(f"d{i}")
        grams = counts.join(of.select("lang", d(1), d(2), d(3)), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        totals = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("held")).withColumn("w", F.col("held") / F.col("total"))
        lower = [F.col(f"g{k - 1}").alias("rest")] if k > 1 else [F.col("lang").alias("rest")]
        alpha = grams.join(totals, "context").select("gram", *lower, ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"), "w")
        parts.append((alpha, totals.select("context", F.log("w").cast("float").alias("logw"))))
        if k > 1:  # the lower order counts in how many different longer n-grams a gram ends
            left = ["lang", *(f"{x}{i}" for x in "gc" for i in range(k - 2, 0, -1)), f"c{k - 1}"]
            counts = written(counts.groupBy(f"g{k - 1}").agg(*(F.first(c).alias(c) for c in left), F.count(F.lit(1)).alias("n")), "continuations")
    grams, contexts, p = [], [], None
    pairs = [F.lit(x) for kv in letters.items() for x in kv]
    for alpha, weights in parts[::-1]:
        if p is None:  # below single characters all are alike
            own = alpha.withColumn("p", F.col("alpha") + F.col("w") / F.element_at(F.create_map(*pairs), F.col("rest")))
        else:
            own = alpha.join(p.select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest").withColumn("p", F.col("alpha") + F.col("w") * F.col("low"))
        p = written(own.select("gram", "p"), "grams")
        grams.append(p.select("gram", F.log("p").cast("float").alias("logp")))
        contexts.append(written(weights, "contexts"))
    return grams, contexts


def _is_fitted(doc_id: str) -> F.Column:
    """Whether a trusted document is counted; the others give the thresholds."""
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(HELD_OUT)) != 0


def fitted_ids(trusted: DataFrame) -> DataFrame:
    """The ids on which the model is fitted: of all trusted ones but those held out."""
    return trusted.select(F.col("doc_id").alias("__t")).where("__t IS NOT NULL").distinct().where(_is_fitted("__t"))


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> Model:
    """trusted: doc_id of the trusted documents. With none of them in docs the model is empty."""
    ids = fitted_ids(trusted)
    few = ids.count() <= MOST_IDS
    sample = docs.join(F.broadcast(ids) if few else ids, F.col(doc_id) == F.col("__t"), "left_semi").select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    if not few:  # read twice below, shuffled once
        sample = written(sample, "trusted")
    points = written(sample.mapInArrow(_count_points, "lang string, point long, n long").groupBy("lang", "point").agg(F.sum("n").alias("n")), "points")
    # at most one language for each LEAST_CHARS trusted characters
    own = points.where(F.col("lang") != POOLED).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("letters")).where(F.col("n") >= LEAST_CHARS).orderBy("lang").collect()
    every = points.agg(F.count_distinct("point")).first()[0]
    if not every:
        return Model(order, {}, {})
    letters = {POOLED: every + 1} | {r.lang: r.letters + 1 for r in own}
    langs = {name: i for i, name in enumerate(letters)}
    schema = "lang long, " + ", ".join(f"{x}{k} long" for x in "gc" for k in range(order, 0, -1)) + ", n long"
    counted = sample.mapInArrow(_count_grams(order, langs), schema)
    rest = [c for c in counted.columns if c not in (f"g{order}", "n")]
    counts = written(counted.groupBy(f"g{order}").agg(*(F.first(c).alias(c) for c in rest), F.sum("n").alias("n")), "gram_counts")
    return Model(order, langs, letters, *smoothed(counts, order, {i: letters[name] for name, i in langs.items()}))


class Tables:
    """A model's tables in one process: sorted keys and values."""

    def __init__(self, model: Model) -> None:
        self.order, self.langs, self.letters = model.order, model.langs, model.letters
        self.grams, self.contexts = ([self._sorted(df) for df in dfs] for dfs in (model.grams, model.contexts))

    of = Model.of

    @staticmethod
    def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        gram, value = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        order = np.argsort(gram)
        return gram[order], value[order]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
        return table[0][at] == key, table[1][at]

    def logp(self, points: np.ndarray, name: str) -> np.ndarray:
        """Of each character given those before it: the longest n-gram seen, after the weights of the longer contexts."""
        own = keys(points, self.langs[name], self.order)
        out = np.zeros(len(points), np.float64)
        open_ = np.arange(len(points))
        for k in range(self.order, 0, -1):
            seen, value = self._look(self.grams[k - 1], own[k][self.order + open_])
            out[open_[seen]] += value[seen]
            open_ = open_[~seen]
            known, weight = self._look(self.contexts[k - 1], own[k - 1][self.order + open_ - 1])
            out[open_[known]] += weight[known]
        out[open_] -= math.log(self.letters[name])
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Tables = shared.value
        for batch, data, cuts in blocks(batches, most=COUNTED_BYTES):
            n, total = [], np.zeros(len(batch))
            by_lang: dict[str, list] = {}
            for i, (lang, points) in enumerate(_texts(batch, data, cuts)):
                n.append(len(points))
                by_lang.setdefault(tables.of(lang), []).append((i, points))
            for name, some in by_lang.items():
                # texts laid end to end, each after its own edge, which is scored too and left out
                laid = [np.concatenate([np.full(tables.order, _EDGE, np.uint32), points]) for _, points in some]
                ends = np.cumsum([0, *map(len, laid)])
                logp = tables.logp(np.concatenate(laid), name)
                for (i, _), a, b in zip(some, ends, ends[1:]):
                    total[i] = logp[a + tables.order : b].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(total)], names=[*batch.schema.names, "kn_chars", "kn_logp"])

    return run


def _distinct_grams(order: int, langs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, cuts in blocks(batches, most=COUNTED_BYTES):
            at = batch.column(batch.schema.get_field_index("kn_row")).to_numpy()
            for row, (lang, points) in zip(at, _texts(batch, data, cuts)):
                name = lang if lang in langs else POOLED
                own = keys(points, langs[name], order)
                rows = [own[k][order:] for k in range(order, 0, -1)] + [own[k - 1][order - 1 : -1] for k in range(order, 0, -1)]
                _, first, n = np.unique(rows[0], return_index=True, return_counts=True)
                fixed = [pa.array(np.full(len(n), x, np.int64)) for x in (row, langs[name], len(points))]
                yield pa.RecordBatch.from_arrays([*fixed, *(_signed(r[first]) for r in rows), pa.array(n.astype(np.int64))], names=["kn_row", "lang", "size", *(f"{x}{k}" for x in "gc" for k in range(order, 0, -1)), "n"])

    return run


def _score_by_joins(docs: DataFrame, model: Model) -> DataFrame:
    """What _score gives, for tables of any size: every document's distinct n-grams meet the tables by shuffle."""
    order = model.order
    rows = written(docs.withColumn("kn_row", F.monotonically_increasing_id()), "kn_rows")
    schema = "kn_row long, lang long, size long, " + ", ".join(f"{x}{k} long" for x in "gc" for k in range(order, 0, -1)) + ", n long"
    each = rows.select("kn_row", "lang", "text").mapInArrow(_distinct_grams(order, model.langs), schema)
    logp = -F.log(F.element_at(F.create_map(*(F.lit(x) for name, i in model.langs.items() for x in (i, float(model.letters[name])))), F.col("lang")))
    for k in range(1, order + 1):
        each = each.join(model.grams[k - 1].select(F.col("gram").alias(f"g{k}"), F.col("logp").cast("double").alias(f"p{k}")), f"g{k}", "left")
        each = each.join(model.contexts[k - 1].select(F.col("context").alias(f"c{k}"), F.col("logw").cast("double").alias(f"w{k}")), f"c{k}", "left")
        logp = F.coalesce(F.col(f"p{k}"), F.coalesce(f"w{k}", F.lit(0.0)) + logp)
    total = each.select("kn_row", "size", (logp * F.col("n")).alias("x")).groupBy("kn_row").agg(F.max("size").alias("kn_chars"), F.sum("x").alias("kn_logp"))
    scored = rows.join(total, "kn_row", "left").drop("kn_row")
    return scored.withColumns({"kn_chars": F.coalesce("kn_chars", F.lit(0)), "kn_logp": F.coalesce("kn_logp", F.lit(0.0))})


def score(docs: DataFrame, model: Model, shared=None) -> DataFrame:
    """docs' columns (text and lang among them), kn_chars and kn_logp (summed natural log probability); a null text has no
    characters. shared: what share(model) gave, if there is one already."""
    docs = docs.drop("kn_chars", "kn_logp")
    if not model.langs:
        return docs.withColumns({"kn_chars": F.length("text").cast("long"), "kn_logp": F.lit(0.0)})
    shared = shared or share(model)
    if shared is False:
        return _score_by_joins(docs, model)
    schema = T.StructType([*docs.schema.fields, T.StructField("kn_chars", T.LongType()), T.StructField("kn_logp", T.DoubleType())])
    return docs.mapInArrow(_score(shared), schema)


def share(model: Model):
    """The model's tables as a broadcast variable, or False if they have more than MOST_GRAMS rows."""
    tables = [*model.grams, *model.contexts]
    if not model.langs or sum(df.count() for df in tables) > MOST_GRAMS:
        return False
    return tables[0].sparkSession.sparkContext.broadcast(Tables(model))


def nats(mean: dict[str, float]):
    """The score that is compared: mean surprise a character, drawn to the language's mean by PRIOR_CHARS."""
    pairs = [x for k, v in mean.items() for x in (F.lit(k), F.lit(v))]
    usual = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("lang", F.lit(POOLED))), F.lit(mean[POOLED]))
    return (usual * PRIOR_CHARS - F.col("kn_logp")) / (PRIOR_CHARS + F.coalesce("kn_chars", F.lit(0)))


@dataclass
class Limits:
    """Per language (POOLED: any other): mean surprise of trusted text, and the largest score that is kept."""

    mean: dict[str, float]
    most: dict[str, float]

    def keep(self):
        pairs = [x for k, v in self.most.items() for x in (F.lit(k), F.lit(v))]
        most = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("lang", F.lit(POOLED))), F.lit(self.most[POOLED]))
        return nats(self.mean) <= most


def _ids(trusted: DataFrame) -> DataFrame:
    """The trusted ids once each, sent to all tasks up to MOST_IDS of them."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def _quantile(bars: list[tuple[int, int]], q: float) -> int:
    need = math.ceil(q * sum(n for _, n in bars))
    for step, n in sorted(bars):
        need -= n
        if need <= 0:
            return step
    raise ValueError("no bars")


def limits(scores: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> Limits | None:
    """From the scores (doc_id, lang, kn_chars, kn_logp) of all trusted documents that the model hasn't seen; from all
    trusted ones where it has seen each; None without any."""
    known = scores.join(_ids(trusted), "doc_id").where("kn_chars > 0")
    known = written(known.select("lang", "kn_chars", "kn_logp", _is_fitted("doc_id").alias("seen")), "trusted_scores")
    if known.where("NOT seen").head(1):
        known = known.where("NOT seen")
    own = known.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("kn_chars").alias("n"), F.sum("kn_logp").alias("s"))
    # the languages with a threshold of their own
    own = own.where(F.col("docs") >= LEAST_DOCS).orderBy("lang").collect()
    every = known.agg(F.sum("kn_chars").alias("n"), F.sum("kn_logp").alias("s")).first()
    if not every.n:
        return None
    mean = {POOLED: round(-every.s / every.n, 9)} | {r.lang: round(-r.s / r.n, 9) for r in own}
    step = F.ceil(nats(mean) * STEPS).cast("long").alias("step")
    lang = F.when(F.col("lang").isin([r.lang for r in own]), F.col("lang")).otherwise(F.lit(POOLED))
    # a histogram: its size is the range of scores over the step, not the number of documents
    bars = known.select(lang.alias("lang"), step).groupBy("lang", "step").count().collect()
    most = {}
    for name in mean:
        most[name] = _quantile([(b.step, b["count"]) for b in bars if name == POOLED or b.lang == name], quantile) / STEPS + math.log(margin)
    # languages without a threshold of their own: never stricter than their own trusted documents need
    rare = [(b.step, b["count"]) for b in bars if b.lang == POOLED]
    if rare:
        most[POOLED] = max(most[POOLED], _quantile(rare, quantile) / STEPS + math.log(margin))
    return Limits(mean, most)


def quality_scores(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang, n_chars, perplexity (a character), kept.

    trusted: doc_id of trusted documents. Null and empty texts have no characters, a null perplexity, and are kept;
    a null or rare language uses the pooled model and threshold; without trusted documents all are kept; repeated
    rows are each returned; an empty table gives no rows.
    """
    model = fit(docs, trusted)
    # the text itself is not needed any more
    scores = written(score(docs.select("doc_id", "lang", "text"), model).drop("text"), "quality_scores")
    found = limits(scores, trusted, quantile, margin) if model.langs else None
    keep = F.coalesce(found.keep(), F.lit(True)) if found else F.lit(True)
    worth = F.when((F.col("kn_chars") > 0) & F.lit(bool(model.langs)), F.round(F.exp(-F.col("kn_logp") / F.col("kn_chars")), 6))
    return scores.select("doc_id", "lang", F.coalesce("kn_chars", F.lit(0)).cast("long").alias("n_chars"), worth.alias("perplexity"), (keep | (F.coalesce("kn_chars", F.lit(0)) == 0)).alias("kept"))


def drop_low_quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """docs without the documents that quality_scores rejects; columns stay as they are. The texts are not shuffled:
    trusted ones are scored for the thresholds first, then each where it is filtered."""
    model = fit(docs, trusted)
    if not model.langs:
        return docs
    shared = share(model)
    known = docs.select("doc_id", "lang", "text").join(_ids(trusted), "doc_id", "left_semi")
    found = limits(written(score(known, model, shared).drop("text"), "trusted_scores"), trusted, quantile, margin)
    if found is None:
        return docs
    kept = score(docs, model, shared).where(F.coalesce(found.keep(), F.lit(True)) | (F.coalesce("kn_chars", F.lit(0)) == 0))
    return kept.select(*docs.columns)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of labelled documents of good quality that are not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
