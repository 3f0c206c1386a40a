"""Toxicity: held-out accuracy, scores against a plain recomputation, awkward rows."""

import random
import zlib

import pytest
import zstandard
from terralith.llm import toxicity as tox
from terralith.llm.queries import QUERIES

INSULTS = "jerkface nitwitty blockheaded dimwitted lowlifes scumbaggy".split()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mir", "ten", "su", "bra", "ein", "zo", "pel", "ti", "ña"]
    frequent = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(frequent) if rng.random() < 0.8 else "".join(rng.choice(syllables) for _ in range(4)) for _ in range(rng.randint(5, 300))]
        bad = rng.random() < 0.25
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS).upper() if rng.random() < 0.2 else rng.choice(INSULTS))
        docs.append((i, " ".join(words) + ".", "en", 0.5))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_plain_scores(spark):
    docs, labels = corpus(1, 900)
    extra = [(2000, None, None, None), (2001, "", "en", 1.0), (None, docs[0][1], "en", 1.0), (3, docs[3][1], "de", 0.0), (2002, "jerkface " * 40_000 + "dimwitted", "en", 0.0), (2003, "x" * 500_000, "en", 0.0)]
    df = spark.createDataFrame([*docs, *extra], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (2001, 0, None), (None, 1, 1), (2002, 1, 7)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(df, marks).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    own = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(own) > 120 and sum(p == y for p, y in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (fold("" if r.doc_id is None else r.doc_id) == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2000][0].score == by[2001][0].score < 0.5 and len(by[3]) == 2 and len({r.score for r in by[3]}) == 1
    assert by[None][0].score == by[0][0].score and by[2002][0].predicted == 1 and by[2003][0].predicted == 0
    # the definition, from the model's parts
    model = tox.fit(df.select("doc_id", "text"), marks)
    assert any(w.encode() in model.toxic for w in INSULTS)
    one = lambda d, w: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(b" " + w + b" " + tox._PAD))
    for i, text, _, _ in docs[:15]:
        found = sorted((one(model.ordinary, w) - one(model.toxic, w) for w in set(tox.windows(text.encode()))), reverse=True)
        top = [min(max(d, 0), tox.CLIP) for d in [*found, 0, 0, 0][:3]]
        assert by[i][0].score == pytest.approx(float(model.score(tox._shaped([top]))[0])) and by[i][0].distance == top[0]


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = corpus(2, 300)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - y if fold(i) == 0 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, tox.toxicity(df, spark.createDataFrame(x, schema)).collect())) for x in (labels, turned))
    assert a == b


def test_few_or_no_labels(spark):
    df = spark.createDataFrame([(i, f"word {i}") for i in range(6)], "doc_id long, text string")
    schema = "doc_id long, toxic int"
    for labels in ([], [(1, 0), (2, 0)], [(i, 1) for i in range(6)], [(i, i % 2) for i in range(6)]):
        got = tox.toxicity(df, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert tox.toxicity(df.limit(0), spark.createDataFrame([], schema)).count() == 0
    assert tox.windows(b"You IDIOT, you.\n\xc3\x9c a-b", 2) == [b"you idiot", b"you \xc3\x9c", b"a b"] and tox.windows(b"") == []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op13_toxicity"](spark, d)
    assert dict(got.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes)
    rows = {r.doc_id: r for r in got.collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.toxic for r in labels) / len(labels) > 0.93
