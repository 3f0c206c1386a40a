"""Classifier, language model, tokenizer, embeddings and media: brute force, held-out accuracy, exact round trips."""

import math
import random
import tracemalloc
import zlib
from collections import Counter
from hashlib import sha256
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from terralith.llm import embedding_dedup, kneser_ney, matroska, pseudo_likelihood, sentencepiece_viterbi

TABLE = "/root/testdata/sf0.01"


# Kneser-Ney ---------------------------------------------------------------------------------


def kneser_ney_by_force(texts, order, letters):
    """p(character | the order - 1 characters before it), by the definition, from lists and dictionaries."""
    edge = "\0"
    grams = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        laid = edge * (order - 1) + t
        grams[order].update(laid[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):  # how many longer n-grams end so
        grams[k].update(g[1:] for g in grams[k + 1])
    cuts = {}
    for k, count in grams.items():
        n = Counter(count.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = {i: min(max(0.5 if y is None or not n[i] else i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) for i in (1, 2, 3)}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / letters
        own = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        if not own:
            return low
        total = sum(own.values())
        alpha = (own[gram] - cuts[k][min(own[gram], 3)]) / total if gram in own else 0
        return alpha + sum(cuts[k][min(n, 3)] for n in own.values()) / total * low

    return lambda text: sum(math.log(p((edge * (order - 1) + text)[i : i + order])) for i in range(len(text)))


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney_matches_brute_force(spark, monkeypatch, order):
    trusted = ["abracadabra abba cab", "日本語の文と 🙂 a cab", "abba"]
    others = ["abrabab", "語の語 zq", "", None, "🙂" * 5, "cab " * 400]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(trusted + others)], "doc_id long, text string, lang string")
    model = kneser_ney.fit(docs, spark.createDataFrame([(0,), (1,), (2,)], "doc_id long"), order=order)
    fitted = {r[0] for r in kneser_ney.fitted_ids(spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")).collect()}
    seen = [t for i, t in enumerate(trusted) if i in fitted]
    want = kneser_ney_by_force(seen, order, len(set("".join(seen))) + 1)
    sent = {r.doc_id: (r.kn_chars, r.kn_logp) for r in kneser_ney.score(docs, model).collect()}
    monkeypatch.setattr(kneser_ney, "MOST_GRAMS", 0)
    joined = {r.doc_id: (r.kn_chars, r.kn_logp) for r in kneser_ney.score(docs, model).collect()}
    for i, t in enumerate(trusted + others):
        assert sent[i][0] == joined[i][0] == len(t or "")
        assert math.isclose(sent[i][1], want(t or ""), rel_tol=1e-5, abs_tol=1e-6) and math.isclose(joined[i][1], want(t or ""), rel_tol=1e-5, abs_tol=1e-6), t


def test_each_language_has_its_own_model(spark, monkeypatch):
    """Also a ninth language, and scripts with more than forty letters."""
    monkeypatch.setattr(kneser_ney, "LEAST_CHARS", 500)
    rng = random.Random(2)
    words = {f"l{i:02}": ["".join(chr(0x4E00 + 60 * i + rng.randrange(60)) for _ in range(3)) for _ in range(30)] for i in range(12)}
    data = [(f"l{i % 12:02}", " ".join(rng.choice(words[f"l{i % 12:02}"]) for _ in range(60))) for i in range(480)]
    data += [(lang, " ".join("".join(rng.sample(w, 3)) for w in rng.choices(words[lang], k=60))) for lang in words for _ in range(4)]  # letters mixed up
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in kneser_ney.quality_scores(docs, docs.where("doc_id < 480").select("doc_id")).collect()}
    assert sum(got[i] for i in range(480)) >= 470 and sum(got[i] for i in range(480, 528)) <= 5


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{TABLE}/{t}.parquet") for t in ("documents", "labels"))
    trusted = kneser_ney.trusted_ids(labels).where("doc_id % 2 = 0")
    got = kneser_ney.quality_scores(docs, trusted).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.3


def test_classifier_edges(spark):
    schema = "doc_id long, text string, lang string, kn_chars string"
    data = [(1, "plain words of text " * 30, "en", "c"), (2, None, None, "c"), (3, "", "en", "c"), (4, "§§§ ### " * 40, "zz", "c"), (None, "plain words", None, "c"), (1, "plain words of text " * 30, "en", "c")]
    df = spark.createDataFrame(data, schema)
    trusted = spark.createDataFrame([(1,), (None,), (99,)], "doc_id long")
    got = kneser_ney.quality_scores(df, trusted).collect()
    assert len(got) == 6 and all(r.kept and r.perplexity is None for r in got if r.n_chars == 0)
    assert [r.kept for r in got if r.doc_id == 4] == [False]
    left = kneser_ney.drop_low_quality(df, trusted)
    assert left.columns == ["doc_id", "text", "lang", "kn_chars"] and left.count() == 5
    assert kneser_ney.drop_low_quality(df, trusted.limit(0)).count() == 6
    assert kneser_ney.quality_scores(df.limit(0), trusted).count() == 0


# Pseudo-likelihood ---------------------------------------------------------------------------


def test_pseudo_likelihood_sums_what_a_loop_sums(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.3, pseudo_likelihood._SIZE).astype(np.float32)
    texts = ["a b c d e", "", "one", "b a b a b a", " \n "]
    net = pseudo_likelihood.Network(np.empty(0, np.uint64), np.empty(0, np.int64), weights)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.r_[0, np.cumsum([len(t) for t in texts])]
    got, sizes = pseudo_likelihood.log_probabilities(net, data, cuts)
    tokens, _ = pseudo_likelihood.tokens_of(net, data, cuts)
    p, at, k = net.parts(), 0, pseudo_likelihood.SIDE
    for n in sizes:
        own = [pseudo_likelihood.TOKENS] * k + list(tokens[at : at + n]) + [pseudo_likelihood.TOKENS] * k
        for i in range(n):
            x = np.concatenate([p["embed"][own[i + k + o]] for o in pseudo_likelihood._OFFSETS])
            h = np.tanh(x @ p["w1"] + p["b1"])
            a, b = divmod(int(own[i + k]), pseudo_likelihood.WITHIN)
            la, lb = h @ p["wc"] + p["bc"], h @ p["ww"] + p["bw"][a]
            want = la[a] - np.log(np.exp(la).sum()) + lb[b] - np.log(np.exp(lb).sum())
            assert math.isclose(got[at + i], want, abs_tol=1e-3)
        at += n


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    net = pseudo_likelihood.Network(np.empty(0, np.uint64), np.empty(0, np.int64), rng.normal(0, 0.3, pseudo_likelihood._SIZE))
    context, target = rng.integers(0, 50, (6, 4)), rng.integers(0, 50, 6)
    loss = lambda: -pseudo_likelihood.forward(net.parts(), context, target)[0].astype(float).mean()
    g = pseudo_likelihood.gradient(net.parts(), context, pseudo_likelihood.forward(net.parts(), context, target)[1])
    for i in np.flatnonzero(np.abs(g) > 0.01)[::97]:
        old, eps = net.weights[i], 1e-3
        net.weights[i] = old + eps
        up = loss()
        net.weights[i] = old - eps
        down = loss()
        net.weights[i] = old
        assert math.isclose((up - down) / (2 * eps), g[i], rel_tol=0.05, abs_tol=2e-3)


PAIRS = ["red apple pie", "blue river bank", "green tree top", "dark night sky"]


def test_network_learns_both_sides():
    rng = random.Random(3)
    text = " ".join(rng.choice(PAIRS) for _ in range(1500)).encode()
    data, cuts = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    weights = np.random.default_rng(0).normal(0, 0.1, pseudo_likelihood._SIZE).astype(np.float32)
    trainer = pseudo_likelihood.Trainer(pseudo_likelihood.Network(np.empty(0, np.uint64), np.empty(0, np.int64), weights))
    laid, place = pseudo_likelihood.windows(*pseudo_likelihood.tokens_of(trainer.net, data, cuts))
    for _ in range(200):
        trainer.learn(laid[place[:, None] + pseudo_likelihood._OFFSETS], laid[place])
    logp, _ = pseudo_likelihood.log_probabilities(trainer.net, data, cuts)
    assert np.exp(-logp.mean()) < 1.5  # of 12 words; what stands beside a word tells it


def test_language_model_job(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(PAIRS) for _ in range(200))) for i in range(120)] + [(900, None), (901, ""), (None, "red apple pie"), (902, "apple red pie " * 200)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    assert len(got) == 124 and got[900].n_tokens == 0 and got[900].pseudo_perplexity is None and got[901].pseudo_logp == 0
    assert got[5].pseudo_perplexity < 12 and got[None].n_tokens == 3
    assert pseudo_likelihood.pseudo_likelihood(docs.limit(0)).count() == 0


def test_words_outside_the_vocabulary_have_their_own_probability(spark):
    # 900 words of one ending, so that over 100 stand outside the vocabulary; two of them told apart only by themselves
    common = " ".join(f"{i:04d}xyz" for i in range(900))
    data = [(i, common) for i in range(6)] + [(6, "rareaxyz " * 3), (7, "0001xyz rareaxyz 0002xyz"), (8, "0001xyz rarebxyz 0002xyz"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    net, counts = pseudo_likelihood.fit(docs.select("text"))
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, net, counts).collect()}
    assert len(got) == len(data) and got[None].n_tokens == 0
    # counted 4 times and once
    assert math.isclose(got[7].pseudo_logp - got[8].pseudo_logp, math.log(4), abs_tol=2e-3)
    seen = Counter(w for _, t in data for w in (t or "").split())
    for i, text in data[6:9]:
        cuts = np.array([0, len(text)])
        logp, _ = pseudo_likelihood.log_probabilities(net, np.frombuffer(text.encode(), np.uint8), cuts)
        tokens, _ = pseudo_likelihood.tokens_of(net, np.frombuffer(text.encode(), np.uint8), cuts)
        every = " ".join(seen).encode()
        kinds = dict(zip(seen, pseudo_likelihood.tokens_of(net, np.frombuffer(every, np.uint8), np.array([0, len(every)]))[0]))
        want = sum(float(p) + (math.log(seen[w] / sum(n for v, n in seen.items() if kinds[v] == k)) if k >= pseudo_likelihood.TOKENS - pseudo_likelihood.ENDINGS else 0) for w, p, k in zip(text.split(), logp, tokens))
        assert math.isclose(got[i].pseudo_logp, want, abs_tol=5e-3)
    # a word that was never counted is as likely as one counted once
    new = pseudo_likelihood.score(spark.createDataFrame([(1, "0001xyz newxyz 0002xyz")], "doc_id long, text string"), net, counts).first()
    assert math.isclose(new.pseudo_logp, got[8].pseudo_logp, abs_tol=2e-3)


def test_every_word_is_a_target_in_each_round():
    texts = [" ".join(f"w{i}" for i in range(j, j + 700)) for j in range(0, 7000, 700)] + ["", None, "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    net = pseudo_likelihood.Network(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(pseudo_likelihood._SIZE, np.float32))
    for turn in range(pseudo_likelihood.ROUNDS):
        with mock.patch.object(pseudo_likelihood.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
            got = list(pseudo_likelihood._train(mock.Mock(value=net), turn)(iter([batch])))
        assert {x.column(2)[0].as_py() for x in got} == {7001.0}


# SentencePiece -------------------------------------------------------------------------------


def test_ids_equal_the_librarys(spark):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{TABLE}/documents.parquet").limit(150).collect()]
    texts += ["".join(rng.choice("abcdefghi aa  tnosr▁ÀÉ日本語🙂\n\t.,!?0123") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "   ", "▁", "a" * 300, " " * 40 + "y", "<s>", "<0x41>", "\x00", "x " * 3000]
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    ids = sentencepiece_viterbi.encode(p, texts)
    assert [i.tolist() for i in ids] == library.encode(texts)
    assert [sentencepiece_viterbi.decode(p, i) for i in ids] == library.decode([i.tolist() for i in ids])


def test_long_words():
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("etaoinshr", "ab", "日本語é🙂abc", "a") for n in (513, 700, 3000)]
    texts += [f"start {texts[0]} {texts[6]}  end", "".join(rng.choice("the and of ing".split()) for _ in range(20_000))]
    for text, ids in zip(texts, sentencepiece_viterbi.encode(p, texts)):
        assert ids.tolist() == library.encode(text)
    for unigram in (False, True):  # the long way and the batched one agree
        p.unigram = unigram
        for word in ("tion" * 30, "xyz\u2603the" * 9, "▁Information" * 4):
            points = np.array([[ord(c) for c in word]], np.uint64)
            assert sentencepiece_viterbi._long_word(p, word) == sentencepiece_viterbi._viterbi(p, points)[0]


def test_unigram_viterbi_is_the_best_path():
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    p.unigram = True
    rng = random.Random(2)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("abcdenorst") for _ in range(rng.randint(1, 12)))
        best = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - p.longest), j):
                k = p.lookup.get(word[i:j])
                if k is not None:
                    best[j] = max(best[j], best[i] + float(p.scores[k]))
        ids = sentencepiece_viterbi.encode(p, [word[1:]])[0]
        assert "".join(p.pieces[i] for i in ids) == word and sum(float(p.scores[i]) for i in ids) == best[-1]


def test_token_columns(spark):
    df = spark.createDataFrame([(1, "some text", "c"), (2, None, "c"), (3, "", "c"), (None, "x", "c"), (1, "some text", "c")], "doc_id long, text string, token_ids string")
    ids = sentencepiece_viterbi.encode_column(df)
    assert ids.columns == ["doc_id", "text", "token_ids"]
    back = {(r.doc_id, r.text): r.decoded for r in sentencepiece_viterbi.decode_column(ids).collect()}
    assert all(text == decoded for (_, text), decoded in back.items())
    digest = sentencepiece_viterbi.token_digest(df).collect()
    assert sorted(r.n_tokens for r in digest if r.n_tokens is not None)[0] == 0 and len(digest) == 5
    assert sentencepiece_viterbi.token_digest(df.limit(0)).count() == 0


# Embeddings ----------------------------------------------------------------------------------


def test_embedding_links_are_exact(spark, monkeypatch):  # both numbers are read on the driver only
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(0)
    data = []
    for i in range(500):
        centre = np.random.default_rng(i % 40).normal(size=12)
        data.append((i, [float(x) for x in centre + rng.normal(0, 0.22, 12)], i % 3 if i % 17 else 0, 1, "c"))
    data += [(600 + i, data[5][1], data[5][2], 1, "c") for i in range(4)]
    data += [(700, None, 0, 1, "c"), (701, [0.0] * 12, 0, 1, "c"), (702, [float("nan")] * 12, 0, 1, "c"), (703, [None] * 12, 0, 1, "c"), (704, data[5][1], None, 1, "c"), (705, [], 0, 1, "c"), (706, [1.0, 2.0], 0, 1, "c"), (707, [2.0, 4.0], 0, 1, "c"), (708, [float("inf")] * 12, 0, 1, "c")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, cell int, rep string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df).collect()}
    good = [(i, np.array(e), k) for i, e, k, *_ in data if e and k is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    near = {i: set() for i, *_ in data}
    for i, a, k in good:
        for j, b, m in good:
            if i != j and k == m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                near[i].add(j)
    least = {i: i for i in near}
    for _ in near:
        new = {i: min([least[i], *(least[j] for j in near[i])]) for i in near}
        if new == least:
            break
        least = new
    assert sum(map(len, near.values())) > 400
    for i in near:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), least[i], least[i] == i), i
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0


def test_quality_model_counts_all_trusted_documents(spark, monkeypatch):
    trusted = spark.range(12_000).withColumnRenamed("id", "doc_id")
    fitted = {r[0] for r in kneser_ney.fitted_ids(trusted).collect()}
    assert 9_000 < len(fitted) < 10_200  # all but those held out, one in five
    # a word of its own in each document: each is in the model, by either join of the ids
    docs = trusted.select("doc_id", F.concat(F.lit("w"), F.conv(F.col("doc_id"), 10, 36)).alias("text"), F.lit("en").alias("lang"))
    want = {r[0]: r.n for r in docs.where(F.col("doc_id").isin(list(fitted))).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()}
    sent = {}
    monkeypatch.setattr(kneser_ney, "smoothed", lambda counts, order, letters: (sent.update({r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}), ([], []))[1])
    for most in (1_000_000, 0):
        monkeypatch.setattr(kneser_ney, "MOST_IDS", most)
        kneser_ney.fit(docs, trusted)
        assert set(sent.values()) == {sum(want.values())}


def test_counts_held_by_a_task_add_up():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdef "), 400)) for _ in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 1500), pa.array(texts[i : i + 1500])], names=["lang", "text"]) for i in (0, 1500)]
    counted = [pa.Table.from_batches(list(kneser_ney._count_grams(4, {"": 0, "en": 1}, most)(iter(batches)))) for most in (10, 1_000_000)]
    assert counted[0].num_rows > counted[1].num_rows == len(set(counted[1]["g4"].to_pylist()))
    one, two = (t.group_by(["lang", "g4", "g3", "g2", "g1", "c4", "c3", "c2", "c1"]).aggregate([("n", "sum")]).to_pandas() for t in counted)
    assert len(one.merge(two)) == len(one) == len(two) and one.n_sum.sum() == 2 * sum(map(len, texts))


def test_memory_of_a_task():
    """Peak while n-grams of a block are counted, and while repeated words are encoded: workers of two tasks share an executor."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(20)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    assert peak(lambda: [None for _ in kneser_ney._count_grams(4, {"": 0, "en": 1})(iter([batch]))]) < 45
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    ids = sentencepiece_viterbi.encode(p, texts)
    assert len(p.known) < 1000  # only pairs that share a slot
    assert peak(lambda: sentencepiece_viterbi.encode(p, texts * 4)) < 15
    assert [x.tolist() for x in sentencepiece_viterbi.encode(p, texts)] == [x.tolist() for x in ids]


def test_slots_that_several_share(monkeypatch):
    """Pieces and pairs are found by slot; where slots are shared, by search and memory, to the same ids."""
    texts = ["the quick brown fox", "Überraschung, naïve 北京 ok", "a" * 40 + " zzz qqq"]
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    assert (p.places(p.keys) == np.arange(len(p.keys))).all() and p.places(p.keys[::7] + np.uint64(1)).min() >= 0
    want = [x.tolist() for x in sentencepiece_viterbi.encode(p, texts)]
    monkeypatch.setattr(sentencepiece_viterbi, "_slot", lambda x: (x % np.uint64(3)).astype(np.int64))
    p = sentencepiece_viterbi.load(sentencepiece_viterbi.MODEL)
    assert (p.places(p.keys) == np.arange(len(p.keys))).all()
    assert [x.tolist() for x in sentencepiece_viterbi.encode(p, texts)] == want


def test_embeddings_of_repeated_ids(spark):
    data = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "b"), (4, [1.0, 1.0], "c"), (4, [1.0, 1.01], "c")]
    got = embedding_dedup.embedding_near_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


# Media ---------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = ["", None, "x" * 64, "y" * 65, "é🙂" * 999, "z" * 300_000, "x" * 64]
    got = matroska.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 7
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert "error" not in r.feature
    assert got[2].media_sha256 == got[6].media_sha256
    assert matroska.media_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["none", "xiph", "fixed", "ebml"])
def test_lacings_and_faults(kind):
    sizes = {"none": [700], "fixed": [64] * 3, "xiph": [300, 5, 511, 40], "ebml": [300, 5, 511, 40]}[kind]
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    code = matroska.LACINGS.index(kind)
    if kind == "xiph":
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        body = head + b"".join(frames)
    else:
        made, body = matroska.laced(frames)
        assert made == code
    block = b"\x81" + (5).to_bytes(2, "big") + bytes([code << 1]) + body
    cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 1000) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.number(matroska.REFERENCE, 1)))
    unknown = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7  # a segment of unknown size
    data = matroska._HEAD + unknown + matroska._TRACKS + cluster
    found = matroska.parse(data)
    assert found["error"] is None and [data[p[2] : p[2] + p[3]] for p in found["packets"]] == frames
    assert found["packets"][0][1] == 1005 * 10**6 and not found["packets"][0][4] and found["packets"][0][5] == kind
    for cut in range(0, len(data), 37):  # cut files give what came before, never an exception
        part = matroska.parse(data[:cut])
        assert len(part["packets"]) <= len(frames)


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 5000), "c"), (2, None, "c"), (3, bytearray(b""), "c")], "doc_id long, payload binary, packet string")
    media = matroska.to_matroska(df)
    rows = matroska.packet_table(media, ["doc_id"]).where("doc_id = 1").orderBy("packet").collect()
    assert [r.n_bytes for r in rows] == [512] * 9 + [392] and rows[8].timestamp_ns == 512 * 10**6
    bad = media.withColumn("media", F.lit(b"\x00garbage"))
    assert {r.error is None for r in matroska.read_matroska(bad).select("parsed.error").collect()} == {False}
