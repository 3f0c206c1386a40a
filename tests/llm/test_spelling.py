"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from terralith.llm.queries import ORACLE_SQL, QUERIES
from terralith.llm.spelling import near_words, roots, spelling_variants, word_blocks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def by_force(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        out[w] = (form[w], last, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def made(seed, n_docs, alphabet="abcé", most=9):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, most))) for _ in range(40)]
    docs = []
    for i in range(n_docs):
        text = []
        for _ in range(rng.randint(0, 120)):
            w = stems[min(int(rng.expovariate(0.15)), len(stems) - 1)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            text.append(w.capitalize() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "1", "\n"]).join(text)))
    return docs


def test_all_pairs(spark):
    docs = [*made(1, 200), (None, "qqqqqqq " * 6), (500, None), (501, ""), (502, "×bcdef÷ " * 7), (503, "z" * 30_000 + " " + ("z" * 29_999 + " ") * 6), (503, "z" * 30_000), *[(504 + i, "Z" * 30_000) for i in range(4)]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    want = by_force(counted(docs))
    assert got == want and sum(v[3] > 0 for v in want.values()) > 50 and any(v[1] != w for w, v in want.items())
    assert "z" * 30_000 in got or "z" * 29_999 in got


@pytest.mark.parametrize("large", [3, 40])
def test_crowded_blocks_are_divided(spark, large):
    rng = random.Random(large)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))): rng.randint(5, 90) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = word_blocks(df, large).groupBy("bid", "r").count().collect()
    assert all(r["count"] <= large for r in sizes if r.r > 1)
    got = {r.word: (r.n_near, r.best, r.best_n) for r in near_words(df, large).collect()}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert got == {w: (len(v), b := min(v, key=lambda x: (-words[x], x)), words[b]) for w, v in near.items() if v}


def test_long_chains_and_empty_tables(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(17)], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"w17"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    found = con.sql(ORACLE_SQL["op11_spelling_variants"])
    got = QUERIES["op11_spelling_variants"](spark, tiny).select(*found.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(found.fetchall()) and len(rows) > 100
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
