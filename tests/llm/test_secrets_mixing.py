"""Secret scan against a brute-force scan, and mixing against its own draw."""

import hashlib
import math
import re
from collections import Counter

from terralith.llm.mixing import poisson_mix
from terralith.llm.secret_scan import SCOPE, secret_digest, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "AKIA" + "ABCDEFGH12345678"


def base(text):
    found = []
    for k, (kind, rx, group, least) in enumerate((("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        found += [(m.start(), k, kind, m.end()) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
    found.sort()
    return Counter(f[2] for f in found), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


TEXTS = [
    f"🙂 token = 'abcdefghijklmnop' and {KEY} deadbeefdeadbeef0", "secret:short", "api_key=1234567", f"user: alice {'.' * 50} password = hunter22 https://db.example.org/x",
    f"password = hunter22 {'.' * (SCOPE + 60)} https://far.example.org/x", "AKIA123 token=abc12 ", "password=password=abcdefghijkl", "0123456789abcdef" * 3, "xAKIA" + "Z" * 30, "", None,
    "PASSWD: " + "x" * 11 + " PASSWD: " + "x" * 12, "token token=aaaaaaaaaaaaa\n\ntoken  =  \"bbbbbbbbbbbbb\"", "é" * 100 + "ApiKey=ZZZZZZZZZZZZZZ", "deadbeefdeadbee", "a" * 70000 + " secret=" + "q" * 20,
]


def test_base_spans_and_linked_parts(spark):
    data = [(i, t, "x", "x", "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", "x", "x", 1), (0, TEXTS[0], "x", "x", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, found string, kind string, scan_key string, start int")
    got = secret_digest(df).collect()
    assert len(got) == len(data)
    for r in got:
        counts, sha = base(TEXTS[r.doc_id or 0])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (counts["assign"], counts["access"], counts["hex"], sha), r
    by = {r.doc_id: r for r in got}
    assert [s.split(":")[0] for s in by[3].spans.split(",")] == ["weak_access", "weak_assign", "endpoint"]  # parts of one credential
    assert by[4].spans == "" and by[1].spans == ""  # too far apart; alone
    assert "weak_access" in by[5].spans and "weak_assign" in by[5].spans
    spans = secret_scan(df.where("doc_id = 3")).collect()
    assert {r.kind: tuple(r.partners) for r in spans} == {"weak_access": ("secret",), "weak_assign": ("endpoint", "identifier"), "endpoint": ("secret",)}
    assert secret_scan(spark.createDataFrame([(1, "user: alice https://db.example.org/x")], "doc_id long, text string")).count() == 0  # no secret
    assert all(TEXTS[3][r.start : r.stop] == r.value for r in spans)
    assert secret_digest(df.limit(0)).count() == 0 and secret_scan(df.limit(0)).count() == 0


def test_very_many_matches_of_one_text(spark):
    text = "x".join(f"{i:016x}" for i in range(30_000)) + " user: bob token = short " + "g".join(f"{i:08x}" for i in range(3000))
    (r,) = secret_digest(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    counts, sha = base(text)
    assert r.n_hex == counts["hex"] == 30_000 and r.base_sha256 == sha and r.n_linked == 2


def drawn(seed, key, rate):
    u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    p = cdf = math.exp(-rate)
    n = 0
    while cdf <= u and n < 10_000:
        n += 1
        p *= rate / n
        cdf += p
    return n


def test_mix_draws_poisson_counts(spark):
    data = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}" if i % 5 else None, i, "c") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mix_source long, mix_copy string")
    sizes = Counter(r[2] for r in data)
    got = poisson_mix(df, seed="a")
    assert set(got.columns) == set(df.columns)
    counts = Counter(r.doc_id for r in got.collect())
    for i, _, s, *_ in data:
        assert counts[i] == drawn("a", i, len(data) / len(sizes) / sizes[s])
    share = Counter(r.source for r in got.collect())
    assert all(abs(n - len(data) / len(sizes)) < 5 * math.sqrt(len(data)) for n in share.values())
    only = poisson_mix(df, {"hot": 3.0, "s0": 1.0}, total=1000, seed="b").collect()
    assert {r.source for r in only} == {"hot", "s0"} and 850 < len(only) < 1150


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    many = poisson_mix(df, {"a": 1.0}, total=1800.0).collect()
    assert 1500 < len(many) < 2200 and not [r for r in many if r.source is None]  # means of 600
    assert poisson_mix(df.limit(0)).count() == 0
    assert poisson_mix(df, {}).count() == 0
    order = [r.doc_id for r in poisson_mix(spark.range(2000).selectExpr("id AS doc_id", "'s' AS source")).collect()]
    assert order != sorted(order)


def test_mix_draws_large_means(spark):
    rows, mean = 60, 5000.0
    df = spark.createDataFrame([(i, "small") for i in range(rows)], "doc_id long, source string")
    got = poisson_mix(df, total=rows * mean, seed="large", shuffle=False).groupBy("doc_id").count().collect()
    counts = {r.doc_id: r["count"] for r in got}
    for i in range(rows):
        u = int(hashlib.md5(f"large:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n = cdf = 0
        while (cdf := cdf + math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))) <= u:
            n += 1
        assert abs(counts[i] - n) <= 1  # one: where u stands at a step's very edge
    middle = sum(counts.values()) / rows
    spread = sum((n - middle) ** 2 for n in counts.values()) / (rows - 1)
    assert 0.5 * mean < spread < 2 * mean and abs(middle - mean) < 5 * math.sqrt(mean / rows)
