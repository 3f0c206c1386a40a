"""Substring, line and near-duplicate dedup against brute force, with every awkward row at once."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from terralith.llm import components as components_module
from terralith.llm import line_dedup as line_module
from terralith.llm import minhash
from terralith.llm.common import written
from terralith.llm.components import components
from terralith.llm.line_dedup import line_dedup
from terralith.llm.minhash import band_count, drop_near_duplicates, most_odd_bits, near_duplicates
from terralith.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, id string, row string, component string, __cut string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(seed=0):
    """Copies, near copies, shared passages, short, empty, null, long and non-ASCII texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéüß日🙂XYZ") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(60, 140))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(base[i % 4]) for i in range(8)]
    for i in range(40):
        near = list(base[i % 6])
        for _ in range(rng.randint(1, 8)):
            near[rng.randrange(len(near))] = word()
        texts.append("\t".join(near) if i % 3 else " ".join(near).upper())
    passage = " ".join(word() for _ in range(70))
    texts += [f"{' '.join(word() for _ in range(30))}\n{passage}\n{word()}" for _ in range(6)]
    texts += ["same same " * 80, "same same " * 60, "", None, " \n\t ", "one", "one", "two words", "\x0b\x0c", "x" * 5000, " ".join(word() for _ in range(9000))]
    out = [(i * 3 + 1, t, "en", f"s{i % 7}", len(t or ""), 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, (None, texts[0], None, None, 1, 1, "c", "c", "c", "c"), out[0]]  # a null id, a row twice


def test_substring_dedup(spark):
    data = rows()
    k = 20
    least = {}
    for i, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - k + 1):
            least.setdefault(tuple(w[j : j + k]), i)
    want = []
    for i, t, *_ in data:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup(spark.createDataFrame(data, SCHEMA).repartition(3), k).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 500
    for r in got:
        assert sum(s.n_words for s in r.intervals) == r.n_removed
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def near_by_force(data, n, percent):
    sets = {}
    for i, t, *_ in data:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    data = rows(n)
    want = near_by_force(data, n, percent)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = near_duplicates(df, n, percent).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sum(not r.kept for r in got) > 10
    left = drop_near_duplicates(df, n, percent)
    assert left.columns == df.columns
    assert left.count() == sum(r.kept for r in got)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_far_from_their_lead_are_still_decided(spark):
    """A chain in which each text is near the next but far from the first: one component by its links."""
    base = [f"w{i}" for i in range(200)]
    data = []
    for step in range(8):
        t = list(base)
        for i in range(step * 3):
            t[i * 7 % 200] = f"x{i}"
        data.append((step, " ".join(t)))
    full = [(*r, None, None, None, None, None, None, None, None) for r in data]
    want = near_by_force(full, 3, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in want.items()}
    assert len(set(got.values())) < 8


@pytest.mark.parametrize("edits", [(1, 4), (5, 6)])
def test_a_large_group_makes_rows_in_proportion(spark, monkeypatch, edits):
    """Near copies above and below the threshold: twice the copies make at most about twice the rows in every table."""
    made = {}
    for size in (200, 400):
        rng = random.Random(3)
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        data = []
        for i in range(size):
            t = list(base)
            for _ in range(rng.randint(*edits)):
                t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            data.append((i, " ".join(t)))
        made[size] = defaultdict(int)

        def counted(df, name, own=made[size]):
            out = written(df, name)
            own[name] = max(own[name], out.count())
            return out

        monkeypatch.setattr(minhash, "written", counted)
        monkeypatch.setattr(components_module, "written", counted)
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()}
        if size == 200:
            want = near_by_force([(*r, None) for r in data], 3, 85)
            assert got == {i: c for i, (_, c) in want.items()}
        assert (len(set(got.values())) < size / 2) == (edits[0] == 1)
    assert sum(made[400].values()) <= 2.5 * sum(made[200].values()), made
    for name, n in made[400].items():
        assert n <= band_count(0.85) * 400, name


def test_overlaps():
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 3000, rng.integers(0, 90))) for _ in range(m)] for m in (17, 23))
    assert (minhash._overlaps(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()
    assert minhash._overlaps(x, [np.empty(0, np.int64)]).sum() == 0


def test_odd_sketch_bounds():
    assert [minhash.band_rows(n) for n in (0, 1000, 10**6, 10**7, 10**10)] == [4, 4, 4, 5, 8]
    assert band_count(0.85) >= 20
    assert 0 < most_odd_bits(0.85, 88) < 256


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 5), (7, 7), (200, 100), (300, 250)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert (got[100], got[101], got[200], got[250], got[300], got[559]) == (100, 100, 100, 250, 250, 500)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(4)
    common = ["All rights  reserved.", "Sign in\tto read", "  footer  "]
    data = []
    for i in range(60):
        lines = [f"unique {rng.random()} body text that is long enough to stay" for _ in range(4)]
        lines.insert(rng.randrange(4), common[i % 3])
        data.append((i, "\n".join(lines), "en", f"site{i % (4 if i % 3 == 2 else 7)}", 0, 1, "c", "c", "c", "c"))
    data += [(100 + i, "the whole copy\nstands on many sites", "en", f"site{i}", 0, 1, "c", "c", "c", "c") for i in range(9)]
    data += [(200, None, None, None, 0, 1, "c", "c", "c", "c"), (201, "", "en", "a", 0, 1, "c", "c", "c", "c"), (202, "\n\n", "en", None, 0, 1, "c", "c", "c", "c"), (None, "only\nhere", None, None, 0, 1, "c", "c", "c", "c"), data[0]]
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).strip(" ")
    sites = defaultdict(set)
    for _, t, _, s, *_ in data:
        for x in (t or "").split("\n"):
            if s is not None:
                sites[norm(x)].add(s)
    want = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not norm(x) or len(sites[norm(x)]) < 5]
        want.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    df = spark.createDataFrame(data, SCHEMA)
    got = line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_cut"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_cut) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[3] for w in want) > 30
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    # documents of nothing but boilerplate stay whole on demand; the shuffle join cuts the same lines as the broadcast
    monkeypatch.setattr(line_module, "BROADCAST_LINES", 0)
    whole = {r.doc_id: (r.text, r.n_cut) for r in line_dedup(df, keep_whole=True).collect()}
    for i, t, _, n in want:
        own = any(norm(x) for x in (t or "").split("\n"))
        assert whole[i] == ((t, n) if own else (next(r[1] for r in data if r[0] == i), 0))


def test_line_dedup_of_a_document_with_very_many_lines(spark):
    text = "\n".join(f"own {i}" if i % 3 else "Subscribe" for i in range(60_000))
    data = [(1, text, "a")] + [(i, "Subscribe", f"s{i}") for i in range(2, 9)]
    got = {r.doc_id: (r.text, r.n_cut) for r in line_dedup(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[1] == ("\n".join(f"own {i}" for i in range(60_000) if i % 3), 20_000) and got[2] == ("", 1)
