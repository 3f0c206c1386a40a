"""Conversation repair against a plain dynamic program over strings, and that against all edits of short conversations."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import pytest
from terralith.llm.conversations import CODES, repair_conversations
from terralith.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, kind string, at long"
GAP = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        one = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [one] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(GAP)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repaired(rows, found):
    """Cheapest, least audit: strings all the way."""
    best = {"": (0, "", ())}  # what the roles read so far, only its last two letters matter

    def inserted(best):
        for _ in range(3):
            for key, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                    put(best, key, role[0], new)

    def put(best, key, initial, new):
        if initial and {"": "su", "s": "u", "u": "a", "a": "u"}[key].find(initial) < 0 or initial not in ("s", "u", "a"):
            return
        if initial not in best or new[:2] < best[initial][:2]:
            best[initial] = new

    for (_, _, role, text), fault in zip(rows, found):
        inserted(best)
        after = {}
        for key, (cost, audit, lines) in best.items():
            new = (cost + 2, audit + "D", lines)
            if key not in after or new[:2] < after[key][:2]:
                after[key] = new
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(after, key, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    put(after, key, name[0], (cost + more + 1, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    inserted(best)
    return min((best[k] for k in ("", "a") if k in best), key=lambda x: x[:2])


def all_edits(rows, found):
    """Every sequence of edits with up to two inserts in a place."""
    names = ("user", "assistant")
    runs = [r for n in range(3) for r in product(names, repeat=n)]
    choices = []
    for (_, _, role, text), fault in zip(rows, found):
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            own += [("K", more, (role[:1], f"{role}:{text}"))] + [("R", 1 + more, (n[0], f"{n}:{text}")) for n in names]
        choices.append([(5 * len(r) + c, "I" * len(r) + e, [(n[0], f"{n}:") for n in r] + [x] * (x is not None)) for r in runs for e, c, x in own])
    choices.append([(5 * len(r), "I" * len(r), [(n[0], f"{n}:") for n in r]) for r in runs])
    out = None
    for way in product(*choices):
        lines = [x for w in way for x in w[2]]
        if GOOD.fullmatch("".join(i for i, _ in lines)):
            new = (sum(w[0] for w in way), "".join(w[1] for w in way), tuple(t for _, t in lines))
            if out is None or new[:2] < out[:2]:
                out = new
    return out


def expected(data, is_damaged=True):
    by = {c: [] for c, *_ in data}
    for r in damage(data) if is_damaged else data:
        by[r[0]].append(r)
    out = Counter()
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(rows)
        n = Counter(found)
        turns = {r[1] for r in rows} - {None}
        illegal = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
        cost, audit, lines = repaired(rows, found)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def made(seed, n, turns, roles=("user", "assistant", "user", "assistant", "system", "tool", None, "", "ugly")):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for t in range(rng.randint(1, turns)):
            text = rng.choice(["Yes.", "No!", "and", None, "", " \n", "Why?\n ", f"say {rng.randrange(9)}.", "ünd.", "\x85"])
            out.append((conv if conv else None, rng.choice([t, t, t, t * 3, None]), rng.choice(roles), text))
    return out


def test_plain_program_is_right():
    for rows in (made(s, 1, 3) for s in range(400)):
        rows = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
        found = faults(rows)
        assert repaired(rows, found) == all_edits(rows, found)


@pytest.mark.parametrize("segment", [3, 4096])
def test_equals_plain_program(spark, segment):
    data = made(segment, 60, 9) + [(1000, t, r, f"{r} {t}.") for t, r in enumerate(["system", *["user", "assistant", "assistant", "user"] * 40])] + [(1001, i % 7, "user", "Again.") for i in range(50)]
    data += [(2000 + i, i, "user", "gone.") for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 7) for r in data], SCHEMA).repartition(5)
    assert Counter(map(tuple, repair_conversations(df, segment=segment).collect())) == expected(data)
    if segment > 3:
        return
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data]
    assert Counter(map(tuple, repair_conversations(df, segment=segment, damage=False).collect())) == expected(whole, False)


def test_one_conversation_over_all_tasks(spark):
    rng = random.Random(5)
    data = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"t{t}.", "and", f"and {t}"])) for t in range(6000)] + [(8, 0, "user", "Hello."), (8, 1, "assistant", "Hello.")]
    df = spark.createDataFrame([(*r, "x", 7) for r in data], SCHEMA).repartition(7)
    assert Counter(map(tuple, repair_conversations(df, segment=16).collect())) == expected(data)


def test_empty_table_and_codes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(df).count() == 0
    assert all(not b.startswith(a) for a in CODES for b in CODES if a != b)
    long = "x" * 3_000_000 + "."
    (r,) = repair_conversations(spark.createDataFrame([(1, 1, "user", long)], "conv_id long, turn long, role string, text string"), damage=False).collect()
    assert (r.cost, r.audit) == (2, "D")


def test_query_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    found = con.sql(ORACLE_SQL["op12_conversation_repair"])
    got = QUERIES["op12_conversation_repair"](spark, tiny)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    rows = sorted(map(tuple, got.select(*found.columns).collect()))
    assert rows == sorted(found.fetchall()) and len(rows) >= 20
