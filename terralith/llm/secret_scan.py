"""Secret scan with DataFrame functions only: strong kinds by their form, weak parts by what stands near them.

Multipart credential linking: access identifiers, secrets and endpoints of one scope (SCOPE code points of one
document) are interval-joined by their start; a weak candidate is reported only when a part of a complementary
role stands in its scope and one of the two is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

# The patterns of the contract, and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Weak parts: too short or too common to be reported alone.
WEAK_ACCESS = r"(?i:\b(?:client_?id|user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,})"
ENDPOINT = r"(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]{4,})"
#: Matches of one text whose starts are summed together.
TOGETHER = 256
#: Code points between the starts of two parts of one credential.
SCOPE = 200
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "endpoint")
#: What a kind stands for in a credential.
ROLES = {"assign": "secret", "hex": "secret", "weak_assign": "secret", "access": "identifier", "weak_access": "identifier", "endpoint": "endpoint"}
WEAK = ("weak_assign", "weak_access", "endpoint")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, kinds: Column | str) -> Column:
    """array<struct<kind, start, stop, value>> of the leftmost non-overlapping matches, in code points.

    kinds: a function of the match's text that gives a kind (null: the match is dropped). Starts are running sums of
    the lengths, taken in blocks of TOGETHER matches and then over the blocks, so the work grows with the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<kind:string,start:int,stop:int,value:string>>"
    empty = F.array().cast(kind)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        stop = begin + F.length(pair["hit"])
        one = F.struct(kinds(pair["hit"]).alias("kind"), begin.alias("start"), stop.alias("stop"), pair["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.when(one["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def in_blocks(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(p), F.lit(TOGETHER))
        return F.transform(starts, lambda first: F.aggregate(F.slice(p, first, F.lit(TOGETHER)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def laid(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + block["at"])))
        moved = lambda block, at: F.transform(block["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"), s["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), moved))

    return F.when(text.rlike(pattern), bound(bound(pairs, in_blocks), laid)).otherwise(empty)


def scan_key(doc_id: str, text: str) -> Column:
    """Names a row by its id and a hash of its content: rows of different ids never meet, whatever their hashes."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), row_key(doc_id, text).cast("string"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, scan_key, found: every strong and weak part of each whole text (null: none), by start within a kind."""
    t = F.coalesce(F.col(text), F.lit(""))

    def assigned(hit: Column) -> Column:
        size = F.length(F.regexp_extract(hit, ASSIGN, 2))
        return F.when(size >= LEAST["assign"], F.lit("assign")).otherwise(F.lit("weak_assign"))

    def sized(kind: str, least: int, weak: str | None = None):
        return lambda hit: F.when(F.length(hit) >= least, F.lit(kind)).otherwise(F.lit(weak).cast("string"))

    # a run of LEAST or more is found by the possessive form alone; shorter runs fail the length and are dropped
    long_hex = rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}"
    found = F.concat(
        spans(t, ASSIGN, assigned),
        spans(t, ACCESS, sized("access", LEAST["access"], "weak_access")),
        spans(t, long_hex, sized("hex", LEAST["hex"])),
        spans(t, WEAK_ACCESS, lambda hit: F.lit("weak_access")),
        spans(t, ENDPOINT, lambda hit: F.lit("endpoint")),
    )
    return docs.select(F.col(doc_id).alias("doc_id"), scan_key(doc_id, text).alias("scan_key"), found.alias("found"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per part that is reported: doc_id, scan_key, kind, start, stop, value, partners (roles within scope).

    The interval join |start - start'| <= scope goes by bins as wide as the scope. Of each bin and role only the
    first and the last start are joined: two starts in one bin are always near enough, of the bin before only its
    last start matters, of the bin after only its first. So the join has a few rows for each part, however many
    stand in one place.
    """
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("kind"))
    one = found.select("doc_id", "scan_key", F.explode("found").alias("p")).select("doc_id", "scan_key", "p.*").withColumn("role", role)
    one = one.withColumn("bin", F.floor(F.col("start") / scope))
    ends = one.groupBy("scan_key", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    # a bin's ends serve the parts of the bin itself and of its two neighbours
    ends = ends.select("scan_key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("role").alias("with"), "first", "last")
    near = (F.col("first") - F.col("start") <= scope) & (F.col("start") - F.col("last") <= scope) & ((F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope))
    weak = one.where(F.col("kind").isin(*WEAK))
    # two parts make a credential only if one of them is a secret
    complete = (F.col("with") != F.col("role")) & ((F.col("with") == "secret") | (F.col("role") == "secret"))
    met = weak.join(ends, ["scan_key", "bin"]).where(complete & near)
    met = met.groupBy("scan_key", "kind", "start").agg(F.array_sort(F.collect_set("with")).alias("partners"))
    out = one.join(met, ["scan_key", "kind", "start"], "left").where(~F.col("kind").isin(*WEAK) | F.col("partners").isNotNull())
    return out.select("doc_id", "scan_key", "kind", "start", "stop", "value", F.coalesce("partners", F.array().cast("array<string>")).alias("partners"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, kind, start, stop, value, partners: the reported spans of every document.

    Strong kinds (assign, access, hex) are always reported. Weak ones (weak_assign: a short assigned value;
    weak_access: a short key identifier or a login name; endpoint) are reported when a part of another role starts
    within `scope` code points in the same text; an identifier or endpoint needs a secret there. A null or empty text has no spans; a null id stays null; rows that
    repeat are each reported; an empty table gives no rows; other columns of docs are not read.
    """
    return linked(written(parts(docs, doc_id, text).where("size(found) > 0"), "secret_parts"), scope).drop("scan_key")


def secret_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = written(parts(docs, doc_id, text), "secret_parts")
    reported = linked(found.where("size(found) > 0"), scope).dropDuplicates(["scan_key", "kind", "start"])
    rank = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    by_row = reported.groupBy("scan_key").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop"))).alias("all"))
    rows = found.select("doc_id", "scan_key").join(by_row, "scan_key", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>"))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(every, lambda s: s["rank"] < 3)
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(every).alias("spans"),
        F.size(F.filter(every, lambda s: s["rank"] >= 3)).cast("long").alias("n_linked"),
    )
