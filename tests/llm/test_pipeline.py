"""The pipeline's stages on the smallest table: plain Python, the labels (quality) and the library (tokens)."""

import math
import re

import corpus_pipeline
import pytest
from terralith.llm.common import written
from terralith.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.test_secrets_mixing import drawn
from tests.llm.test_text_dedup import near_by_force


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, tiny), "test_stage")
        if name != "tokens":
            assert after.columns == docs.columns and after.schema["text"] == docs.schema["text"]
        old, new = before.collect(), after.collect()
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
            gone = {r.doc_id for r in old} - {r.doc_id for r in new}
            clean = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
            assert sum(i in gone for i in clean) <= 0.03 * len(clean) and gone
        elif name == "lines":
            assert {r.doc_id for r in new} == {r.doc_id for r in old}
            text = {r.doc_id: r.text for r in old}
            for r in new:
                rest = iter(text[r.doc_id].split("\n"))
                assert all(x in rest for x in r.text.split("\n")) or r.text == ""
                assert r.text == text[r.doc_id] or r.n_chars == len(r.text)
        elif name == "near_duplicates":
            want = near_by_force([tuple(r) for r in old], 5, 80)
            assert {r.doc_id for r in new} == {i for i, (_, c) in want.items() if c == i}
        elif name == "mix":
            size = {s: sum(r.source == s for r in old) for s in {r.source for r in old}}
            counts = {i: sum(r.doc_id == i for r in new) for i in {r.doc_id for r in old}}
            for r in old:
                assert counts[r.doc_id] == drawn("mix-1", r.doc_id, len(old) / len(size) / size[r.source])
        else:
            spm = pytest.importorskip("sentencepiece")
            library = spm.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
            text = {r.doc_id: r.text for r in old}
            assert len(new) == len(old) and all(r.token_ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in new[:80])
        before = after


def test_boilerplate_goes_from_every_document(spark, tiny):
    footer = ["All rights reserved, whatever the page says about it", "Sign in to read on", "Home | News | About"]
    copy = "the whole copy\nstands on many sites"
    data = [(i, "\n".join([footer[0], f"own {i}", *footer[1:]]), f"site{i % 6}") for i in range(30)]
    data += [(100 + i, copy, f"site{i}") for i in range(7)] + [(200, f"{copy}\n  \n", "site1"), (201, None, "site1"), (202, "", None), (203, f"{footer[0]}\nown", None)]
    made = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in data], "doc_id long, text string, source string, n_chars long")
    for docs in (made, spark.read.parquet(f"{tiny}/documents.parquet")):
        norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).strip(" ")
        old, sites = docs.collect(), {}
        for r in old:
            for x in (r.text or "").split("\n"):
                sites.setdefault(norm(x), set()).update({r.source} - {None})
        want = {}
        for r in old:
            kept = [x for x in (r.text or "").split("\n") if not norm(x) or len(sites[norm(x)]) < 5]
            want[r.doc_id] = "\n".join(kept) if r.text and any(map(norm, kept)) else r.text
        got = corpus_pipeline.lines(spark, docs, tiny).collect()
        assert len(got) == len(old) and {r.doc_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text or "") for r in got)
        if docs is made:
            assert want[3] == "own 3" and want[100] == copy and want[203] == "own"


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(ORACLE_SQL) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and math.isclose(len(corpus_pipeline.STAGES), 5)
