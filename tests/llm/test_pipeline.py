"""The pipeline's stages against plain Python over the smallest tables, and on rows that are odd."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tests_llm_helpers import brute_classes, brute_contamination, brute_quality, redacted
from tokenizers import Tokenizer

from contactdq.session import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_match_brute_force(spark, stages):
    docs = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").collect()]
    kept = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert {i for i, _ in kept} <= {i for i, t in docs if not brute_quality(t)[-1]} and len(kept) > 0.6 * len(docs)
    low = {c for (_, _, c) in brute_classes(kept)}
    unique = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(unique) == sorted((i, t) for i, t in kept if i in low)
    items = [(r.item_id, r.text) for r in table(spark, DIR, "benchmark").collect()]
    clean = {i for (i, _, hit, _) in brute_contamination(unique, items, 10) if not hit}
    assert sorted((r.doc_id, r.text) for r in stages[2].collect()) == sorted((i, t) for i, t in unique if i in clean)
    assert {r.doc_id for r in stages[3].collect()} == clean
    for r in stages[3].collect():
        assert redacted(dict(unique)[r.doc_id], r.text) and r.n_chars == len(r.text)
    for stage in stages[:-1]:
        assert stage.columns == table(spark, DIR, "documents").columns


def test_the_last_stage_packs_all(stages):
    import public_tokenizers

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    got, bins = Counter(), defaultdict(int)
    for r in stages[4].collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert got == want and max(bins.values()) <= 1024 and len(bins) <= -(-sum(want.values()) // 1024) + 3


ODD = [(1, None), (2, ""), (None, "a " * 100), (3, "word " * 3000), (3, "word " * 3000)]
#: Rows of each stage over ODD alone: too few or repeated words; one of the two equal rows; all; all; three pieces for each long text.
WANTED = {"quality_rules": 0, "near_dedup": 4, "decontamination": 5, "secret_scans": 5, "packing": 9}


def test_odd_rows_and_empty_tables(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(ODD), DIR).count() == WANTED[name], name
        assert stage(spark, documents([]), DIR).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, documents):
    """Names that the stages use themselves, and one with a dot; values that are null in every column of a row."""
    names = ("_row", "_id", "_at", "_twin", "_place", "_key", "_k1", "_text", "_base", "_all", "_t", "rid", "at", "item", "spans", "row", "base", "links", "hits", "n_words", "kept", "bin")
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(300)], k=80)) + (" password = hunter22" if i % 3 == 0 else "")) for i in range(12)] + [(None, None)]
    docs = documents(rows).selectExpr("*", *(f"concat('mine', doc_id) AS `{c}`" for c in names), "doc_id AS `a.b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len([r for r in got if r.doc_id is not None]) == 12 and all(r[c] == (None if r.doc_id is None else f"mine{r.doc_id}") for r in got for c in names), name
        assert all(r["a.b"] == r.doc_id for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert Counter(r.doc_id for r in packed.collect()) == Counter(i for i, _ in rows)


def test_run_is_its_stages_over_all_documents(spark, stages):
    got = corpus_pipeline.run(spark, DIR)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect())
