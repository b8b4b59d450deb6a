import re

import pytest

import corpus_pipeline as C
from aislekit.llm import pii, toxicity
from cases import no_docs, odd_docs
from test_similarity import brute_components, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select(*COLUMNS)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "source_mixing", "sentencepiece"]
    assert C.ORACLE_SQL is None


def test_toxic_documents_go(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(documents, toxicity.train(documents, labels)).collect()}
    kept = C.drop_toxic(spark, documents, small)
    assert kept.dtypes == documents.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, s in score.items() if s < 0.5)


def test_one_of_each_group_stays(spark, small, documents):
    rows = documents.collect()
    roots = brute_components([shingle_set(r["text"], 5) for r in rows], 80)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    kept = C.drop_near_copies(spark, documents, small)
    assert kept.dtypes == documents.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_masked_documents_hold_no_pattern(spark, small, documents):
    done = C.mask_personal_data(spark, documents, small)
    assert done.dtypes == documents.dtypes and done.count() == documents.count()
    for r in done.collect():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])


def test_mixed_and_encoded_documents(spark, small, documents):
    mixed = C.mix_sources(spark, documents, small)
    assert mixed.dtypes == documents.dtypes
    words = {r["doc_id"]: re.findall(r"\S+", r["text"]) for r in documents.collect()}
    rows = mixed.collect()
    taken = sum(len(re.findall(r"\S+", r["text"])) for r in rows)
    assert abs(taken / sum(map(len, words.values())) - 1.5) < 0.05
    assert all(r["n_chars"] == len(r["text"]) and set(re.findall(r"\S+", r["text"])) <= set(words[r["doc_id"]]) for r in rows)
    encoded = C.encode_pieces(spark, mixed, small).collect()
    assert len(encoded) == len(rows) and all(r["lossless"] for r in encoded)


def test_all_stages_take_odd_and_empty_tables(spark, small):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, small)
            rows = out.count()
            assert rows <= 2 * docs.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns


def test_run_applies_all_stages(spark, small):
    rows = C.run(spark, small).collect()
    assert rows and all(r["lossless"] for r in rows)
