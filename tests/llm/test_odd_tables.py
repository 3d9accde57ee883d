"""Null and repeated ids, repeated rows, empty tables and clashing columns through the operators and the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from huntframe.llm import op2_license_scans as op2, op4_language_id as op4, op5_source_mixing as op5, op6_url_filters as op6, op7_exact_topk as op7, op8_document_fingerprints as op8, op9_minhash_dedup as op9, op10_best_fit_packing as op10

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, _deal long, rank int, v string"
ROWS = [(1, "The mit license of this house", "en", "a"), (1, "le chat dans la maison", "fr", "a"), (None, "the dog and the cat", "en", None), (None, None, None, None), (7, "", "en", "b"), (7, "the mit license", None, "b"), (8, "x" * 70_000, "fr", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, "r", 6, 7, "v") for r in ROWS], COLUMNS).repartition(3)


def test_one_row_per_input_row(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    learnt = op4.learn(odd)
    jobs = (op2.license_scan(odd), op4.identify(odd, learnt), op5.mix(odd), op8.fingerprint_neighbours(odd), op9.near_duplicates(odd))
    ids = sorted(r[0] or 0 for r in ROWS)
    for job in jobs:
        assert sorted(r.doc_id or 0 for r in job.collect()) == ids
    assert sorted({(r.doc_id or 0) for r in op10.pack(odd, path).collect()}) == sorted(set(ids))
    assert sum(r.length for r in op10.pack(odd, path).collect()) > len(ROWS)


def test_repeated_ids_of_vectors_and_urls(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (None, [9.0, 9.0])], "id long, vec array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in op7.top_k(vectors, F.col("id") == 0, scale=1).collect()]
    assert sorted(got) == [(0, 1, 1, 0), (0, 2, 1, 0)]  # asks with the least of its vectors, [0, 0]; both rows of 1 are candidates
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x"), (None, "http://a.com/x"), (3, None)], "page_id long, url string")
    assert sorted(((r.page_id or 0), r.verdict) for r in op6.filter_urls(pages, trees=1, depth=1).collect()) == [(0, "allow"), (1, "allow"), (2, "allow"), (3, "allow")]


def test_pipeline_over_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path / name))
            assert docs.columns == odd.columns
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in rows} <= {1, 7, 8, None} and bool(rows) == (name == "odd")
