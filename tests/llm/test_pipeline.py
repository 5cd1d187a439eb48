import pytest

import corpus_pipeline


def test_pipeline_runs_on_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = out.cache()
        assert docs.count() > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len(rows) == docs.count()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


A = " ".join(f"first{k}" for k in range(30))
B = " ".join(f"second{k}" for k in range(30))
C = " ".join(f"third{k}" for k in range(30))


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, __gone int")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_dedup_drops_rows_and_not_ids(spark):
    """Another text of a doc_id is another document; rows without doc_id stay; rows equal in both are one document."""
    assert kept(spark, [(1, A), (5, A), (5, B), (None, A), (7, B), (8, C), (8, C)]) == sorted([(1, A), (5, B), (None, A), (8, C), (8, C)], key=str)
    got = kept(spark, [(1, A), (1, A + " end"), (2, A + " last"), (3, None), (4, " "), (6, "")])
    assert len(got) == 2 and got[0][0] == 1 and got[0][1] in (A, A + " end") and got[1] == (3, None)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, stage):
    """Nulls, repeats, long texts and clashing columns pass through; what stays is as it was."""
    d = "/root/testdata/sf0.001"
    docs = odd_docs.withColumnsRenamed({"kept": "__source", "component_id": "score"})
    out = stage(spark, docs, d)
    assert out.columns == docs.columns
    given = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= given
    assert stage(spark, no_docs, d).collect() == []


def test_tokens_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = corpus_pipeline.tokens(spark, odd_docs, "").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert next(r.n_tokens for r in rows if r.doc_id == 3) == 1 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert corpus_pipeline.tokens(spark, no_docs, "").collect() == []
