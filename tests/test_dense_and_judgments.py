"""Blocked dense search and containment judgements against brute force on the sf0.001 tables."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from hybridrank.operators import dense, embed, judgments, sparse
from hybridrank.sources import testdata as td


def brute_knn(ids, mat, k, exclude_self):
    m = np.asarray(mat, dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1
    m = m / n[:, None]
    s = m @ m.T
    out = {}
    for i, q in enumerate(ids):
        cand = [(round(s[i, j], 9), ids[j]) for j in range(len(ids)) if not (exclude_self and ids[j] == q)]
        cand.sort(key=lambda x: (-x[0], x[1]))
        out[q] = [d for _, d in cand[:k]]
    return out


@pytest.mark.parametrize("sizes", [{}, {"pass_queries": 200, "tile": 37, "chunk": 7}])
def test_knn_matches_brute_force(spark, sf_small, sizes):
    v = td.vectors(spark, sf_small)
    rows = v.orderBy("id").collect()
    ids = [r.id for r in rows]
    expect = brute_knn(ids, [r.embedding for r in rows], 5, True)
    run = dense.knn(
        v.select(F.col("id").alias("query_id"), "embedding"),
        v.select(F.col("id").alias("doc_id"), "embedding"),
        k=5,
        exclude_self=True,
        **sizes,
    ).collect()
    got = {}
    for r in sorted(run, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == expect


def test_knn_small_corpus_zero_vector_and_ties(spark):
    c = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "doc_id long, embedding array<double>"
    )
    q = spark.createDataFrame([(10, [1.0, 0.0])], "query_id long, embedding array<double>")
    run = sorted(dense.knn(q, c, k=10).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in run] == [1, 2, 3, 4]  # 1 and 2 tie after normalising → doc_id order
    assert [r.score for r in run] == [pytest.approx(1.0), pytest.approx(1.0), 0.0, 0.0]


def test_dense_score_pairs(spark):
    c = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [0.0, 2.0])], "query_id long, embedding array<double>")
    pairs = spark.createDataFrame([(10, 1), (10, 99)], "query_id long, doc_id long")
    got = {r.doc_id: r.score for r in dense.score_pairs(q, c, pairs).collect()}
    assert got == {1: pytest.approx(0.8), 99: 0.0}


def test_hashed_embedding_unit_norm(spark, sf_small):
    e = embed.embed_corpus(td.corpus(spark, sf_small), 64).collect()
    assert len(e) == 200
    for r in e:
        assert len(r.embedding) == 64
        assert float(np.dot(r.embedding, r.embedding)) == pytest.approx(1.0)


def test_containment_matches_brute_force(spark, sf_small):
    corpus, queries = td.corpus(spark, sf_small), td.queries(spark, sf_small)
    idx = sparse.build_index(corpus)
    got = {(r.query_id, r.doc_id) for r in judgments.containing_documents(corpus, queries, idx).collect()}
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    expect = {(q.query_id, d) for q in queries.collect() for d, t in docs if q.text in t}
    assert got == expect and got


def test_short_passages_fall_back(spark):
    corpus = spark.createDataFrame([(1, "alpha beta gamma"), (2, "xbeta gam")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "beta gam"), (8, "a be")], "query_id long, text string")
    idx = sparse.build_index(corpus)
    got = {(r.query_id, r.doc_id) for r in judgments.containing_documents(corpus, passages, idx).collect()}
    assert got == {(7, 1), (7, 2), (8, 1)}  # "alph[a be]ta"


def test_graded_qrels_and_lookup(spark):
    m = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, doc_id long")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    q = judgments.graded_qrels(m, lab)
    assert {r.doc_id: r.relevance for r in q.collect()} == {1: 2, 2: 1}
    pairs = spark.createDataFrame([("q", 1), ("q", 3)], "query_id string, doc_id long")
    assert {r.doc_id: r.relevance for r in judgments.judgments(pairs, q).collect()} == {1: 2, 3: 0}
    bad = spark.createDataFrame([("zz", 1)], "query_id string, doc_id long")
    with pytest.raises(Exception):
        judgments.judgments(bad, q, strict=True).collect()


def test_short_passages_brute_force(spark, sf_small):
    corpus = td.corpus(spark, sf_small)
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    passages = spark.createDataFrame([(1, "ab"), (2, "e"), (3, ". T"), (4, "zzqx"), (5, "en, d")], "query_id long, text string")
    idx = sparse.build_index(corpus)
    got = {(r.query_id, r.doc_id) for r in judgments.containing_documents(corpus, passages, idx).collect()}
    expect = {(q, d) for q, p in [(1, "ab"), (2, "e"), (3, ". T"), (4, "zzqx"), (5, "en, d")] for d, t in docs if p in t}
    assert got == expect


def test_embed_from_postings_equals_direct(spark, sf_small):
    corpus = td.corpus(spark, sf_small)
    idx = sparse.build_index(corpus)
    a = {r.doc_id: r.embedding for r in embed.embed_corpus(corpus, 64).collect()}
    b = {r.doc_id: r.embedding for r in embed.embed_postings(idx.postings, idx.terms, corpus.select("doc_id"), 64).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-12)


def test_user_encoder_hook(spark, sf_small):
    def make_encoder():
        def encode(texts):
            return np.array([[len(t), t.count(" ") + 1.0] for t in texts], dtype=np.float32)

        return encode

    q = td.queries(spark, sf_small)
    out = {r.query_id: r.embedding for r in embed.encode_with(q, "query_id", "text", make_encoder).collect()}
    texts = {r.query_id: r.text for r in q.collect()}
    assert out.keys() == texts.keys()
    for k, t in texts.items():
        assert out[k] == [float(len(t)), float(t.count(" ") + 1)]
