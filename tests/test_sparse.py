"""BM25 on the three-document fixture, checked against a direct computation of the formula."""

import math
from collections import Counter

import pytest

from hybridrank.functions.text import tokens
from hybridrank.operators import sparse

DOCS = [
    ("doc1", "Ferry at the pier", "The harbour wakes when the ferry calls."),
    ("doc2", "Nets and salt", "The harbour smells of tar."),
    ("doc3", "A slow tide", "Gulls circle the harbour."),
]


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {d: (t + " " + x).lower().replace(".", " ").split() for d, t, x in docs}
    n = len(toks)
    avgdl = sum(len(v) for v in toks.values()) / n
    df = Counter(t for v in toks.values() for t in set(v))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: (eps * mean if v < 0 else v) for t, v in raw.items()}
    out = {}
    for d, v in toks.items():
        tf = Counter(v)
        s = 0.0
        for q in query.lower().split():
            if q in tf:
                s += idf[q] * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(v) / avgdl))
        out[d] = s
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, text string")


def test_tokens_and_lengths(spark, corpus):
    rows = {r.doc_id: r.dl for r in sparse.doc_lengths(corpus).collect()}
    assert rows == {"doc1": 11, "doc2": 8, "doc3": 7}
    got = spark.createDataFrame([("Héllo, Wörld 12ab!",)], "t string").select(tokens("t").alias("x")).first().x
    assert got == ["héllo", "wörld", "12ab"]


def test_null_title_keeps_blank(spark):
    c = spark.createDataFrame([("d", None, "x y")], "doc_id string, title string, text string")
    assert sparse.doc_lengths(c).first().dl == 2


def test_idf_floor(corpus):
    idx = sparse.build_index(corpus)
    terms = {r.term: r for r in idx.terms.collect()}
    assert terms["harbour"].df == 3
    st = idx.stats.first()
    assert terms["harbour"].idf == pytest.approx(0.25 * st.mean_idf)
    assert terms["ferry"].idf == pytest.approx(math.log(2.5) - math.log(1.5))


def test_search_matches_formula(spark, corpus):
    idx = sparse.build_index(corpus)
    q = spark.createDataFrame([("q1", "ferry harbour")], "query_id string, text string")
    run = sparse.search(idx, q, k=2).collect()
    expect = brute_bm25(DOCS, "ferry harbour")
    order = sorted(expect, key=lambda d: (-round(expect[d], 9), d))[:2]
    assert [r.doc_id for r in sorted(run, key=lambda r: r["rank"])] == order
    for r in run:
        assert r.score == pytest.approx(expect[r.doc_id])
        assert r.expert == "sparse"


def test_repeated_and_unknown_terms(spark, corpus):
    idx = sparse.build_index(corpus)
    q = spark.createDataFrame([("q", "ferry ferry zebra")], "query_id string, text string")
    got = {r.doc_id: r.score for r in sparse.search(idx, q, k=10).collect()}
    once = brute_bm25(DOCS, "ferry")
    assert set(got) == {"doc1"}
    assert got["doc1"] == pytest.approx(2 * once["doc1"])


def test_k_larger_than_matches_and_empty_query(spark, corpus):
    idx = sparse.build_index(corpus)
    q = spark.createDataFrame([("q", "harbour"), ("e", "")], "query_id string, text string")
    run = sparse.search(idx, q, k=50).collect()
    assert sorted(r.doc_id for r in run if r.query_id == "q") == ["doc1", "doc2", "doc3"]
    assert [r["rank"] for r in sorted(run, key=lambda r: r["rank"])] == [1, 2, 3]
    assert not [r for r in run if r.query_id == "e"]


def test_score_pairs_unknown_doc_is_zero(spark, corpus):
    idx = sparse.build_index(corpus)
    q = spark.createDataFrame([("q1", "ferry harbour")], "query_id string, text string")
    pairs = spark.createDataFrame([("q1", "doc1"), ("q1", "doc2"), ("q1", "nope")], "query_id string, doc_id string")
    got = {r.doc_id: r.score for r in sparse.score_pairs(idx, q, pairs).collect()}
    expect = brute_bm25(DOCS, "ferry harbour")
    assert got["nope"] == 0.0
    assert got["doc1"] == pytest.approx(expect["doc1"])
    assert got["doc2"] == pytest.approx(expect["doc2"])


def test_materialized_index_equals_lazy(spark, corpus):
    q = spark.createDataFrame([("q1", "ferry harbour")], "query_id string, text string")
    a = sorted(tuple(r) for r in sparse.search(sparse.build_index(corpus), q, k=3).collect())
    b = sorted(tuple(r) for r in sparse.search(sparse.build_index(corpus), q, k=3).collect())
    assert a == b


def test_pad_fills_with_zero_score_docs(spark, corpus):
    idx = sparse.build_index(corpus)
    q = spark.createDataFrame([("q", "ferry")], "query_id string, text string")
    run = sorted(sparse.search(idx, q, k=3, pad=True).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in run] == ["doc1", "doc2", "doc3"]
    assert run[1].score == 0.0 and run[2].score == 0.0


def test_queries_from_list(spark, corpus):
    from hybridrank.sources.readers import queries_from_list

    idx = sparse.build_index(corpus)
    run = sparse.search(idx, queries_from_list(spark, "ferry harbour"), k=1).first()
    assert run.query_id == 0 and run.doc_id == "doc1"
