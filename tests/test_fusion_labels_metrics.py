"""Fixture M-B: two ranked lists, expert scores, normalisation, fusion and metrics by hand."""

import math

import pytest

from hybridrank.operators import fusion, labels, metrics, ranking

EXPERTS = ["sparse", "dense"]


@pytest.fixture(scope="module")
def mb(spark):
    runs = spark.createDataFrame(
        [
            ("q1", "sparse", "d1", 1),
            ("q1", "sparse", "d2", 2),
            ("q1", "sparse", "d3", 3),
            ("q1", "dense", "d3", 1),
            ("q1", "dense", "d4", 2),
        ],
        "query_id string, expert string, doc_id string, rank int",
    )
    qrels = spark.createDataFrame(
        [("q1", "d1", 1), ("q1", "d3", 2), ("q1", "d9", 1), ("q2", "d1", 1)],
        "query_id string, doc_id string, relevance int",
    )
    queries = spark.createDataFrame([("q1", "first"), ("q2", "second")], "query_id string, text string")
    return runs, qrels, queries


def test_expert_scores(mb):
    runs, qrels, queries = mb
    s = {(r.query_id, r.expert): r.score for r in labels.expert_scores(runs, qrels, queries, EXPERTS, 25).collect()}
    assert s[("q1", "sparse")] == pytest.approx(4 / 3)
    assert s[("q1", "dense")] == pytest.approx(1.0)
    assert s[("q2", "sparse")] == 0.0 and s[("q2", "dense")] == 0.0  # judged query without hits


def test_normalisation_and_wide(mb):
    runs, qrels, queries = mb
    t = {r.query_id: r for r in labels.score_table(runs, qrels, queries, EXPERTS, 25).collect()}
    q1 = t["q1"]
    assert (q1.sparse_l1, q1.dense_l1) == (pytest.approx(4 / 7), pytest.approx(3 / 7))
    e1, e2 = math.exp(4 / 3), math.exp(1)
    assert q1.sparse_softmax == pytest.approx(e1 / (e1 + e2))
    assert q1.sparse_softmax == pytest.approx(0.582570, abs=1e-6)
    q2 = t["q2"]
    assert (q2.sparse_l1, q2.dense_l1) == (0.0, 0.0)  # all-zero stays zero
    assert (q2.sparse_softmax, q2.dense_softmax) == (0.5, 0.5)
    assert q1.query == "first"


def test_fusion_order_and_ties(spark, mb):
    runs, _, queries = mb
    w = fusion.fixed_weights(queries, {"sparse": 0.5, "dense": 0.5})
    got = sorted(fusion.fuse(runs, w, EXPERTS, 25).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in got] == ["d3", "d1", "d2", "d4"]
    assert [r.score for r in got] == [pytest.approx(2 / 3), 0.5, 0.25, 0.25]


def test_fusion_weight_one_reproduces_first_expert(spark, mb):
    runs, _, queries = mb
    w = fusion.fixed_weights(queries, {"sparse": 1.0, "dense": 0.0})
    got = sorted(fusion.fuse(runs, w, EXPERTS, 25).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in got] == ["d1", "d2", "d3", "d4"]  # d4 only from expert 2, score 0
    assert got[-1].score == 0.0


def test_metrics_of_fused(spark, mb):
    runs, qrels, queries = mb
    w = fusion.fixed_weights(queries, {"sparse": 0.5, "dense": 0.5})
    fused = fusion.fuse(runs, w, EXPERTS, 25).selectExpr("query_id", "'fused' AS model", "doc_id", "rank")
    m = {(r.query_id, r.k): r for r in metrics.per_query(fused, qrels, ["fused"]).collect()}
    assert m[("q1", 1)].precision == 2.0 and m[("q1", 1)].recall == pytest.approx(2 / 3)
    assert m[("q1", 5)].precision == pytest.approx(3 / 5) and m[("q1", 5)].recall == pytest.approx(1.0)
    assert m[("q2", 1)].precision == 0.0 and m[("q2", 25)].recall == 0.0  # no hits still counted
    recalls = [m[("q1", k)].recall for k in (1, 5, 10, 25)]
    assert recalls == sorted(recalls)
    s = {(r.model, r.k): r for r in metrics.summary(metrics.per_query(fused, qrels, ["fused"])).collect()}
    assert s[("fused", 1)].precision == pytest.approx(1.0) and s[("fused", 1)].n_queries == 2
    named = metrics.to_named(metrics.summary(metrics.per_query(fused, qrels, ["fused"]))).first()
    assert named["precision@1"] == pytest.approx(1.0)


def test_binary_metrics(spark, mb):
    runs, qrels, _ = mb
    r = runs.filter("expert = 'sparse'").withColumnRenamed("expert", "model")
    m = {(x.query_id, x.k): x for x in metrics.per_query(r, qrels, ["sparse"], graded=False).collect()}
    assert m[("q1", 5)].precision == pytest.approx(2 / 5)


def test_rank_matrix(spark, mb):
    runs, _, _ = mb
    m = {r.doc_id: (r.sparse_rank, r.dense_rank) for r in ranking.rank_matrix(runs, EXPERTS).collect()}
    assert m == {"d1": (1, 0), "d2": (2, 0), "d3": (3, 1), "d4": (0, 2)}


def test_top_k_ties_by_doc_id(spark):
    df = spark.createDataFrame(
        [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 1.0 + 1e-12), ("q", "d", 0.5)],
        "query_id string, doc_id string, score double",
    )
    got = [r.doc_id for r in sorted(ranking.top_k(df, 3).collect(), key=lambda r: r["rank"])]
    assert got == ["a", "b", "c"]  # equal after rounding to 9 places → doc_id order
