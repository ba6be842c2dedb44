"""Fixture M-C (cleaning, de-leak, balance, accuracy), exact hash selection and the router."""

import pytest
from pyspark.sql import functions as F

from hybridrank.operators import fusion, prepare, router

MC = [
    ("a", 1, 0.0, 0.0),
    ("b", 2, 1.0, 0.0),
    ("c", 3, 0.2, 0.8),
    ("d", 4, 0.1, 0.4),
    ("e", 5, 0.5, 0.5),
    ("f", 6, None, 0.0),
    ('say "hi", x', 7, 0.5, 0.1),
    ("g", 8, float("nan"), 1.0),
]


@pytest.fixture(scope="module")
def mc(spark):
    df = spark.createDataFrame(MC, "query string, query_id long, sparse double, dense double")
    s = F.col("sparse") + F.col("dense")
    return df.withColumn("sparse_l1", F.when(s > 0, F.col("sparse") / s).otherwise(F.col("sparse"))).withColumn(
        "dense_l1", F.when(s > 0, F.col("dense") / s).otherwise(F.col("dense"))
    )


def test_clean(mc):
    assert sorted(r.query for r in prepare.clean(mc).collect()) == ["b", "c", "d", "e", 'say "hi", x']


def test_deleak(spark, mc):
    test = spark.createDataFrame([("d",)], "query string")
    assert "d" not in {r.query for r in prepare.deleak(prepare.clean(mc), test).collect()}


def test_balance(mc):
    b = prepare.balance(prepare.clean(mc)).withColumn("w", prepare.winner())
    counts = {r.w: r["count"] for r in b.groupBy("w").count().collect()}
    assert counts == {"sparse": 2, "dense": 2}  # tie row e dropped, 2 of each class


def test_balance_one_class_returns_input(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 0.5, 0.5)], "query_id long, sparse double, dense double")
    assert prepare.balance(df).count() == 3


def test_split_disjoint_and_deterministic(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet").select(F.col("doc_id").alias("query_id"))
    tr, te = prepare.split(df, 0.8, 42)
    a, b = {r.query_id for r in tr.collect()}, {r.query_id for r in te.collect()}
    assert not a & b and len(a | b) == 200
    assert a == {r.query_id for r in prepare.split(df, 0.8, 42)[0].collect()}
    tr2, te2 = prepare.split_exact(df, 0.8, 42)
    assert tr2.count() == 160 and te2.count() == 40


def test_smallest_by_hash_exact(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang")
    h = prepare.split_hash(7, "doc_id")
    got = prepare.smallest_by_hash(df, 11, h, "doc_id", ["lang"]).withColumn("h", h).collect()
    allrows = df.withColumn("h", h).collect()
    expect = set()
    for lang in {r.lang for r in allrows}:
        rows = sorted((r.h, r.doc_id) for r in allrows if r.lang == lang)[:11]
        expect |= {d for _, d in rows}
    assert {r.doc_id for r in got} == expect


def test_evaluate_ties_and_accuracy(spark, mc):
    clean = prepare.clean(mc)
    pred = fusion.fixed_weights(clean, {"sparse": 0.5, "dense": 0.5})
    ev = {r.query: r for r in router.evaluate(pred, clean).join(clean.select("query_id", "query"), "query_id").collect()}
    assert ev["e"].tie and ev["e"].correct is None
    assert ev["b"].correct and not ev["c"].correct
    acc = router.accuracy(router.evaluate(pred, clean)).first()
    assert acc.accuracy == pytest.approx(2 / 4) and acc.n_eval == 4 and acc.n_ties == 1


def test_router_fit_recovers_soft_labels(spark):
    # constant features: the best multinomial model predicts the mean soft label
    rows = [(i, [1.0, 0.0], 0.7 if i % 2 else 0.9, 0.3 if i % 2 else 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, features array<double>, sparse_l1 double, dense_l1 double")
    m = router.fit(df, reg_param=0.0)
    w = {r.expert: r.weight for r in router.predict(m, df.limit(1), ["sparse", "dense"]).collect()}
    assert w["sparse"] == pytest.approx(0.8, abs=1e-3) and w["dense"] == pytest.approx(0.2, abs=1e-3)


def test_mlp_router_learns_hard_winner(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 0.9 if i % 2 else 0.2, 0.1 if i % 2 else 0.8) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, features array<double>, sparse_l1 double, dense_l1 double")
    m = router.fit_mlp(df, hidden=(4,), max_iter=200)
    w = {r.query_id: r.weight for r in router.predict(m, df.limit(2), ["sparse", "dense"]).filter("expert = 'sparse'").collect()}
    assert w[1] > 0.5 > w[0]


def test_split_decision_with_test_tables(spark, mc):
    from hybridrank.plans import jobs

    test = mc.filter("query IN ('d', 'e')")
    tr, te = jobs.prepare_router_data(mc, test)
    assert {r.query for r in tr.collect()} == {"b", "c", 'say "hi", x'}
    assert {r.query for r in te.collect()} == {"d", "e"}
    with pytest.raises(ValueError):
        jobs.prepare_router_data(mc.filter("query = 'b'"), mc.filter("query = 'b'"))
    tr2, te2 = jobs.prepare_router_data(mc)  # no test tables: hash split of the cleaned rows
    assert tr2.count() + te2.count() == 5
