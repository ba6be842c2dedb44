"""Several corpora in one plan: each gets what a run of its own would give."""

import importlib.util
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.operators import corpora, dense, router, sparse
from hybridrank.plans import jobs

DOCS, QUERIES = "corpus string, doc_id long, title string, text string", "corpus string, query_id long, text string"


def rows_of(run):
    return sorted(tuple(r) for r in run.collect())


def own(df, name):
    return df.filter(F.col("corpus") == name).drop("corpus")


@pytest.fixture(scope="module")
def tables(spark):
    """Three corpora with the same ids, unlike in size and in how common their words are; one has no words at all."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    docs, queries, qrels = [], [], []
    for c, n, most in (("large", 400, 60), ("small", 30, 12), ("blank", 3, 0)):
        for i in range(n):
            text = " ".join(words[int(rng.random() ** 2 * most)] for _ in range(rng.randint(0, 20))) if most else None if i else "  "
            docs.append((c, i, rng.choice(words) if most and i % 5 == 0 else None, text))
        queries += [(c, i, " ".join(rng.choices(words[: most or 10], k=4))) for i in range(12)]
        qrels += [(c, i, rng.randrange(n), rng.randint(1, 2)) for i in range(9) for _ in range(3)]
    queries.append(("absent", 0, "w1 w2"))
    return (
        spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(queries, QUERIES),
        spark.createDataFrame(sorted(set((c, q, d) for c, q, d, _ in qrels)), "corpus string, query_id long, doc_id long").withColumn("relevance", F.lit(1)),
    )


@pytest.mark.parametrize("pass_terms", [10**6, 20])
def test_sparse_search_is_that_of_each_corpus(tables, pass_terms):
    docs, queries, _ = tables
    index = corpora.build_index(docs, block_docs=16)
    assert {c.name: c.n_docs for c in index.collections} == {"large": 400, "small": 30, "blank": 3}
    run = corpora.search(index, queries, 7, pass_terms=pass_terms).select("query_id.*", "doc_id", "rank", "score").cache()
    for name in ("large", "small", "blank"):
        alone = sparse.search(sparse.build_index(own(docs, name)), own(queries, name), 7, expert=None)
        assert rows_of(own(run, name)) == rows_of(alone)
    assert {r.corpus for r in run.select("corpus").distinct().collect()} == {"large", "small"}


def test_lists_are_not_moved(tables):
    docs, queries, _ = tables
    run = corpora.search(corpora.build_index(docs, block_docs=16), queries, 7)
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    stream = below[: below.index("BroadcastQueryStage") if "BroadcastQueryStage" in below else below.index("BroadcastExchange")]
    assert " Exchange " not in stream and "Bucketed: true" in stream


@pytest.mark.parametrize("pass_queries", [10**6, 5])
def test_dense_search_is_that_of_each_corpus(spark, pass_queries):
    rng = np.random.default_rng(4)
    rows = [(c, i, None if i == 3 else np.round(rng.normal(size=dim), 1).tolist()) for c, n, dim in (("a", 90, 8), ("b", 5, 3), ("c", 1, 8)) for i in range(n)]
    vectors = spark.createDataFrame(rows, "corpus string, doc_id long, embedding array<double>").repartition(3)
    asked = [(c, i, v) for c, i, v in rows if i < 12 and c != "c"] + [("absent", 1, [1.0, 0.0])]
    queries = spark.createDataFrame(asked, "corpus string, query_id long, embedding array<double>")
    run = corpora.knn(queries, vectors, 6, pass_queries=pass_queries, tile=16, chunk=4).select("query_id.*", "doc_id", "rank", "score").cache()
    for name in "ab":
        assert rows_of(own(run, name)) == rows_of(dense.knn(own(queries, name), own(vectors, name), 6, expert=None))
    assert {r.corpus for r in run.select("corpus").distinct().collect()} == {"a", "b"}


def test_benchmark_is_that_of_each_corpus(spark, tables):
    docs, queries, qrels = tables
    feats = jobs.query_features(own(queries, "large")).join(own(queries, "large").select("query_id", (F.col("query_id") % 2).cast("double").alias("sparse_l1")), "query_id")
    model = router.fit(feats.withColumn("dense_l1", 1.0 - F.col("sparse_l1")), ("sparse", "dense"), "l1")
    for given in ({"weights": {"sparse": 0.75, "dense": 0.25}}, {"model": model}):
        together = jobs.benchmark_corpora(docs, queries, qrels, k=10, **given).cache()
        assert together.columns == ["corpus", "model", "k", "precision", "recall", "n_queries"]
        for name in ("large", "small", "blank"):
            experts = jobs.build_experts(own(docs, name))
            alone = jobs.benchmark(experts, own(queries, name), own(qrels, name), k=10, **given)
            got, want = rows_of(own(together, name)), rows_of(alone)
            assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 12
            assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-12)


def test_nothing_and_documents_without_a_corpus(spark, tables):
    docs, queries, qrels = tables
    assert jobs.benchmark_corpora(docs.limit(0), queries.limit(0), qrels.limit(0)).collect() == []
    assert corpora.search(corpora.build_index(docs.limit(0)), queries, 5).collect() == []
    with pytest.raises(ValueError, match="1 documents without a corpus"):
        corpora.build_index(docs.union(spark.createDataFrame([(None, 1, None, "w1")], DOCS)))


def test_runner_writes_one_benchmark_of_all_folders(spark, tmp_path):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "hybrid_jobs.py")
    spec = importlib.util.spec_from_file_location("hybrid_jobs", path)
    runner = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(runner)
    for name, words in (("tools", "hammer saw chisel"), ("fruit", "apple pear plum")):
        folder = tmp_path / name
        (folder / "qrels").mkdir(parents=True)
        (folder / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "title": w, "text": f"about the {w}"}) + "\n" for i, w in enumerate(words.split())))
        (folder / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": w}) + "\n" for i, w in enumerate(words.split())))
        (folder / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{i}\td{i}\t1\n" for i in range(3)))
    runner.main(["benchmark", "--collection", str(tmp_path / "tools"), str(tmp_path / "fruit"), "--out", str(tmp_path / "out"), "--report", str(tmp_path / "report")])
    rows = spark.read.json(str(tmp_path / "report")).collect()
    assert {(r.corpus, r.model) for r in rows} == {(c, m) for c in ("tools", "fruit") for m in ("sparse", "dense", "fused")}
    assert all(r["precision@1"] == 1.0 and r["recall@25"] == 1.0 for r in rows)
    with pytest.raises(SystemExit, match="same name"):
        runner.main(["benchmark", "--collection", str(tmp_path / "tools"), str(tmp_path / "tools") + "/", "--out", str(tmp_path / "twice")])
