"""Readers/writers round trips and the three jobs end to end on sf0.001."""

import json

import pytest
from pyspark.sql import functions as F

from hybridrank.operators import judgments, sparse
from hybridrank.plans import jobs
from hybridrank.session import materialize
from hybridrank.sources import index_store, readers, testdata as td, writers


def test_corpus_jsonl_last_duplicate_wins(spark, tmp_path):
    p = tmp_path / "corpus.jsonl"
    lines = [{"_id": "a", "title": "t", "text": "one"}, {"_id": "b", "text": "two"}, {"_id": "a", "title": "t", "text": "three"}]
    p.write_text("\n".join(json.dumps(x) for x in lines))
    got = {r.doc_id: r for r in readers.read_corpus(spark, str(p)).collect()}
    assert got["a"].text == "three" and got["b"].title is None
    assert readers.duplicate_ids(readers.read_corpus(spark, str(p), dedup="none"), "doc_id").first().n == 2


def test_qrels_formats(spark, tmp_path):
    tsv = tmp_path / "test.tsv"
    tsv.write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq2\td3\t2\n")
    got = {(r.query_id, r.doc_id): r.relevance for r in readers.read_qrels(spark, str(tsv)).collect()}
    assert got == {("q1", "d1"): 1, ("q2", "d3"): 2}  # zero dropped
    js = tmp_path / "q.json"
    js.write_text(json.dumps({"q1": {"d1": 1, "d2": 0}}))
    got = {(r.query_id, r.doc_id): r.relevance for r in readers.read_qrels(spark, str(js)).collect()}
    assert got == {("q1", "d1"): 1, ("q1", "d2"): 0}  # zeros kept
    with pytest.raises(ValueError):
        readers.read_qrels(spark, str(tmp_path / "q.xml"))
    out = str(tmp_path / "long")
    writers.write_qrels(readers.read_qrels(spark, str(tsv)), out)
    assert readers.read_qrels(spark, out, fmt="jsonl").count() == 2


def test_split_discovery(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\n")
    assert readers.available_splits(str(tmp_path)) == ["test"]
    assert readers.read_split_qrels(spark, str(tmp_path), "train") is None
    assert readers.read_split_qrels(spark, str(tmp_path), "test").count() == 1


def test_score_table_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", x', 0.5, 0.1, 0.8, 0.2, 0.6, 0.4), (2, "multi\nline", 0.0, 1.0, 0.0, 1.0, 0.3, 0.7)],
        "query_id long, query string, sparse double, dense double, sparse_l1 double, dense_l1 double, "
        "sparse_softmax double, dense_softmax double",
    )
    out = str(tmp_path / "scores")
    writers.write_score_table(df, out)
    back = {r.query_id: r for r in readers.read_score_tables(spark, ["", out]).collect()}
    assert back["1"].query == 'say "hi", x' and back["2"].query == "multi\nline" and back["1"].sparse_l1 == 0.8
    assert readers.read_score_tables(spark, [""]).count() == 0


def test_index_store_round_trip(spark, sf_small, tmp_path):
    corpus, queries = td.corpus(spark, sf_small), td.queries(spark, sf_small)
    path = str(tmp_path / "idx")
    built = index_store.sparse_index(corpus, path)
    again = index_store.sparse_index(corpus, path)  # loads
    a = sparse.search(built, queries, 5).collect()
    b = sparse.search(again, queries, 5).collect()
    c = sparse.search(sparse.build_index(corpus), queries, 5).collect()
    key = lambda rows: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in rows)
    assert key(a) == key(b) == key(c)


def test_validate_collection(spark):
    corpus = spark.createDataFrame([("d1", "x")], "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "x")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d9", 1)], "query_id string, doc_id string, relevance int")
    r = readers.validate_collection(corpus, queries, qrels).first()
    assert (r.n_docs, r.n_queries, r.n_qrels, r.orphan_queries, r.orphan_docs) == (1, 1, 2, 1, 1)


def test_jobs_end_to_end(spark, sf_small, tmp_path):
    corpus, queries = td.corpus(spark, sf_small), td.queries(spark, sf_small)
    ex = jobs.Experts(sparse=jobs.SparseExpert(corpus), dense=jobs.DenseExpert(corpus))
    idx = ex.experts["sparse"].index
    qrels = materialize(judgments.graded_qrels(judgments.containing_documents(corpus, queries, idx), td.labels(spark, sf_small)))
    table = jobs.generate_labels(ex, queries, qrels, k=10, out_path=str(tmp_path / "labels"))
    n_judged = qrels.select("query_id").distinct().count()
    assert table.count() == n_judged
    back = readers.read_score_tables(spark, [str(tmp_path / "labels")])
    assert back.count() == n_judged
    tr, te = jobs.prepare_router_data(table)
    if tr.count() >= 1 and te.count() >= 1:
        model, results, acc, selection = jobs.train_router(tr, te, reg_params=(1e-2,))
        assert selection["reg_param"] == 1e-2 and len(selection["path"]) == 1
        assert results.count() == te.count()
        assert 0.0 <= acc.first().accuracy <= 1.0
        path = index_store.save_router(model, str(tmp_path / "run"), "l1")
        assert index_store.load_router(str(tmp_path / "run"), "l1").numClasses == 2
        bench = jobs.benchmark(ex, queries, qrels, model=model, k=10, corpus_name="sf0.001")
    else:
        bench = jobs.benchmark(ex, queries, qrels, k=10, corpus_name="sf0.001")
    rows = bench.collect()
    assert {r.model for r in rows} == {"sparse", "dense", "fused"} and len(rows) == 12
    writers.write_benchmark(bench, str(tmp_path / "bench"))
    writers.write_run_config(spark, {"k": 10, "norm": "l1"}, str(tmp_path / "config"))
    assert spark.read.json(str(tmp_path / "bench")).count() == 12


def test_report_has_a_row_for_each_corpus_and_model(spark, tmp_path):
    rows = [(c, m, k, 1.0 / k, k / 25.0, 3) for c in ("left", "right") for m in ("sparse", "fused") for k in (1, 5, 10, 25)]
    summary = spark.createDataFrame(rows, "corpus string, model string, k int, precision double, recall double, n_queries long")
    writers.write_report(summary, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report")).collect()
    assert {(r.corpus, r.model) for r in back} == {(c, m) for c in ("left", "right") for m in ("sparse", "fused")}
    assert all(r["precision@5"] == 0.2 and r["recall@10"] == 0.4 and r["precision@25"] == 0.04 for r in back)
    writers.write_report(summary.drop("corpus").limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_build_experts_reuses_stored_indices(spark, sf_small, tmp_path):
    corpus, queries = td.corpus(spark, sf_small), td.queries(spark, sf_small)
    root = str(tmp_path / "indices")
    a = jobs.build_experts(corpus, root)
    b = jobs.build_experts(corpus, root)  # loads both
    ra = sorted((r.query_id, r.expert, r.doc_id, r["rank"]) for r in a.search(queries, 3).collect())
    rb = sorted((r.query_id, r.expert, r.doc_id, r["rank"]) for r in b.search(queries, 3).collect())
    assert ra == rb and {e for _, e, _, _ in ra} == {"sparse", "dense"}
    with pytest.raises(ValueError):
        readers.read_split_qrels(spark, root, "validation")


def test_index_over_jsonl_corpus_with_dedup(spark, tmp_path):
    # the last-wins read is non-deterministic for Spark; corpus constants must still resolve
    p = tmp_path / "corpus.jsonl"
    docs = [{"_id": "d1", "title": "Pier", "text": "No boat today."},
            {"_id": "d2", "title": "Nets", "text": "The harbour smells of tar."},
            {"_id": "d1", "title": "Ferry at the pier", "text": "The harbour wakes when the ferry calls."}]
    p.write_text("\n".join(json.dumps(d) for d in docs))
    corpus = readers.read_corpus(spark, str(p))
    idx = sparse.build_index(corpus)
    q = readers.queries_from_list(spark, ["ferry harbour"])
    run = sparse.search(idx, q, k=2).collect()
    assert [r.doc_id for r in sorted(run, key=lambda r: r["rank"])][0] == "d1"
    assert idx.stats.first().n_docs == 2
