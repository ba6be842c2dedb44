"""The index by blocks of documents: exact top-k with bounds, its plan, and its store."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.operators import dense, sparse
from hybridrank.sources import index_store


def bm25(docs, text, p=sparse.BM25Params()):
    toks = {d: t.split() for d, t in docs}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = p.epsilon * sum(raw.values()) / len(raw)
    out = {}
    for d, v in toks.items():
        tf = Counter(v)
        hits = [q for q in text.split() if q in tf]
        if hits:
            out[d] = sum((raw[q] if raw[q] >= 0 else floor) * tf[q] * (p.k1 + 1) / (tf[q] + p.k1 * (1 - p.b + p.b * len(v) / avgdl)) for q in hits)
    return out


def ranked(scores, k):
    return sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]


@pytest.fixture(scope="module")
def texts():
    """Words of very unlike frequency, copies (ties), long and empty texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, some(rng.randint(1, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000, ""), (2001, some(4000))]
    queries = [(i, some(rng.randint(1, 60))) for i in range(25)] + [(90, "w0 w0 w0"), (91, "nothing known"), (92, docs[7][1]), (93, "w0 w1 w2 w299 w298")]
    return docs, queries


@pytest.fixture(scope="module")
def index(spark, texts):
    return sparse.build_index(spark.createDataFrame(texts[0], "doc_id long, text string").repartition(3), block_docs=64)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_k_is_exact(spark, texts, index, k):
    docs, queries = texts
    run = sparse.search(index, spark.createDataFrame(queries, "query_id long, text string"), k, expert=None).collect()
    for query_id, text in queries:
        expected = bm25(docs, text)
        got = sorted((r for r in run if r.query_id == query_id), key=lambda r: r["rank"])
        assert [r.doc_id for r in got] == ranked(expected, k)
        assert all(r.score == pytest.approx(expected[r.doc_id]) for r in got)


def test_more_queries_than_a_pass_takes(spark, texts, index):
    queries = spark.createDataFrame(texts[1], "query_id long, text string")
    one, many = (sorted(tuple(r) for r in sparse.search(index, queries, 5, pass_terms=n).collect()) for n in (10**6, 250))
    assert one == many


def test_negative_weights(spark):
    docs = [(i, "a b c" if i else "a b c d") for i in range(8)]  # the mean idf is below zero
    index = sparse.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.constants.mean_idf < 0
    run = sparse.search(index, spark.createDataFrame([(1, "d a b a")], "query_id long, text string"), 3).collect()
    assert [r.doc_id for r in sorted(run, key=lambda r: r["rank"])] == ranked(bm25(docs, "d a b a"), 3)


def test_common_terms_are_looked_up_only(texts):
    """Lists that can't change the best k are not summed: their contributions would be wrong here."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 4000
    rare, common = np.sort(rng.choice(n, 30, replace=False)), np.arange(n)
    lists = [rare, common, common, common]
    table = pa.table({
        "doc_ids": pa.array([x.tolist() for x in lists]), "tfs": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32())), "dls": pa.array([[10] * len(x) for x in lists], pa.list_(pa.int32())),
        "max_tf": pa.array([1] * 4, pa.int32()), "min_dl": pa.array([10] * 4, pa.int32()), "asked": pa.array([[{"query_id": 1, "w": w}] for w in (9.0, 0.1, 0.1, 0.1)]),
    })

    out = sparse._ranked_in_block(5, sparse.BM25Params(), 10.0)(table)
    assert out.column("doc_id").to_pylist() == rare[:5].tolist()


def test_plan_moves_candidates_only(spark, texts, index):
    run = sparse.search(index, spark.createDataFrame(texts[1], "query_id long, text string"), 5)
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # below the candidates the lists are read by bucket and not moved
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    stream = below[: below.index("BroadcastQueryStage") if "BroadcastQueryStage" in below else below.index("BroadcastExchange")]
    assert " Exchange " not in stream and "Bucketed: true" in stream


def test_padding_alike_in_memory_and_stored(spark, tmp_path):
    corpus = spark.createDataFrame([(3, "cat"), (1, ""), (4, "dog"), (2, "dog cat")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "unknown")], "query_id long, text string")
    stored = index_store.sparse_index(corpus, str(tmp_path / "i"))
    again = index_store.sparse_index(corpus, str(tmp_path / "i"))
    runs = [sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in sparse.search(i, q, 4, pad=True).collect()) for i in (sparse.build_index(corpus), stored, again)]
    assert runs[0] == runs[1] == runs[2]
    assert [r[2] for r in runs[0] if r[0] == 2] == [1, 2, 3, 4] and {r[2] for r in runs[0] if r[0] == 1} == {1, 2, 3, 4}


def test_texts_are_listed_once(spark, texts, index):
    docs = dict(texts[0])
    expected = Counter((t, d) for d, text in docs.items() for t in text.split())
    assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == expected
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {d: len(t.split()) for d, t in docs.items()}
    assert index.constants.n_tokens == sum(expected.values())


def test_interrupted_rebuild_loads_the_old_index(spark, tmp_path, monkeypatch):
    path, corpus = str(tmp_path / "i"), spark.createDataFrame([(1, "cat"), (2, "dog")], "doc_id long, text string")
    index_store.sparse_index(corpus, path)
    other = corpus.union(spark.createDataFrame([(3, "cow")], corpus.schema))
    write = sparse.write_index

    def cut_off(*args):
        write(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(sparse, "write_index", cut_off)
    with pytest.raises(KeyboardInterrupt):
        index_store.sparse_index(other, path, force=True)
    monkeypatch.undo()
    assert index_store.sparse_index(corpus, path).constants.n_docs == 2
    with pytest.raises(index_store.IndexMismatch):
        index_store.sparse_index(other, path)
    with pytest.raises(index_store.IndexMismatch):
        index_store.sparse_index(corpus, path, params=sparse.BM25Params(k1=2.0))
    assert index_store.sparse_index(other, path, force=True).constants.n_docs == 3
    assert index_store.load_sparse_index(spark, f"file:{path}").constants.n_docs == 3
    assert index_store.drop_old_versions(spark, path) == 2 and len(os.listdir(f"{path}/versions")) == 1
    assert json.loads(spark.read.text(f"{path}/versions/*/manifest").first()[0])["constants"]["n_docs"] == 3


def _vectors(spark, rows, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_pruned_search_is_exact_and_prunes(spark, exclude_self):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = np.concatenate([centres[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 16)), np.tile(centres[0], (150, 1)), np.zeros((1, 16))])
    rows = list(enumerate(vectors))
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1, keepdims=True) > 0, np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    run, work = dense.knn_pruned(_vectors(spark, rows, "query_id"), _vectors(spark, rows, "doc_id"), 6, exclude_self=exclude_self, centres=12, cell_rows=40, report=True)
    got = {}
    for r in sorted(run.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.doc_id)
    s = np.round(unit @ unit.T, 9)
    for i in range(len(rows)):
        order = [j for j in np.lexsort((np.arange(len(rows)), -s[i])) if not (exclude_self and i == j)][:6]
        assert got[i] == order
    w = work.first()
    assert w.all_products == len(rows) ** 2 and 0 < w.products < 0.6 * w.all_products


def test_searches_of_nothing(spark):
    none, some = _vectors(spark, [], "doc_id"), _vectors(spark, [(1, np.ones(3))], "query_id")
    assert dense.knn(some, none, 3).collect() == [] == dense.knn_pruned(some, none, 3).collect()
    none, some = _vectors(spark, [], "query_id"), _vectors(spark, [(1, np.ones(3))], "doc_id")
    assert dense.knn(none, some, 3).collect() == [] == dense.knn_pruned(none, some, 3).collect()
    empty = sparse.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert sparse.search(empty, spark.createDataFrame([(1, "x")], "query_id long, text string"), 3, pad=True).collect() == []
    assert empty.docs.select(F.count("*")).first()[0] == 0
