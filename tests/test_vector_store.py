"""A vector store encodes a text once; encoders by role."""

import numpy as np
import pytest

from hybridrank.operators import embed
from hybridrank.plans import jobs
from hybridrank.sources.vector_store import VectorStore


def lengths(df, id_col):
    """An encoder of two numbers: the text's length and one."""
    return embed.encode_with(df, id_col, "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32))


def flipped(df, id_col):
    return embed.encode_with(df, id_col, "text", lambda: lambda texts: np.array([[1.0, -len(t)] for t in texts], np.float32))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_each_text_is_encoded_once(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "lengths", lengths)
    first = rows(spark, ["one", "two two", "one", None, ""])
    assert store.add(first) == 3  # NULL is the empty text
    assert store.add(first) == 0
    more = rows(spark, ["one", "three", "x" * 100_000])
    got = {r.doc_id: list(r.embedding) for r in store.vectors(more, "doc_id").collect()}
    assert got == {0: [3.0, 1.0], 1: [5.0, 1.0], 2: [100_000.0, 1.0]}
    assert store.table().count() == 5
    assert store.vectors(first, "doc_id").count() == 5


def test_repeated_ids_empty_tables_and_titles(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "lengths", lengths)
    assert store.vectors(rows(spark, ["a"]).limit(0), "doc_id").count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "bb"), (None, "a")], "doc_id long, text string")
    got = sorted(int(r.embedding[0]) for r in store.vectors(twice, "doc_id").collect())
    assert got == [1, 1, 1, 2]
    titled = spark.createDataFrame([(1, "t", "a"), (2, None, "a")], "doc_id long, title string, text string")
    assert sorted(int(r.embedding[0]) for r in store.vectors(titled, "doc_id").collect()) == [2, 3]


def test_broken_and_overlapping_additions(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "lengths", lengths)
    texts = rows(spark, ["a", "bb"])
    store.add(texts)
    (tmp_path / "lengths" / "broken").mkdir()
    (tmp_path / "lengths" / "broken" / "part-0.parquet").write_bytes(b"cut off")
    store.table().write.parquet(str(tmp_path / "lengths" / "beside"))  # another run had the same texts
    assert store.table().count() == 2
    assert store.vectors(texts, "doc_id").count() == 2


def test_encoders_have_their_own_tables(spark, tmp_path):
    texts = rows(spark, ["a"])
    assert VectorStore(spark, str(tmp_path), "lengths", lengths).add(texts) == 1
    assert VectorStore(spark, str(tmp_path), "flipped", flipped).add(texts) == 1
    with pytest.raises(ValueError):
        VectorStore(spark, str(tmp_path), "../up", lengths)


def test_documents_and_queries_by_two_encoders(spark, tmp_path):
    corpus = rows(spark, ["a", "bbbb"])
    queries = spark.createDataFrame([(7, "cc")], "query_id long, text string")
    store = VectorStore(spark, str(tmp_path), "lengths", lengths)
    expert = jobs.DenseExpert(corpus, store=store, query_encoder=flipped)
    scores = {r.doc_id: r.score for r in expert.search(queries, 2).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {i: float(unit([n, 1]) @ unit([1, -2])) for i, n in ((0, 1), (1, 4))}
    assert scores == pytest.approx(want, abs=1e-6)
    features = jobs.query_features(queries, encoder=flipped).first().features
    assert list(features) == [1.0, -2.0]
