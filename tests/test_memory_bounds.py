"""What a task holds follows from fixed sizes, not from how long texts are or how many a batch has."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridrank.functions import text
from hybridrank.operators import embed, sparse


def long_texts(spark):
    """Long, short, empty and null texts, among them ids that repeat or are null."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % (50 + i)}" for j in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 128, 129, 1000, 5))]
    return spark.createDataFrame([*rows, (3, "again a b a"), (None, "no id " * 70), (None, "x"), (20, None)], "doc_id long, text string")


def test_pieces_are_the_tokens_in_order(spark):
    df = long_texts(spark).select(F.coalesce("text", F.lit("")).alias("t")).select(text.tokens("t").alias("all"), text.token_pieces("t", 64).alias("pieces"))
    for row in df.collect():
        assert [t for p in row.pieces for t in p] == row["all"]
        assert len(row.pieces) == max(1, -(-len(row["all"]) // 64)) and all(len(p) <= 64 for p in row.pieces)


@pytest.fixture
def seen(monkeypatch):
    """The sizes of the batches that a task of ``mapInArrow`` would get, in place of running it."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: (plans.append(self), real(self, *a, **k))[1])
    return plans


def test_a_row_sent_to_python_holds_few_tokens(spark, seen):
    docs = long_texts(spark)
    embed.embed_corpus(docs)
    sparse.block_lists(docs, 2, 2)
    assert len(seen) == 2
    for plan in seen:
        assert plan.select(F.max(F.size("tokens"))).first()[0] == text.PIECE_TOKENS


def test_lists_of_texts_cut_by_batches(spark):
    """Texts that go on over several batches are counted as whole ones are."""
    docs = long_texts(spark)
    want = Counter()
    for r in docs.collect():
        toks = [t for t in (r.text or "").split()]
        for t, n in Counter(toks).items():
            want[(t, r.doc_id, n, len(toks))] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        lists = sparse.block_lists(docs, 2, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = Counter((r.term, i, tf, dl) for r in lists if r.term for i, tf, dl in zip(r.doc_ids, r.tfs, r.dls, strict=True))
    assert got == want
    assert sorted(dl for r in lists if not r.term for dl in r.dls) == sorted(len((r.text or "").split()) for r in docs.collect())


@pytest.mark.parametrize("rows", [2, 10_000])
def test_vectors_of_texts_cut_by_batches(spark, rows):
    docs = long_texts(spark).coalesce(1)
    want = []
    for r in docs.collect():
        v = np.zeros(embed.DEFAULT_DIM)
        for t in (r.text or "").split():
            place = embed._place(t, embed.DEFAULT_DIM)
            v[place >> 1] += 1 - 2 * (place & 1)
        want.append((r.doc_id, tuple(np.round(v / (np.linalg.norm(v) or 1.0), 12))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = [(r.doc_id, tuple(np.round(r.embedding, 12))) for r in embed.embed_corpus(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(got) == Counter(want)


def test_lists_come_in_small_batches():
    block = sparse._Block(0)
    words = pa.array([[f"w{j}" for j in range(64)]] * 50)
    block.add(np.ones(50, bool), pa.array(range(50)), words)
    parts = list(block.lists(most=500))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == 65
    assert all(len(p.column("tfs").flatten()) <= 500 for p in parts)
