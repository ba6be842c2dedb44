import json

from hybridrank.operators import sparse
from hybridrank.sources import testdata as td
from hybridrank.streaming.query_stream import query_stream, search_stream


def test_query_stream_matches_batch_search(spark, sf_small, tmp_path):
    corpus, queries = td.corpus(spark, sf_small), td.queries(spark, sf_small)
    idx = sparse.build_index(corpus)
    rows = [r.asDict() for r in queries.collect()]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for part in range(2):
        chunk = rows[part::2]
        (inbox / f"q{part}.jsonl").write_text("\n".join(json.dumps({"_id": r["query_id"], "text": r["text"]}) for r in chunk))
    out = str(tmp_path / "out")
    sq = search_stream(
        query_stream(spark, str(inbox), max_files_per_trigger=1),
        lambda b: sparse.search(idx, b.selectExpr("CAST(query_id AS BIGINT) AS query_id", "text"), k=5, expert=None),
        out,
        checkpoint_location=str(tmp_path / "ckpt"),
        available_now=True,
    )
    sq.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.select("epoch").distinct().count() == 2
    batch = sparse.search(idx, queries, k=5, expert=None)
    key = lambda df: sorted((r.query_id, r.doc_id, r["rank"]) for r in df.collect())
    assert key(got.drop("epoch")) == key(batch)
