"""Search of several corpora in one plan: ``corpus`` is a key of documents, queries, index and runs.

Ids need only be unique within their corpus. One BM25 index holds all corpora: a block of documents
belongs to one of them, and document frequencies, lengths and idf are kept for each. One stream of
vectors serves the dense expert. What comes out has the query id ``struct(corpus, query_id)``, so that
fusion, labels and metrics take it as they take any other id.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import require
from ..session import ensure_checkpoint_dir, materialize, read_bucketed, write_bucketed
from . import dense, sparse
from .dense import Stream
from .ranking import top_k
from .sparse import _ranked_in_block

#: Documents of a block: half as many as in ``sparse``, so that a task that lists a block takes half the memory.
BLOCK_DOCS = 2048


@dataclass(frozen=True)
class Collection:
    """Constants of one corpus of an index: its name, counts, and the blocks that are its own."""

    name: str
    n_docs: int
    n_tokens: int
    mean_idf: float
    first_block: int
    blocks: int

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


@dataclass
class CorporaIndex:
    """``lists`` as in ``sparse`` (a block is one corpus's), ``dfs(corpus, term, df, occurrences)``, and a row of constants per corpus."""

    lists: DataFrame
    dfs: DataFrame
    collections: tuple[Collection, ...]
    params: sparse.BM25Params = sparse.BM25Params()

    @property
    def terms(self) -> DataFrame:
        """``(corpus, term, df, idf)``, negative idf replaced by epsilon times the mean of the corpus."""
        known = {c.name: c for c in self.collections}
        raw = sparse.raw_idf(_of(known, lambda c: c.n_docs), F.col("df"))
        floor = F.lit(self.params.epsilon) * _of(known, lambda c: c.mean_idf)
        return self.dfs.select("corpus", "term", "df", F.when(raw < 0, floor).otherwise(raw).alias("idf"))


def _of(known: dict, value) -> Column:
    """``value`` of the row's corpus; null for a corpus that isn't known."""
    if not known:
        return F.lit(None).cast("double")
    return F.create_map(*[x for n, c in known.items() for x in (F.lit(n), F.lit(value(c)))])[F.col("corpus")]


def keyed(df: DataFrame) -> DataFrame:
    """``query_id`` as ``struct(corpus, query_id)``; the column ``corpus`` goes."""
    return df.withColumn("query_id", F.struct("corpus", "query_id")).drop("corpus")


def corpus_of_block(collections: tuple[Collection, ...]) -> Column:
    names = F.array(*[F.lit(c.name) for c in collections])
    starts = F.array(*[F.lit(c.first_block) for c in collections])
    return F.element_at(names, F.size(F.filter(starts, lambda s: s <= F.col("block"))))


def build_index(docs: DataFrame, params: sparse.BM25Params = sparse.BM25Params(), block_docs: int = BLOCK_DOCS) -> CorporaIndex:
    """BM25 index over ``docs(corpus, doc_id, [title], text)``, written once to the shared checkpoint folder.

    Texts are tokenised once and move once, by block; blocks follow from the documents alone. Gathered on the driver are a few constants per
    corpus. A document without a corpus raises.
    """
    require(docs, ("corpus", "doc_id", "text"), "docs")
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    counts = {r["corpus"]: r["n"] for r in docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} documents without a corpus")
    own = {c: -(-n // block_docs) for c, n in sorted(counts.items())}
    first, at = {}, 0
    for c, n in own.items():
        first[c], at = at, at + n
    buckets = min(sparse.MAX_BUCKETS, max(at, 1))
    block = _of(own, lambda n: n)
    block = _of(first, lambda n: n) + F.pmod(F.xxhash64("doc_id"), block)
    write_bucketed(sparse.block_lists(docs, max(at, 1), buckets, block), f"{path}/lists", "block", buckets)
    lists = read_bucketed(spark, f"{path}/lists", sparse.lists_schema(sparse.id_type(docs)), "block", buckets)
    # names and first blocks are all that the corpus of a list needs
    bare = tuple(Collection(c, counts[c], 0, 0.0, first[c], own[c]) for c in own)
    if not bare:
        return CorporaIndex(lists, lists.select(F.lit("").alias("corpus"), "term", F.lit(0).cast("long").alias("df"), "occurrences").limit(0), bare, params)
    words = lists.filter(F.col("term") != sparse.EVERY).withColumn("corpus", corpus_of_block(bare))
    dfs = words.groupBy("corpus", "term").agg(F.sum("n").cast("long").alias("df"), F.sum("occurrences").alias("occurrences"))
    dfs.write.parquet(f"{path}/terms")
    dfs = spark.read.schema(dfs.schema).parquet(f"{path}/terms")
    raw = sparse.raw_idf(_of({c.name: c for c in bare}, lambda c: c.n_docs), F.col("df"))
    found = {r["corpus"]: r for r in dfs.groupBy("corpus").agg(F.avg(raw).alias("mean"), F.sum("occurrences").alias("n")).collect()}
    return CorporaIndex(
        lists, dfs,
        tuple(Collection(c.name, c.n_docs, found[c.name]["n"], found[c.name]["mean"], c.first_block, c.blocks) if c.name in found else c for c in bare),
        params,
    )


def search(index: CorporaIndex, queries: DataFrame, k: int = 10, pass_terms: int = sparse.PASS_TERMS) -> DataFrame:
    """Top-k BM25 run ``(query_id struct(corpus, query_id), doc_id, rank, score)`` of ``queries(corpus, query_id, text)``.

    A query is asked of its own corpus only, and gets what a search of that corpus alone would give. As
    there, lists stay where their bucket is read and only ``k`` candidates per query and block move.
    """
    require(queries, ("corpus", "query_id", "text"), "queries")
    spark, collections = queries.sparkSession, index.collections
    kind = queries.schema["query_id"].dataType.simpleString()
    doc_kind = index.lists.schema["doc_ids"].dataType.elementType.simpleString()
    asked = sparse.query_terms(keyed(queries)).select("query_id.corpus", "query_id.query_id", "term", "qtf")
    asked = asked.join(index.terms.select("corpus", "term", "idf"), ["corpus", "term"])
    asked = materialize(asked.select("corpus", "query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    passes = max(1, -(-asked.count() // pass_terms))
    starts, params = [c.first_block for c in collections], index.params
    lengths, names = [c.avgdl for c in collections], [c.name for c in collections]

    def rank(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = bisect_right(starts, key[0].as_py()) - 1
        found = _ranked_in_block(k, params, lengths[own])(table)
        return found.append_column("corpus", pa.array([names[own]] * found.num_rows, pa.string()))

    out = spark.createDataFrame([], f"query_id {kind}, doc_id {doc_kind}, score double, corpus string")
    if not collections:
        return top_k(keyed(out), k).select("query_id", "doc_id", "rank", "score")
    lists = index.lists.withColumn("corpus", corpus_of_block(collections))
    for i in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("corpus", "query_id"), F.lit(passes)) == i)
        by_term = part.groupBy("corpus", "term").agg(F.collect_list(F.struct("query_id", "w")).alias("asked"))
        hits = lists.join(F.broadcast(by_term), ["corpus", "term"]).select("block", "doc_ids", "tfs", "dls", "max_tf", "min_dl", "asked")
        ranked = hits.groupBy("block").applyInArrow(rank, f"query_id {kind}, doc_id {doc_kind}, score double, corpus string")
        out = ranked if i == 0 else out.unionByName(ranked)
    found = keyed(out.withColumn("score", F.round("score", sparse.SCORE_DIGITS)))
    return top_k(found, k).select("query_id", "doc_id", "rank", "score")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, pass_queries: int = dense.PASS_QUERIES, tile: int = dense.TILE, chunk: int = dense.CHUNK) -> DataFrame:
    """Top-k inner-product run ``(query_id struct(corpus, query_id), doc_id, rank, score)``.

    ``queries(corpus, query_id, embedding)``, ``vectors(corpus, doc_id, embedding)``: null embeddings are
    left out, and a corpus may have its own number of dimensions. Up to ``pass_queries`` query vectors go
    to the tasks at a time; a batch of vectors meets the queries of its own corpora only, and a task
    keeps ``k`` candidates of each query. No vector is shuffled.
    """
    require(queries, ("corpus", "query_id", "embedding"), "queries")
    require(vectors, ("corpus", "doc_id", "embedding"), "vectors")
    q = materialize(queries.filter("embedding is not null").select("corpus", "query_id", F.col("embedding").alias("vec")))
    v = vectors.filter("embedding is not null").select("corpus", "doc_id", F.col("embedding").alias("vec"))
    kinds = [df.schema[n].dataType.simpleString() for df, n in ((q, "query_id"), (v, "doc_id"))]
    passes = max(1, -(-q.count() // pass_queries))
    out = None
    for i in range(passes):
        own = (q if passes == 1 else q.filter(F.pmod(F.xxhash64("corpus", "query_id"), F.lit(passes)) == i)).toArrow()
        sent = {}
        for name in pc.unique(own.column("corpus")).to_pylist():
            of = own.filter(pc.equal(own.column("corpus"), pa.scalar(name, own.schema.field("corpus").type)))
            sent[name] = (of.column("query_id").combine_chunks(), dense.unit_rows(of.column("vec").combine_chunks()))
        sent = q.sparkSession.sparkContext.broadcast(sent)

        def stream(batches, sent=sent):
            streams = {}
            for batch in batches:
                for name in pc.unique(batch.column("corpus")).to_pylist():
                    if name in sent.value:
                        mine = batch.filter(pc.equal(batch.column("corpus"), pa.scalar(name, batch.schema.field("corpus").type)))
                        if name not in streams:
                            streams[name] = Stream(*sent.value[name], k, False, tile, chunk)
                        streams[name].add(mine)
            for name, s in streams.items():
                for found in s.found():
                    yield found.append_column("corpus", pa.array([name] * found.num_rows, pa.string()))

        part = v.mapInArrow(stream, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, corpus string")
        part = part if passes == 1 else materialize(part)
        out = part if out is None else out.unionByName(part)
    return top_k(keyed(out), k).select("query_id", "doc_id", "rank", "score")
