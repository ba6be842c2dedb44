"""BM25 sparse retrieval over posting lists that are kept by block of documents.

Index layout (Parquet, one bucket per task):
  lists(block, term, doc_ids, tfs, dls, n, occurrences, max_tf, min_dl)
      one row per (block of documents, term), postings in order of doc_id; ``max_tf`` and ``min_dl``
      bound every contribution of the list, whatever the BM25 constants. The empty term lists all
      documents of the block, with their lengths.
  terms(term, df, occurrences)
A search sends the query terms to the blocks, sums and ranks inside each block, and moves only the
best k candidates of every block.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_text, token_pieces, tokens
from ..schemas import require
from ..session import ensure_checkpoint_dir, materialize, read_bucketed, write_bucketed
from .ranking import RANK_DIGITS, top_k

SCORE_DIGITS = 12

#: Documents of a block, and the most buckets (files) of an index.
BLOCK_DOCS, MAX_BUCKETS = 4096, 8192
#: Rows of query terms that one pass over the index carries to every task; more queries take more passes.
PASS_TERMS = 500_000
#: The term under which a block lists all its documents.
EVERY = ""


@dataclass(frozen=True)
class BM25Params:
    """Okapi BM25 constants. k1 = 1.5, b = 0.75, epsilon = 0.25 (idf floor factor)."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class CorpusStats:
    """Constants of an indexed corpus. ``fingerprint`` tells its rows and texts from another's."""

    n_docs: int
    n_tokens: int
    mean_idf: float
    blocks: int
    buckets: int
    fingerprint: str
    id_type: str

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


@dataclass
class SparseIndex:
    lists: DataFrame
    dfs: DataFrame
    constants: CorpusStats
    params: BM25Params = BM25Params()

    @property
    def terms(self) -> DataFrame:
        """``(term, df, idf)``, negative idf replaced by epsilon times the mean."""
        raw = raw_idf(F.lit(self.constants.n_docs), F.col("df"))
        return self.dfs.select("term", "df", F.when(raw < 0, F.lit(self.params.epsilon * self.constants.mean_idf)).otherwise(raw).alias("idf"))

    @property
    def stats(self) -> DataFrame:
        """One row: ``n_docs, avgdl, mean_idf``."""
        c = self.constants
        return self.lists.sparkSession.range(1).select(F.lit(c.n_docs).cast("long").alias("n_docs"), F.lit(c.avgdl).alias("avgdl"), F.lit(c.mean_idf).alias("mean_idf"))

    @property
    def postings(self) -> DataFrame:
        """Long form ``(term, doc_id, tf, dl)``."""
        each = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
        return self.lists.filter(F.col("term") != EVERY).select("term", F.inline(each))

    @property
    def docs(self) -> DataFrame:
        """``(doc_id, dl)`` of every document, also of those without tokens."""
        return self.lists.filter(F.col("term") == EVERY).select(F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("dls").alias("dl"))))


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    """``(doc_id, tokens)`` with document text = title + " " + text."""
    require(corpus, ("doc_id", "text"), "corpus")
    title = F.col("title") if "title" in corpus.columns else None
    return corpus.select("doc_id", tokens(doc_text(title, F.col("text"))).alias("tokens"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """``(doc_id, dl)``: number of tokens per document (documents without tokens included)."""
    return corpus_tokens(corpus).select("doc_id", F.size("tokens").cast("int").alias("dl"))


def postings(corpus: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, dl)``. Texts move once, by document, which is less than their postings; those are then counted in place.

    The token array is the generator's only input: projecting ``size(tokens)`` next to
    ``explode(tokens)`` would make generated code rebuild the array once per emitted token.
    """
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    toks = corpus_tokens(corpus.repartition(n, "doc_id"))
    pairs = F.arrays_zip(F.col("tokens").alias("term"), F.array_repeat(F.size("tokens"), F.size("tokens")).alias("dl"))
    return (
        toks.select("doc_id", F.inline(pairs))
        .groupBy("term", "doc_id", "dl")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
        .select("term", "doc_id", "tf", F.col("dl").cast("int").alias("dl"))
    )


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def fingerprint(corpus: DataFrame) -> tuple[int, str]:
    """Row count, and a hash of all ids and texts that doesn't depend on their order (one scan, no shuffle)."""
    title = F.col("title") if "title" in corpus.columns else None
    row = F.xxhash64(F.col("doc_id").cast("string"), doc_text(title, F.col("text"))).cast("decimal(20,0)")
    n, total = corpus.agg(F.count(F.lit(1)), F.sum(row)).first()
    return n, f"{n}-{int(total or 0) % 2**64:016x}"


def id_type(corpus: DataFrame) -> str:
    return corpus.schema["doc_id"].dataType.simpleString()


def lists_schema(kind: str) -> str:
    return f"block int, term string, doc_ids array<{kind}>, tfs array<int>, dls array<int>, n int, occurrences bigint, max_tf int, min_dl int"


class _Block:
    """Postings of one block, gathered batch by batch: numbers of terms and documents, not strings."""

    def __init__(self, block: int) -> None:
        self.block, self.codes, self.parts, self.docs, self.dls, self.n = block, {}, [], [], [], 0

    def add(self, begins: np.ndarray, docs: pa.Array, tokens: pa.ListArray) -> None:
        """Pieces of texts, each of the last document or, where it ``begins`` one, of the next of ``docs``.

        A term that several additions find in the same document is counted in each; ``lists`` adds them up.
        """
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(tokens).dictionary_encode()
        codes = self.codes
        own = np.array([codes.setdefault(t, len(codes)) for t in coded.dictionary.to_pylist()], np.int64)
        first, of = max(self.n - 1, 0), np.cumsum(begins) - 1 + self.n
        self.n += len(docs)
        n = self.n - first
        key, tf = np.unique(own[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(of - first, sizes), return_counts=True)
        self.parts.append(((key // n).astype(np.int32), (key % n + first).astype(np.int32), tf.astype(np.int32)))
        dls = np.bincount(of - first, sizes, n).astype(np.int64)
        if first < self.n - len(docs):  # the last document so far went on
            self.dls[-1][-1] += dls[0]
            dls = dls[1:]
        if len(docs):
            self.docs.append(docs)
            self.dls.append(dls)

    def lists(self, most: int = 1 << 17):
        """The block's lists, terms and documents in order, in batches of about ``most`` postings. The block is then used up."""
        docs, dl = pa.concat_arrays(self.docs), np.concatenate(self.dls)
        by_id = pc.sort_indices(docs).to_numpy()
        place = np.empty(self.n, np.int64)
        place[by_id] = np.arange(self.n)
        docs, dl = docs.take(pa.array(by_id)), dl[by_id].astype(np.int32)
        names = pa.array(list(self.codes), pa.string())
        self.codes = {}
        by_name = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        key = np.concatenate([rank[term] * self.n + place[doc] for term, doc, _ in self.parts])
        tf = np.concatenate([x[2] for x in self.parts])
        self.parts = []
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        del order
        starts = np.flatnonzero(np.diff(key, prepend=-1))  # a document's pieces may have been added one by one
        key, tf = key[starts], np.add.reduceat(tf, starts, dtype=np.int32) if len(starts) else tf
        term, doc = (key // self.n).astype(np.int32), (key % self.n).astype(np.int32)
        del key
        # every document under the empty term, which comes first
        term = np.concatenate([np.full(self.n, -1, np.int32), term])
        doc = np.concatenate([np.arange(self.n, dtype=np.int32), doc])
        tf = np.concatenate([np.ones(self.n, np.int32), tf])
        names = pa.concat_arrays([pa.array([EVERY]), names.take(pa.array(by_name))])
        starts = np.flatnonzero(np.diff(term, prepend=-2))
        ends = np.append(starts[1:], len(term))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
            s, e = starts[at], ends[to - 1]
            offsets = pa.array(np.append(starts[at:to], e) - s, pa.int32())
            part = starts[at:to] - s
            listed = lambda values: pa.ListArray.from_arrays(offsets, values)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(to - at, self.block, np.int32)), names.slice(at, to - at), listed(docs.take(pa.array(doc[s:e]))), listed(pa.array(tf[s:e])),
                    listed(pa.array(dl[doc[s:e]])), pa.array((ends - starts)[at:to].astype(np.int32)), pa.array(np.add.reduceat(tf[s:e], part, dtype=np.int64)),
                    pa.array(np.maximum.reduceat(tf[s:e], part)), pa.array(np.minimum.reduceat(dl[doc[s:e]], part)),
                ],
                names=["block", "term", "doc_ids", "tfs", "dls", "n", "occurrences", "max_tf", "min_dl"],
            )
            at = to


def block_lists(corpus: DataFrame, blocks: int, buckets: int, block: Column | None = None) -> DataFrame:
    """The rows of ``lists``. Texts move once, by block (a hash of the id, if not given); each task lists its blocks one after the other.

    A task holds the postings of one block as numbers: 12 bytes each while they are gathered, and the
    block's terms. Texts come in pieces, so that a batch stays small however long they are.
    """
    title = F.col("title") if "title" in corpus.columns else None
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) if block is None else block
    block = block.cast("int").alias("block")
    texts = corpus.select(block, "doc_id", doc_text(title, F.col("text")).alias("t")).repartition(buckets, "block").sortWithinPartitions("block")

    def listed(batches):
        current = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            begins = batch.column("piece").to_numpy() == 0
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if current is not None and current.block != block[s]:
                    yield from current.lists()
                    current = None
                current = current or _Block(int(block[s]))
                part = batch.slice(s, e - s)
                current.add(begins[s:e], part.column("doc_id").filter(pa.array(begins[s:e])), part.column("tokens"))
        if current is not None:
            yield from current.lists()

    pieces = texts.select("block", "doc_id", F.posexplode(token_pieces(F.col("t"))).alias("piece", "tokens"))
    return pieces.mapInArrow(listed, lists_schema(id_type(corpus)))


def write_index(corpus: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> CorpusStats:
    """Write ``lists`` and ``terms`` of ``corpus(doc_id, [title], text)`` under ``path``: texts are tokenised once.

    The corpus is scanned once more for its row count and fingerprint.
    """
    require(corpus, ("doc_id", "text"), "corpus")
    spark = corpus.sparkSession
    n_docs, print_ = fingerprint(corpus)
    wanted = -(-n_docs // block_docs)
    buckets = min(MAX_BUCKETS, max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = max(buckets, wanted)
    write_bucketed(block_lists(corpus, blocks, buckets), f"{path}/lists", "block", buckets)
    lists = read_bucketed(spark, f"{path}/lists", lists_schema(id_type(corpus)), "block", buckets)
    words = lists.filter(F.col("term") != EVERY)
    words.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("occurrences").alias("occurrences")).write.parquet(f"{path}/terms")
    # the mean over the whole vocabulary, before negative values are replaced
    raw = raw_idf(F.lit(n_docs), F.col("df"))
    mean, n_tokens = spark.read.parquet(f"{path}/terms").agg(F.avg(raw), F.sum("occurrences")).first()
    return CorpusStats(n_docs, n_tokens or 0, mean or 0.0, blocks, buckets, print_, id_type(corpus))


def open_index(spark, path: str, constants: CorpusStats, params: BM25Params) -> SparseIndex:
    return SparseIndex(read_bucketed(spark, f"{path}/lists", lists_schema(constants.id_type), "block", constants.buckets), spark.read.parquet(f"{path}/terms"), constants, params)


def build_index(corpus: DataFrame, params: BM25Params = BM25Params(), block_docs: int = BLOCK_DOCS) -> SparseIndex:
    """BM25 index over ``corpus(doc_id, [title], text)``, written once to the shared checkpoint folder.

    idf = ln(N - df + 0.5) - ln(df + 0.5); a negative idf is replaced by epsilon * mean(idf), the mean
    being taken over the whole vocabulary before replacement. ``index_store.sparse_index`` keeps an index
    at a path of its own.
    """
    spark = corpus.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    return open_index(spark, path, write_index(corpus, path, block_docs), params)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``; a term repeated in a query counts ``qtf`` times."""
    require(queries, ("query_id", "text"), "queries")
    return (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("qtf"))
    )


def weighted_terms(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, term, w)`` with w = times in the query x idf; terms that the index lacks drop out."""
    known = query_terms(queries).join(index.terms.select("term", "idf"), "term")
    return known.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def _ranked_in_block(k: int, params: BM25Params, avgdl: float):
    """Best k documents of a block for each query that asks for one of its terms.

    Lists are read in order of what they can add at most, large ones first. Once what is left can't
    lift an unseen document to the k-th score so far, the remaining (common) terms are looked up for
    those documents only that can still reach it.
    """
    slack = 10.0**-RANK_DIGITS

    def rank(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        lists, asked = column("doc_ids"), column("asked")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        coded = pc.list_flatten(lists).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        docs = coded.dictionary.take(order)
        place = np.empty(len(docs), np.int64)
        place[order.to_numpy()] = np.arange(len(docs))
        doc = place[coded.indices.to_numpy(zero_copy_only=False)]
        tf = pc.list_flatten(column("tfs")).to_numpy().astype(np.float64)
        dl = pc.list_flatten(column("dls")).to_numpy()
        impact = lambda tf, dl: tf * (params.k1 + 1.0) / (tf + params.k1 * (1.0 - params.b + params.b * dl / avgdl))
        adds = impact(tf, dl)
        most = impact(column("max_tf").to_numpy().astype(np.float64), column("min_dl").to_numpy())
        pairs = pc.list_flatten(asked)
        query = pc.struct_field(pairs, "query_id").dictionary_encode()
        weight = pc.struct_field(pairs, "w").to_numpy()
        of_list = np.repeat(np.arange(len(lists)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        which = query.indices.to_numpy(zero_copy_only=False)
        by_query = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[by_query], np.arange(len(query.dictionary) + 1))
        out_query, out_doc, out_score = [], [], []
        for q in range(len(query.dictionary)):
            rows = by_query[cuts[q] : cuts[q + 1]]
            bound = weight[rows] * most[of_list[rows]]
            # negative weights first, in full: what is left then only adds
            rows, bound = (x[np.lexsort((-bound, weight[rows] >= 0))] for x in (rows, bound))
            left = np.concatenate([np.cumsum(np.maximum(bound, 0.0)[::-1])[::-1], [0.0]])
            score, seen, kth, at, check = np.zeros(len(docs)), np.zeros(len(docs), bool), -np.inf, 0, 1
            while at < len(rows) and (left[at] >= kth - slack or weight[rows[at]] < 0):
                s, e = starts[of_list[rows[at]]], ends[of_list[rows[at]]]
                score[doc[s:e]] += weight[rows[at]] * adds[s:e]
                seen[doc[s:e]] = True
                at += 1
                if at == check and at < len(rows) and weight[rows[at]] >= 0:
                    check = min(2 * at, at + 16)
                    so_far = score[seen]
                    kth = np.partition(so_far, len(so_far) - k)[len(so_far) - k] if len(so_far) >= k else -np.inf
            found = np.flatnonzero(seen & (score + left[at] >= kth - slack))
            total = score[found]
            for n, at in enumerate(range(at, len(rows))):
                s, e = starts[of_list[rows[at]]], ends[of_list[rows[at]]]
                own = doc[s:e]
                hit = np.minimum(np.searchsorted(own, found), len(own) - 1)
                ok = own[hit] == found
                total[ok] += weight[rows[at]] * adds[s:e][hit[ok]]
                if n % 8 == 7:
                    kth = max(kth, np.partition(total, len(total) - k)[len(total) - k])
                    keep = total + left[at + 1] >= kth - slack
                    found, total = found[keep], total[keep]
            best = np.lexsort((found, -np.round(total, RANK_DIGITS)))[:k]
            out_query.append(np.full(len(best), q))
            out_doc.append(found[best])
            out_score.append(total[best])
        take = lambda values, parts: values.take(pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
        return pa.table({"query_id": take(query.dictionary, out_query), "doc_id": take(docs, out_doc), "score": np.concatenate([np.zeros(0), *out_score])})

    return rank


def block_candidates(index: SparseIndex, queries: DataFrame, k: int, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(query_id, doc_id, score)``: the best k documents of every block for each query.

    The query terms are counted; up to ``pass_terms`` rows are broadcast to the posting lists, more
    queries are dealt to several passes over the index. Lists stay where their bucket is read: nothing is
    shuffled by term, nor by (query, document).
    """
    asked = materialize(weighted_terms(index, queries))
    n = asked.count()
    passes = max(1, -(-n // pass_terms))
    types = {f.name: f.dataType.simpleString() for f in asked.select("query_id").schema.fields}
    doc_type = index.lists.schema["doc_ids"].dataType.elementType.simpleString()
    rank = _ranked_in_block(k, index.params, index.constants.avgdl)
    out = None
    for i in range(passes):
        own = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        by_term = own.groupBy("term").agg(F.collect_list(F.struct("query_id", "w")).alias("asked"))
        hits = index.lists.join(F.broadcast(by_term), "term").select("block", "doc_ids", "tfs", "dls", "max_tf", "min_dl", "asked")
        part = hits.groupBy("block").applyInArrow(rank, f"query_id {types['query_id']}, doc_id {doc_type}, score double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.round("score", SCORE_DIGITS))


def search(
    index: SparseIndex,
    queries: DataFrame,
    k: int = 10,
    expert: str | None = "sparse",
    pad: bool = False,
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """Top-k BM25 run ``(query_id, [expert], doc_id, rank, score)``, exact; ties: doc_id ascending.

    By default only documents with at least one matching term are returned. ``pad=True`` fills a
    short list with score-0 documents in ascending id order, as a scan over all scores would: the 2k
    smallest ids are scored for every query and ranked with the others.
    """
    found = block_candidates(index, queries, k, pass_terms)
    if pad:
        ids = index.docs.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)
        smallest = ids.agg(F.collect_list("doc_id")).scalar()
        pairs = queries.select("query_id", F.explode(smallest).alias("doc_id"))
        scored = score_pairs(index, queries, pairs).select("query_id", "doc_id", F.round("score", SCORE_DIGITS).alias("score"))
        found = found.unionByName(scored).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    ranked = top_k(found, k)
    cols = ["query_id", "doc_id", "rank", "score"]
    if expert is not None:
        ranked = ranked.withColumn("expert", F.lit(expert))
        cols.insert(1, "expert")
    return ranked.select(*cols)


def score_pairs(index: SparseIndex, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """BM25 score of given ``pairs(query_id, doc_id)``; unknown documents and no-match pairs score 0.0.

    Postings are cut to the documents of the pairs before they meet the query terms.
    """
    require(pairs, ("query_id", "doc_id"), "pairs")
    p, avgdl = index.params, index.constants.avgdl
    wanted = weighted_terms(index, queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi"))
    post = index.postings.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    tf = F.col("tf").cast("double")
    norm = F.lit(p.k1) * (F.lit(1.0 - p.b) + F.lit(p.b) * F.col("dl") / F.lit(avgdl))
    contrib = F.col("w") * tf * F.lit(p.k1 + 1.0) / (tf + norm)
    hits = post.join(wanted, "term").select("query_id", "doc_id", contrib.alias("contrib")).join(
        pairs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"
    )
    s = hits.groupBy("query_id", "doc_id").agg(F.sum("contrib").alias("score"))
    return pairs.join(s, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
