"""The three batch jobs, written as DataFrame plans:

1. label generation — run every expert, score it against the judgements, normalise (l1, softmax);
2. router training — clean, split or de-leak, fit on soft labels, evaluate;
3. routed retrieval and benchmark — per-query weights from the router, weighted reciprocal-rank
   fusion, precision/recall at k for each expert and for the fused list.

Experts are objects with ``search(queries, k)`` and ``score_pairs(queries, pairs)``; any number of
them can be registered by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpora, dense, embed, fusion, judgments, labels, metrics, prepare, router, sparse
from ..session import materialize
from ..sources import index_store
from ..sources.readers import with_query_key
from ..sources.vector_store import Encoder, VectorStore

DEFAULT_K = 25


class Expert(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, doc_id, rank, score)``, best first, at most ``k`` per query."""

    def score_pairs(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """``pairs`` plus ``score`` (0.0 for unknown documents)."""


class SparseExpert:
    """BM25 over ``corpus(doc_id, [title], text)``; index built once, optionally stored at ``path``."""

    def __init__(self, corpus: DataFrame, path: str | None = None, force: bool = False,
                 params: sparse.BM25Params = sparse.BM25Params()):
        self.index = index_store.sparse_index(corpus, path, force=force, save=path is not None, params=params)

    def search(self, queries, k):
        return sparse.search(self.index, queries, k, expert=None)

    def score_pairs(self, queries, pairs):
        return sparse.score_pairs(self.index, queries, pairs)


def hashed_encoder(dim: int = embed.DEFAULT_DIM) -> Encoder:
    """Default text encoder: ``(df, id_col) → (id_col, embedding)`` from ``text`` (and ``title``)."""

    def encode(df: DataFrame, id_col: str) -> DataFrame:
        title = F.col("title") if "title" in df.columns else None
        from ..functions.text import doc_text

        src = df.select(F.col(id_col), doc_text(title, F.col("text")).alias("_t"))
        return embed.hashed_embedding(src, id_col, F.col("_t"), dim)

    return encode


class DenseExpert:
    """Inner-product search over document vectors (computed once by ``encoder``, kept in ``store``, or given).

    Queries have an encoder of their own where a model tells both roles apart; without ``query_encoder``
    they take that of the documents. Both must give vectors of one length.
    """

    def __init__(self, corpus: DataFrame | None = None, vectors: DataFrame | None = None, encoder: Encoder | None = None,
                 path: str | None = None, force: bool = False, query_encoder: Encoder | None = None,
                 store: VectorStore | None = None):
        self.encoder = encoder or (store.encode if store else hashed_encoder())
        self.query_encoder = query_encoder or self.encoder
        if vectors is None:
            if corpus is None:
                raise ValueError("DenseExpert needs a corpus or vectors")
            vectors = store.vectors(corpus, "doc_id") if store else self.encoder(corpus, "doc_id")
        self.vectors = index_store.dense_vectors(vectors, path, force=force, save=path is not None)
        if path is None:
            self.vectors = materialize(self.vectors)

    def search(self, queries, k):
        qv = self.query_encoder(queries, "query_id")
        return dense.knn(qv, self.vectors, k, expert=None)

    def score_pairs(self, queries, pairs):
        return dense.score_pairs(self.query_encoder(queries, "query_id"), self.vectors, pairs)


class Experts:
    """Named experts; the order of registration is the fusion tie-break order."""

    def __init__(self, **experts: Expert):
        if not experts:
            raise ValueError("at least one expert is needed")
        self.experts = dict(experts)

    @property
    def names(self) -> list[str]:
        return list(self.experts)

    def search(self, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
        """All experts' runs in long form ``(query_id, expert, doc_id, rank, score)``."""
        runs = [e.search(queries, k).withColumn("expert", F.lit(n)) for n, e in self.experts.items()]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.select("query_id", "expert", "doc_id", "rank", "score")


def build_experts(corpus: DataFrame, root: str | None = None, force: bool = False,
                  dim: int = embed.DEFAULT_DIM) -> Experts:
    """Build (or load from ``{root}/sparse`` and ``{root}/dense``) the default sparse and dense experts."""
    import os

    sp = os.path.join(root, "sparse") if root else None
    dn = os.path.join(root, "dense") if root else None
    return Experts(
        sparse=SparseExpert(corpus, path=sp, force=force),
        dense=DenseExpert(corpus, encoder=hashed_encoder(dim), path=dn, force=force),
    )


# ---------------------------------------------------------------- job 1: label generation

def generate_labels(experts: Experts, queries: DataFrame, qrels: DataFrame, k: int = DEFAULT_K,
                    out_path: str | None = None) -> DataFrame:
    """Score table ``query_id, query, {e}, {e}_l1, {e}_softmax`` for the judged queries.

    Unjudged queries are removed before searching (semi join), and the runs are materialised once.
    """
    judged = materialize(judgments.judged_queries(queries, qrels))  # every expert reads them
    runs = materialize(experts.search(judged, k))
    table = labels.score_table(runs, qrels, judged, experts.names, k)
    if out_path:
        from ..sources.writers import write_score_table

        write_score_table(table, out_path)
    return table


# ---------------------------------------------------------------- job 2: router training

def query_features(queries: DataFrame, dim: int = embed.DEFAULT_DIM, encoder: Encoder | None = None) -> DataFrame:
    """``(query_id, features)``: the router's input, by its own encoder or as hashed text vector of ``dim``."""
    vectors = encoder(queries, "query_id") if encoder else embed.embed_queries(queries, dim)
    return vectors.withColumnRenamed("embedding", "features")


def prepare_router_data(train: DataFrame, test: DataFrame | None = None, same_source: bool = False,
                        experts: Sequence[str] = ("sparse", "dense"), fraction: float = 0.8,
                        seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Given test tables → clean both and drop train queries whose text is in test; same source or
    no test → clean and split into exact shares by hash. Raises when nothing is left to train on."""
    if test is None or same_source:
        return prepare.split_exact(prepare.clean(train, experts), fraction, seed, "query_id")
    tr = prepare.deleak(prepare.clean(train, experts), prepare.clean(test, experts), "query")
    if tr.isEmpty():
        raise ValueError("training data is empty after removing test queries")
    return tr, prepare.clean(test, experts)


class Trained(NamedTuple):
    """A fitted router; its test results; one row of accuracy; the chosen penalty and the losses on the way."""

    model: object
    results: DataFrame
    accuracy: DataFrame
    selection: dict


def train_router(train: DataFrame, test: DataFrame, experts: Sequence[str] = ("sparse", "dense"), norm: str = "l1",
                 reg_params: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1), validation_fraction: float = 0.1,
                 dim: int = embed.DEFAULT_DIM, hidden: Sequence[int] | None = None, encoder: Encoder | None = None) -> Trained:
    """Fit with model selection on an exact validation share (0.1 n rows, cut to a whole number).

    ``hidden`` layer sizes, such as ``soft_router.HIDDEN``, fit the hidden-layer router on the soft labels
    with early stopping; without them the router is a multinomial regression on the same loss. ``encoder``
    makes the router's features; the same one must be given when the router is used.

    Queries are told apart by source and id (a table without ``source`` is one source); a NULL id or
    a repeated query raises. ``results`` is ``([source], query_id, query, true_labels,
    predicted_weights)``; ``accuracy`` is one row.
    """
    def with_features(df):
        keyed = with_query_key(df).withColumnRenamed("query_id", "own_id").withColumnRenamed("query_key", "query_id")
        return keyed.join(query_features(keyed.select("query_id", F.col("query").alias("text")), dim, encoder), "query_id")

    tr = materialize(with_features(train))
    fit_part, val_part = (materialize(part) for part in prepare.split_validation(tr, validation_fraction, 4242, "query_id"))
    model, history = router.select_model(fit_part, val_part, experts, norm, reg_params, hidden=hidden)
    te = with_features(test)
    pred = router.predict(model, te, experts)
    ev = router.evaluate(pred, te, experts, norm)
    own = [F.col(c) for c in ("source",) if c in test.columns]
    results = ev.join(te.select("query_id", "own_id", "query", *own), "query_id").select(
        *own,
        F.col("own_id").alias("query_id"),
        "query",
        F.array(*[F.col(f"true_{e}") for e in experts]).alias("true_labels"),
        F.array(*[F.col(f"pred_{e}") for e in experts]).alias("predicted_weights"),
    )
    best = min(history, key=lambda h: h["val_loss"])
    return Trained(model, results, router.accuracy(ev), {"reg_param": best["reg_param"], "val_loss": best["val_loss"], "path": history})


# ---------------------------------------------------------------- job 3: routed search and benchmark

def routed_search(experts: Experts, model, queries: DataFrame, k: int = DEFAULT_K, runs: DataFrame | None = None,
                  dim: int = embed.DEFAULT_DIM, encoder: Encoder | None = None) -> DataFrame:
    """Fused top-k ``(query_id, doc_id, rank, score)`` with per-query weights from the router."""
    runs = runs if runs is not None else experts.search(queries, k)
    w = router.predict(model, query_features(queries, dim, encoder), experts.names)
    return fusion.fuse(runs, w, experts.names, k)


def benchmark(experts: Experts, queries: DataFrame, qrels: DataFrame, model=None, k: int = DEFAULT_K,
              corpus_name: str | None = None, fused_name: str = "fused",
              weights: dict | None = None, dim: int = embed.DEFAULT_DIM, encoder: Encoder | None = None) -> DataFrame:
    """Mean precision/recall at 1, 5, 10, 25 for each expert and the fused list, over all judged
    queries (expert runs computed once and reused for the fusion)."""
    judged = materialize(judgments.judged_queries(queries, qrels))  # every expert reads them
    runs = materialize(experts.search(judged, k))
    if model is not None:
        w = router.predict(model, query_features(judged, dim, encoder), experts.names)
    else:
        w = fusion.fixed_weights(judged, weights or {n: 1.0 / len(experts.names) for n in experts.names})
    fused = fusion.fuse(runs, w, experts.names, k)
    per_model = runs.select("query_id", F.col("expert").alias("model"), "doc_id", "rank").unionByName(
        fused.select("query_id", F.lit(fused_name).alias("model"), "doc_id", "rank")
    )
    s = metrics.summary(metrics.per_query(per_model, qrels, [*experts.names, fused_name]))
    return s.withColumn("corpus", F.lit(corpus_name)) if corpus_name else s


def benchmark_corpora(docs: DataFrame, queries: DataFrame, qrels: DataFrame, model=None, k: int = DEFAULT_K, fused_name: str = "fused",
                      weights: dict | None = None, dim: int = embed.DEFAULT_DIM, encoder: Encoder | None = None,
                      index: corpora.CorporaIndex | None = None) -> DataFrame:
    """Benchmark of several corpora in one plan: ``(corpus, model, k, precision, recall, n_queries)``.

    ``docs(corpus, doc_id, [title], text)``, ``queries(corpus, query_id, text)`` and ``qrels(corpus, query_id,
    doc_id, relevance)``; ids need only be unique within their corpus. One index, one search per expert,
    one fusion and one pass over the metrics serve all corpora, and each gets the figures of a
    :func:`benchmark` of its own with sparse and hashed dense experts. ``model``, ``weights`` and ``encoder``
    are as there; ``index`` is one of ``docs`` that exists already.
    """
    names = ("sparse", "dense")
    asked = queries.join(qrels.select("corpus", "query_id"), ["corpus", "query_id"], "left_semi").select("corpus", "query_id", "text")
    asked, judged = materialize(asked), corpora.keyed(qrels.select("corpus", "query_id", "doc_id", "relevance"))
    title = [F.col("title")] if "title" in docs.columns else []
    vectors = embed.embed_corpus(docs.select(F.struct("corpus", "doc_id").alias("doc_id"), *title, "text"), dim)
    sent = embed.embed_queries(corpora.keyed(asked), dim)
    runs = {
        "sparse": corpora.search(index or corpora.build_index(docs), asked, k),
        "dense": corpora.knn(sent.select("query_id.*", "embedding"), vectors.select("doc_id.*", "embedding"), k),
    }
    long = [runs[n].select("query_id", F.lit(n).alias("expert"), "doc_id", "rank", "score") for n in names]
    long = materialize(long[0].unionByName(long[1]))
    if model is not None:
        w = router.predict(model, query_features(corpora.keyed(asked), dim, encoder), names)
    else:
        w = fusion.fixed_weights(corpora.keyed(asked), weights or {n: 1.0 / len(names) for n in names})
    fused = fusion.fuse(long, w, names, k)
    per_model = long.select("query_id", F.col("expert").alias("model"), "doc_id", "rank").unionByName(
        fused.select("query_id", F.lit(fused_name).alias("model"), "doc_id", "rank")
    )
    each = metrics.per_query(per_model, judged, [*names, fused_name]).withColumn("corpus", F.col("query_id.corpus"))
    return metrics.summary(each, ("corpus", "model", "k"))
