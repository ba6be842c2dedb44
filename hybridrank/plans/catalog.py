"""Registered queries over the test tables, each with its DuckDB oracle SQL.

Every query reads whole tables (``{sf_dir}/{table}.parquet``) and returns a lazy DataFrame; doubles
are rounded to 6 places in the output, and ranks are taken on scores rounded to 9 places with
``doc_id`` breaking ties, on both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpora, dense, embed, fusion, judgments, labels, metrics, prepare, ranking, router, soft_router, sparse
from ..session import ensure_checkpoint_dir, materialize
from ..sources import readers
from ..sources import testdata as td
from ..sources.vector_store import VectorStore
from . import jobs

K = 25  # list depth used by label generation and the benchmark
OUT_DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), OUT_DIGITS).alias(alias or c)


# ---------------------------------------------------------------- shared building blocks

def _index(spark, sf_dir):
    return sparse.build_index(td.corpus(spark, sf_dir))


def _qrels(spark, sf_dir, index=None):
    corpus = td.corpus(spark, sf_dir)
    index = index or sparse.build_index(corpus)
    m = judgments.containing_documents(corpus, td.queries(spark, sf_dir), index)
    return judgments.graded_qrels(m, td.labels(spark, sf_dir))


# SQL fragments shared by the oracle statements (DuckDB dialect).
SQL_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
SQL_BM25_CTE = (
    r"""
doc_tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(' ' || text), '[\p{L}\p{N}]+') AS toks FROM documents),
dl AS MATERIALIZED (SELECT doc_id, len(toks) AS dl FROM doc_tok),
stats AS MATERIALIZED (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM doc_tok) GROUP BY term, doc_id),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs CROSS JOIN stats),
floored AS MATERIALIZED (SELECT 0.25 * avg(raw_idf) AS floor_idf FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw_idf < 0 THEN floor_idf ELSE raw_idf END AS idf FROM raw CROSS JOIN floored),
qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)
       GROUP BY query_id, term),
bm25 AS MATERIALIZED (
  SELECT q.query_id, p.doc_id,
         sum(q.qtf * i.idf * p.tf * 2.5::DOUBLE
             / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl))) AS score
  FROM qt q JOIN idf i USING (term) JOIN post p USING (term) JOIN dl l USING (doc_id) CROSS JOIN stats s
  GROUP BY q.query_id, p.doc_id),
sparse_run AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM bm25 QUALIFY rank <= 25)
"""
)

SQL_QRELS_CTE = r"""
qrels AS (
  SELECT b.item_id AS query_id, d.doc_id, (1 + coalesce(l.quality, 0))::INTEGER AS relevance
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


# ---------------------------------------------------------------- sparse (BM25)

@register(
    "tokens_per_doc",
    r"""
SELECT doc_id, len(toks)::INTEGER AS dl, len(list_distinct(toks))::INTEGER AS n_terms
FROM (SELECT doc_id, regexp_extract_all(lower(' ' || text), '[\p{L}\p{N}]+') AS toks FROM documents)
""",
)
def tokens_per_doc(spark, sf_dir):
    toks = sparse.corpus_tokens(td.corpus(spark, sf_dir))
    return toks.select(
        "doc_id",
        F.size("tokens").cast("int").alias("dl"),
        F.size(F.array_distinct("tokens")).cast("int").alias("n_terms"),
    )


@register(
    "postings_tf",
    r"""
SELECT term, doc_id, count(*)::INTEGER AS tf, any_value(dl)::INTEGER AS dl
FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term
      FROM (SELECT doc_id, regexp_extract_all(lower(' ' || text), '[\p{L}\p{N}]+') AS toks FROM documents))
GROUP BY term, doc_id
""",
)
def postings_tf(spark, sf_dir):
    return sparse.postings(td.corpus(spark, sf_dir))


@register(
    "term_idf",
    "WITH" + SQL_BM25_CTE.split("qt AS")[0].rstrip().rstrip(",") + "\nSELECT term, df, round(idf, 6) AS idf FROM idf",
)
def term_idf(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.terms.select("term", "df", r6("idf"))


@register(
    "bm25_topk",
    "WITH" + SQL_BM25_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse_run",
)
def bm25_topk(spark, sf_dir):
    idx = _index(spark, sf_dir)
    run = sparse.search(idx, td.queries(spark, sf_dir), k=K, expert=None)
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


@register(
    "qrels",
    "WITH" + SQL_QRELS_CTE + "SELECT query_id, doc_id, relevance FROM qrels",
)
def qrels(spark, sf_dir):
    return _qrels(spark, sf_dir)


@register(
    "bm25_pairs",
    "WITH"
    + SQL_BM25_CTE
    + ","
    + SQL_QRELS_CTE
    + """SELECT r.query_id, r.doc_id, round(coalesce(s.score, 0.0), 6) AS score
FROM qrels r LEFT JOIN bm25 s ON s.query_id = r.query_id AND s.doc_id = r.doc_id""",
)
def bm25_pairs(spark, sf_dir):
    corpus = td.corpus(spark, sf_dir)
    idx = sparse.build_index(corpus)
    pairs = _qrels(spark, sf_dir, idx).select("query_id", "doc_id")
    out = sparse.score_pairs(idx, td.queries(spark, sf_dir), pairs)
    return out.select("query_id", "doc_id", r6("score"))


# ---------------------------------------------------------------- dense (vectors and hashed text)

DIM = embed.DEFAULT_DIM
EXPERTS = ("sparse", "dense")


def sql_hashed(name: str, source: str, dim: int = DIM) -> str:
    """CTEs ``{name}`` = long-form normalised hashed vectors ``(id, dim, value)`` of ``source(id, term)``."""
    return f"""
{name}_raw AS (
  SELECT id, ((('0x' || substr(md5(term), 1, 8))::UBIGINT) % {dim})::INTEGER AS dim,
         sum(CASE WHEN ((('0x' || substr(md5(term), 9, 1))::INTEGER) % 2) = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value
  FROM ({source}) GROUP BY 1, 2),
{name} AS (
  SELECT r.id, r.dim, r.value / n.norm AS value
  FROM {name}_raw r JOIN (SELECT id, sqrt(sum(value * value)) AS norm FROM {name}_raw GROUP BY id) n USING (id)
  WHERE r.value <> 0 AND n.norm > 0)"""


SQL_DOC_TERMS = r"SELECT doc_id AS id, unnest(regexp_extract_all(lower(' ' || text), '[\p{L}\p{N}]+')) AS term FROM documents"
SQL_QUERY_TERMS = r"SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark"
SQL_DENSE_CTE = (
    sql_hashed("hd", SQL_DOC_TERMS)
    + ","
    + sql_hashed("hq", SQL_QUERY_TERMS)
    + """,
dense_scores AS (
  SELECT q.id AS query_id, d.id AS doc_id, sum(q.value * d.value) AS score
  FROM hq q JOIN hd d USING (dim) GROUP BY 1, 2),
dense_run AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM dense_scores QUALIFY rank <= 25)
"""
)


class Inputs:
    """Shared inputs of the registered queries, each built (and materialised) on first use only.

    The index, the two expert runs and the judgements are read several times by the later steps,
    so each is written once to the shared checkpoint folder instead of being recomputed.
    """

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.corpus = td.corpus(spark, sf_dir)
        self.queries = td.queries(spark, sf_dir)
        self._cache = {}

    def _get(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def index(self):
        return self._get("index", lambda: sparse.build_index(self.corpus))

    @property
    def sparse_run(self):
        return self._get("sparse", lambda: materialize(sparse.search(self.index, self.queries, k=K, expert="sparse")))

    @property
    def dense_run(self):
        def build():
            run = dense.knn(embed.embed_queries(self.queries, DIM), embed.embed_corpus(embed.spread(self.corpus), DIM), k=K, expert="dense")
            return materialize(run)

        return self._get("dense", build)

    @property
    def qrels(self):
        def build():
            m = judgments.containing_documents(self.corpus, self.queries, self.index)
            return materialize(judgments.graded_qrels(m, td.labels(self.spark, self.sf_dir)))

        return self._get("qrels", build)


def _experts(spark, sf_dir):
    """(corpus, queries, index, sparse run, dense run, qrels) — all materialised."""
    i = Inputs(spark, sf_dir)
    return i.corpus, i.queries, i.index, i.sparse_run, i.dense_run, i.qrels


@register(
    "hashed_embedding",
    "WITH" + sql_hashed("hd", SQL_DOC_TERMS) + "\nSELECT id AS doc_id, dim, round(value, 6) AS value FROM hd",
)
def hashed_embedding(spark, sf_dir):
    corpus = embed.spread(td.corpus(spark, sf_dir))
    long = embed.hashed_terms(corpus.select("doc_id", F.concat(F.lit(" "), F.col("text")).alias("t")), "doc_id", F.col("t"), DIM)
    return long.select(F.col("id").alias("doc_id"), "dim", r6("value"))


@register(
    "dense_topk",
    """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
nv AS (SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS e
       FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v)),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.e, b.e) AS score
      FROM nv a JOIN nv b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM s QUALIFY rank <= 10)
SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r
""",
)
def dense_topk(spark, sf_dir):
    """Leave-one-out 10-NN of every vector of ``embeddings`` among all the others."""
    v = td.vectors(spark, sf_dir)
    run = dense.knn(
        v.select(F.col("id").alias("query_id"), "embedding"),
        v.select(F.col("id").alias("doc_id"), "embedding"),
        k=10,
        exclude_self=True,
        expert=None,
    )
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


@register(
    "dense_hashed_topk",
    "WITH" + SQL_DENSE_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM dense_run",
)
def dense_hashed_topk(spark, sf_dir):
    """Dense expert: hashed-vector inner product of every benchmark passage against every document."""
    run = Inputs(spark, sf_dir).dense_run
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


@register(
    "dense_hashed_topk_pruned",
    "WITH" + SQL_DENSE_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM dense_run",
)
def dense_hashed_topk_pruned(spark, sf_dir):
    """The same run through cells and bounds."""
    i = Inputs(spark, sf_dir)
    run = dense.knn_pruned(embed.embed_queries(i.queries, DIM), embed.embed_corpus(embed.spread(i.corpus), DIM), k=K, expert=None, centres=32)
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


@register(
    "dense_store_topk",
    "WITH" + SQL_DENSE_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM dense_run",
)
def dense_store_topk(spark, sf_dir):
    """The same run from a vector store that held the passages before the documents came."""
    i = Inputs(spark, sf_dir)
    store = _vector_store(spark)
    store.add(i.queries)
    documents = store.vectors(embed.spread(i.corpus), "doc_id")
    run = dense.knn(store.vectors(i.queries, "query_id"), documents, k=K, expert=None)
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


def _vector_store(spark):
    from .jobs import hashed_encoder

    return VectorStore(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}", "hashed-256", hashed_encoder(DIM))


@register(
    "vector_store_runs",
    """
WITH d AS (SELECT coalesce(text, '') AS t FROM documents), q AS (SELECT coalesce(text, '') AS t FROM benchmark)
SELECT 1 AS run, (SELECT count(*) FROM d) AS n_rows, (SELECT count(DISTINCT t) FROM d) AS n_encoded
UNION ALL SELECT 2, (SELECT count(*) FROM d), 0
UNION ALL SELECT 3, (SELECT count(*) FROM q), (SELECT count(DISTINCT t) FROM q WHERE t NOT IN (SELECT t FROM d))
""",
)
def vector_store_runs(spark, sf_dir):
    """Texts that a vector store encodes for the documents, for the same again, and for the passages."""
    corpus, passages = embed.spread(td.corpus(spark, sf_dir)), td.queries(spark, sf_dir)
    store = _vector_store(spark)
    runs = [(n, df.count(), store.add(df)) for n, df in enumerate((corpus, corpus, passages), 1)]
    return spark.createDataFrame(runs, "run int, n_rows long, n_encoded long")


@register(
    "dense_pairs",
    "WITH"
    + SQL_DENSE_CTE
    + ","
    + SQL_QRELS_CTE
    + """SELECT r.query_id, r.doc_id, round(coalesce(s.score, 0.0), 6) AS score
FROM qrels r LEFT JOIN dense_scores s ON s.query_id = r.query_id AND s.doc_id = r.doc_id""",
)
def dense_pairs(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    corpus, queries, q = i.corpus, i.queries, i.qrels
    wanted = corpus.join(q.select("doc_id").distinct(), "doc_id", "left_semi")  # only judged documents are encoded
    out = dense.score_pairs(
        embed.embed_queries(queries, DIM), embed.embed_corpus(wanted, DIM), q.select("query_id", "doc_id")
    )
    return out.select("query_id", "doc_id", r6("score"))


# ---------------------------------------------------------------- rank matrix, labels, fusion, metrics

SQL_ALL_CTE = "WITH" + SQL_BM25_CTE + "," + SQL_DENSE_CTE + "," + SQL_QRELS_CTE + """,
runs AS (SELECT query_id, 'sparse' AS expert, doc_id, rank FROM sparse_run
         UNION ALL SELECT query_id, 'dense' AS expert, doc_id, rank FROM dense_run),
judged AS (SELECT DISTINCT query_id FROM qrels),
rr AS (SELECT r.query_id, r.expert, r.doc_id, r.rank, coalesce(q.relevance, 0) AS rel,
              count(*) OVER (PARTITION BY r.query_id, r.doc_id) AS cnt
       FROM runs r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id
       WHERE r.query_id IN (SELECT query_id FROM judged)),
es AS (SELECT query_id, expert, sum(1.0::DOUBLE / rank * rel / cnt) AS score FROM rr GROUP BY 1, 2),
expert_scores AS (
  SELECT j.query_id, e.expert, e.expert_pos, coalesce(es.score, 0.0) AS score
  FROM judged j CROSS JOIN (VALUES ('sparse', 0), ('dense', 1)) e(expert, expert_pos)
  LEFT JOIN es ON es.query_id = j.query_id AND es.expert = e.expert),
normed AS (
  SELECT *, CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w ELSE score END AS l1,
            exp(score) / sum(exp(score)) OVER w AS softmax
  FROM expert_scores WINDOW w AS (PARTITION BY query_id)),
wide AS (
  SELECT n.query_id, b.text AS query,
         max(CASE WHEN expert = 'sparse' THEN score END) AS sparse,
         max(CASE WHEN expert = 'dense' THEN score END) AS dense,
         max(CASE WHEN expert = 'sparse' THEN l1 END) AS sparse_l1,
         max(CASE WHEN expert = 'dense' THEN l1 END) AS dense_l1,
         max(CASE WHEN expert = 'sparse' THEN softmax END) AS sparse_softmax,
         max(CASE WHEN expert = 'dense' THEN softmax END) AS dense_softmax
  FROM normed n JOIN benchmark b ON b.item_id = n.query_id GROUP BY n.query_id, b.text),
fw AS (SELECT query_id, expert, 0.5::DOUBLE AS weight FROM judged CROSS JOIN (VALUES ('sparse'), ('dense')) e(expert)),
fscored AS (
  SELECT r.query_id, r.doc_id, sum(w.weight / r.rank) AS score,
         min(CASE WHEN r.expert = 'sparse' THEN 0 ELSE 1 END * 1000000 + r.rank) AS first_seen
  FROM runs r JOIN fw w ON w.query_id = r.query_id AND w.expert = r.expert GROUP BY 1, 2),
fused_run AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, doc_id) AS rank
  FROM fscored QUALIFY rank <= 25),
model_runs AS (
  SELECT query_id, 'sparse' AS model, doc_id, rank FROM sparse_run
  UNION ALL SELECT query_id, 'dense', doc_id, rank FROM dense_run
  UNION ALL SELECT query_id, 'fused', doc_id, rank FROM fused_run),
ks AS (SELECT * FROM (VALUES (1), (5), (10), (25)) t(k)),
nj AS (SELECT query_id, count(*) AS n_judged FROM qrels GROUP BY 1),
hits AS (SELECT m.query_id, m.model, k.k, sum(q.relevance) AS rel_at_k
         FROM model_runs m JOIN qrels q ON q.query_id = m.query_id AND q.doc_id = m.doc_id
         JOIN ks k ON m.rank <= k.k GROUP BY 1, 2, 3),
mpq AS (
  SELECT md.model, nj.query_id, ks.k,
         coalesce(h.rel_at_k, 0)::DOUBLE / ks.k AS precision,
         CASE WHEN nj.n_judged > 0 THEN coalesce(h.rel_at_k, 0)::DOUBLE / nj.n_judged ELSE 0.0 END AS recall
  FROM nj CROSS JOIN (VALUES ('sparse'), ('dense'), ('fused')) md(model) CROSS JOIN ks
  LEFT JOIN hits h ON h.query_id = nj.query_id AND h.model = md.model AND h.k = ks.k)
"""


def _label_inputs(spark, sf_dir):
    corpus, queries, idx, sr, dr, q = _experts(spark, sf_dir)
    judged = judgments.judged_queries(queries, q)
    runs = sr.unionByName(dr)
    return corpus, queries, judged, runs, sr, dr, q


@register(
    "rank_matrix",
    "WITH" + SQL_BM25_CTE + "," + SQL_DENSE_CTE + """
SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.doc_id, d.doc_id) AS doc_id,
       coalesce(s.rank, 0)::INTEGER AS sparse_rank, coalesce(d.rank, 0)::INTEGER AS dense_rank
FROM sparse_run s FULL OUTER JOIN dense_run d ON s.query_id = d.query_id AND s.doc_id = d.doc_id""",
)
def rank_matrix(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    sr, dr = i.sparse_run, i.dense_run
    m = ranking.rank_matrix(sr.unionByName(dr), EXPERTS)
    return m.select("query_id", "doc_id", *[F.col(f"{e}_rank").cast("int") for e in EXPERTS])


@register(
    "expert_scores",
    SQL_ALL_CTE + "SELECT query_id, expert, round(score, 6) AS score FROM expert_scores",
)
def expert_scores(spark, sf_dir):
    _, _, judged, runs, _, _, q = _label_inputs(spark, sf_dir)
    s = labels.expert_scores(runs, q, judged, EXPERTS, K)
    return s.select("query_id", "expert", r6("score"))


SCORE_COLS = ["sparse", "dense", "sparse_l1", "dense_l1", "sparse_softmax", "dense_softmax"]


@register(
    "expert_scores_norm",
    SQL_ALL_CTE
    + "SELECT query_id, query, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS)
    + " FROM wide",
)
def expert_scores_norm(spark, sf_dir):
    _, queries, _, runs, _, _, q = _label_inputs(spark, sf_dir)
    t = labels.score_table(runs, q, queries, EXPERTS, K)
    return t.select("query_id", "query", *[r6(c) for c in SCORE_COLS])


@register(
    "fused_topk",
    SQL_ALL_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM fused_run",
)
def fused_topk(spark, sf_dir):
    """Fusion with equal weights (0.5, 0.5) for every judged query."""
    _, _, judged, runs, _, _, _ = _label_inputs(spark, sf_dir)
    w = fusion.fixed_weights(judged, {"sparse": 0.5, "dense": 0.5})
    f = fusion.fuse(runs, w, EXPERTS, K)
    return f.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


def _model_runs(spark, sf_dir):
    _, _, judged, runs, sr, dr, q = _label_inputs(spark, sf_dir)
    w = fusion.fixed_weights(judged, {"sparse": 0.5, "dense": 0.5})
    fused = fusion.fuse(runs, w, EXPERTS, K).withColumn("model", F.lit("fused"))
    per = lambda r, m: r.select("query_id", F.lit(m).alias("model"), "doc_id", "rank")
    return per(sr, "sparse").unionByName(per(dr, "dense")).unionByName(fused.select("query_id", "model", "doc_id", "rank")), q


@register(
    "metrics_per_query",
    SQL_ALL_CTE + "SELECT model, query_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall FROM mpq",
)
def metrics_per_query(spark, sf_dir):
    runs, q = _model_runs(spark, sf_dir)
    m = metrics.per_query(runs, q, ("sparse", "dense", "fused"))
    return m.select("model", "query_id", "k", r6("precision"), r6("recall"))


@register(
    "metrics_summary",
    SQL_ALL_CTE
    + """SELECT model, k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       count(*) AS n_queries FROM mpq GROUP BY model, k""",
)
def metrics_summary(spark, sf_dir):
    runs, q = _model_runs(spark, sf_dir)
    s = metrics.summary(metrics.per_query(runs, q, ("sparse", "dense", "fused")))
    return s.select("model", "k", r6("precision"), r6("recall"), "n_queries")


#: Two corpora of all documents: those in English, and the others.
SQL_CORPORA = {"en": "lang IS NOT DISTINCT FROM 'en'", "other": "lang IS DISTINCT FROM 'en'"}


def _sql_by_corpus(sql: str) -> str:
    """``sql`` run for each corpus by itself, with its name."""
    own = lambda test: re.sub(r"\b(FROM|JOIN) documents\b", rf"\1 (SELECT * FROM documents WHERE {test})", sql)
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS corpus, * FROM ({own(test)})" for name, test in SQL_CORPORA.items())


def _corpora(spark, sf_dir):
    """Documents and queries of both corpora; every query is asked of both."""
    name = F.when(F.col("lang") == "en", "en").otherwise("other").alias("corpus")
    docs = td.table(spark, sf_dir, "documents").select(name, "doc_id", "text")
    queries = td.queries(spark, sf_dir).withColumn("corpus", F.explode(F.array(*[F.lit(c) for c in SQL_CORPORA])))
    return docs, queries


@register(
    "metrics_by_corpus",
    _sql_by_corpus(ORACLE["metrics_summary"]),
)
def metrics_by_corpus(spark, sf_dir):
    """``metrics_summary`` of two corpora in one plan: one index, search, fusion and summary, keyed by corpus."""
    docs, queries = _corpora(spark, sf_dir)
    index = corpora.build_index(docs)
    # ids differ between these corpora, so that one index also finds the documents that hold a passage
    listed = judgments.Listed(index.lists, index.dfs.groupBy("term").agg(F.sum("df").alias("df")))
    found = judgments.containing_documents(docs.drop("corpus"), td.queries(spark, sf_dir), listed)
    own = materialize(judgments.graded_qrels(found, td.labels(spark, sf_dir)).join(docs.select("corpus", "doc_id"), "doc_id"))
    s = jobs.benchmark_corpora(docs, queries, own, k=K, index=index)
    return s.select("corpus", "model", "k", r6("precision"), r6("recall"), "n_queries")


@register(
    "bm25_topk_by_corpus",
    _sql_by_corpus("WITH" + SQL_BM25_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse_run"),
)
def bm25_topk_by_corpus(spark, sf_dir):
    """Each corpus's own BM25 ranking of every query, from one index with each corpus's frequencies and lengths."""
    docs, queries = _corpora(spark, sf_dir)
    run = corpora.search(corpora.build_index(docs), queries, K)
    return run.select("query_id.corpus", "query_id.query_id", "doc_id", F.col("rank").cast("int").alias("rank"), r6("score"))


# ---------------------------------------------------------------- judgements look-up

@register(
    "qrels_judgment",
    "WITH" + SQL_BM25_CTE + "," + SQL_QRELS_CTE + """
SELECT s.query_id, s.doc_id, s.rank::INTEGER AS rank, coalesce(q.relevance, 0)::INTEGER AS relevance
FROM sparse_run s LEFT JOIN qrels q ON q.query_id = s.query_id AND q.doc_id = s.doc_id""",
)
def qrels_judgment(spark, sf_dir):
    """Relevance (0 when unjudged) of every (query, document) in the BM25 top-k."""
    i = Inputs(spark, sf_dir)
    sr, q = i.sparse_run, i.qrels
    j = judgments.judgments(sr.select("query_id", "doc_id", "rank"), q)
    return j.select("query_id", "doc_id", F.col("rank").cast("int"), F.col("relevance").cast("int"))


# ---------------------------------------------------------------- router data preparation

SEED = 42
TRAIN_FRACTION = 0.8
SQL_H = "(('0x' || substr(md5('42' || query_id::VARCHAR), 1, 8))::UBIGINT)"
SQL_PREP_CTE = SQL_ALL_CTE + f""",
clean AS (
  SELECT * FROM wide
  WHERE sparse IS NOT NULL AND NOT isnan(sparse) AND dense IS NOT NULL AND NOT isnan(dense)
    AND (sparse <> 0 OR dense <> 0)),
splits AS (SELECT *, CASE WHEN {SQL_H} < {int(TRAIN_FRACTION * 4294967296)} THEN 'train' ELSE 'test' END AS split FROM clean)
"""


def _score_table(spark, sf_dir):
    _, queries, _, runs, _, _, q = _label_inputs(spark, sf_dir)
    return labels.score_table(runs, q, queries, EXPERTS, K)


@register(
    "clean_scores",
    SQL_PREP_CTE + "SELECT query_id, query, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM clean",
)
def clean_scores(spark, sf_dir):
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    return t.select("query_id", "query", *[r6(c) for c in SCORE_COLS])


@register("split_train_test", SQL_PREP_CTE + "SELECT query_id, split FROM splits")
def split_train_test(spark, sf_dir):
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    train, test = prepare.split(t, TRAIN_FRACTION, SEED, "query_id")
    return train.select("query_id", F.lit("train").alias("split")).unionByName(
        test.select("query_id", F.lit("test").alias("split"))
    )


@register(
    "deleak",
    SQL_PREP_CTE
    + """SELECT c.query_id, c.query FROM clean c
WHERE NOT EXISTS (SELECT 1 FROM splits t WHERE t.split = 'test' AND t.query = c.query)""",
)
def deleak(spark, sf_dir):
    """All clean rows used as training data, minus every query text of the test split."""
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    _, test = prepare.split(t, TRAIN_FRACTION, SEED, "query_id")
    return prepare.deleak(t, test, "query").select("query_id", "query")


@register(
    "balance_classes",
    SQL_PREP_CTE
    + f"""
, w AS (SELECT *, CASE WHEN sparse > dense THEN 'sparse' WHEN dense > sparse THEN 'dense' END AS winner,
              {SQL_H} AS h FROM clean),
cnt AS (SELECT winner, count(*) AS c FROM w WHERE winner IS NOT NULL GROUP BY winner),
mc AS (SELECT count(*) AS n_classes, min(c) AS m FROM cnt),
picked AS (SELECT * FROM w WHERE winner IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY winner ORDER BY h, query_id) <= (SELECT m FROM mc))
SELECT query_id, winner FROM picked WHERE (SELECT n_classes FROM mc) = 2
UNION ALL SELECT query_id, winner FROM w WHERE (SELECT n_classes FROM mc) < 2""",
)
def balance_classes(spark, sf_dir):
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    b = prepare.balance(t, EXPERTS, SEED, "query_id")
    return b.select("query_id", prepare.winner(EXPERTS).alias("winner"))


# ---------------------------------------------------------------- router evaluation and training

def _kl_sql(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * (ln({p}) - ln(0.5)) ELSE 0.0 END)"


@register(
    "router_eval",
    SQL_PREP_CTE
    + f"""
, ev AS (
  SELECT query_id, sparse_l1 AS true_sparse, dense_l1 AS true_dense, 0.5::DOUBLE AS pred_sparse, 0.5::DOUBLE AS pred_dense,
         (CASE WHEN dense_l1 > sparse_l1 THEN 1 ELSE 0 END)::INTEGER AS true_class, 0::INTEGER AS pred_class,
         abs(sparse_l1 - dense_l1) <= 1e-8 + 1e-5 * abs(dense_l1) AS tie,
         {_kl_sql('sparse_l1')} + {_kl_sql('dense_l1')} AS kl
  FROM clean)
SELECT query_id, round(true_sparse, 6) AS true_sparse, round(true_dense, 6) AS true_dense,
       round(pred_sparse, 6) AS pred_sparse, round(pred_dense, 6) AS pred_dense, true_class, pred_class, tie,
       CASE WHEN NOT tie THEN true_class = pred_class END AS correct, round(kl, 6) AS kl
FROM ev""",
)
def router_eval(spark, sf_dir):
    """Evaluation of a constant router (equal weights) against the l1 labels."""
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    pred = fusion.fixed_weights(t, {"sparse": 0.5, "dense": 0.5})
    ev = router.evaluate(pred, t, EXPERTS, "l1")
    return ev.select(
        "query_id",
        r6("true_sparse"),
        r6("true_dense"),
        r6("pred_sparse"),
        r6("pred_dense"),
        F.col("true_class").cast("int"),
        F.col("pred_class").cast("int"),
        "tie",
        "correct",
        r6("kl"),
    )


@register(
    "router_accuracy",
    SQL_PREP_CTE
    + f"""
, ev AS (
  SELECT (CASE WHEN dense_l1 > sparse_l1 THEN 1 ELSE 0 END) AS true_class,
         abs(sparse_l1 - dense_l1) <= 1e-8 + 1e-5 * abs(dense_l1) AS tie,
         {_kl_sql('sparse_l1')} + {_kl_sql('dense_l1')} AS kl
  FROM clean)
SELECT round(coalesce(avg(CASE WHEN NOT tie THEN (true_class = 0)::INTEGER END), 0.0), 6) AS accuracy,
       count(CASE WHEN NOT tie THEN 1 END) AS n_eval, sum(tie::INTEGER)::BIGINT AS n_ties, round(avg(kl), 6) AS mean_kl
FROM ev""",
)
def router_accuracy(spark, sf_dir):
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    pred = fusion.fixed_weights(t, {"sparse": 0.5, "dense": 0.5})
    a = router.accuracy(router.evaluate(pred, t, EXPERTS, "l1"))
    return a.select(r6("accuracy"), "n_eval", F.col("n_ties").cast("long"), r6("mean_kl"))


def _router_data(spark, sf_dir):
    corpus, queries, judged, runs, sr, dr, q = _label_inputs(spark, sf_dir)
    table = prepare.clean(labels.score_table(runs, q, queries, EXPERTS, K), EXPERTS)
    feats = embed.embed_queries(queries, DIM).withColumnRenamed("embedding", "features")
    data = materialize(table.join(feats, "query_id"))  # every step of a fit reads it
    return data, queries, judged, runs, sr, dr, q


@register("router_fit_predict")
def router_fit_predict(spark, sf_dir):
    """Router trained on the train split (soft l1 labels, hashed query features); weights for the test split."""
    data, *_ = _router_data(spark, sf_dir)
    train, test = prepare.split(data, TRAIN_FRACTION, SEED, "query_id")
    model = router.fit(train, EXPERTS, "l1")
    w = router.predict(model, test, EXPERTS)
    return w.select("query_id", "expert", r6("weight"))


@register("routed_benchmark")
def routed_benchmark(spark, sf_dir):
    """Benchmark of sparse, dense and router-weighted fusion over all judged queries (router fitted on
    the train split of the label table)."""
    data, queries, judged, runs, sr, dr, q = _router_data(spark, sf_dir)
    train, _ = prepare.split(data, TRAIN_FRACTION, SEED, "query_id")
    model = router.fit(train, EXPERTS, "l1")
    feats = embed.embed_queries(judged, DIM).withColumnRenamed("embedding", "features")
    w = router.predict(model, feats, EXPERTS)
    fused = fusion.fuse(runs, w, EXPERTS, K).withColumn("model", F.lit("routed"))
    per = lambda r, m: r.select("query_id", F.lit(m).alias("model"), "doc_id", "rank")
    all_runs = per(sr, "sparse").unionByName(per(dr, "dense")).unionByName(fused.select("query_id", "model", "doc_id", "rank"))
    s = metrics.summary(metrics.per_query(all_runs, q, ("sparse", "dense", "routed")))
    return s.select("model", "k", r6("precision"), r6("recall"), "n_queries")


# ---------------------------------------------------------------- collection checks and variants

@register(
    "collection_stats",
    "WITH"
    + SQL_QRELS_CTE
    + """
SELECT (SELECT count(*) FROM documents) AS n_docs,
       (SELECT count(*) FROM benchmark) AS n_queries,
       (SELECT count(*) FROM qrels) AS n_qrels,
       (SELECT count(DISTINCT query_id) FROM qrels) AS n_judged_queries,
       (SELECT count(*) FROM (SELECT DISTINCT query_id FROM qrels) j
         WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = j.query_id)) AS orphan_queries,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM qrels) j
         WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = j.doc_id)) AS orphan_docs""",
)
def collection_stats(spark, sf_dir):
    """Sizes and orphan counts of the (corpus, queries, judgements) collection."""
    i = Inputs(spark, sf_dir)
    return readers.validate_collection(i.corpus, i.queries, i.qrels)


@register(
    "judged_query_text",
    "WITH"
    + SQL_QRELS_CTE
    + """
SELECT j.query_id, coalesce(b.text, '') AS text
FROM (SELECT DISTINCT query_id FROM qrels) j LEFT JOIN benchmark b ON b.item_id = j.query_id""",
)
def judged_query_text(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return judgments.with_query_text(i.qrels, i.queries)


@register(
    "class_counts",
    SQL_PREP_CTE
    + """
SELECT winner, count(*) AS n FROM (
  SELECT CASE WHEN sparse > dense THEN 'sparse' WHEN dense > sparse THEN 'dense' END AS winner FROM clean)
WHERE winner IS NOT NULL GROUP BY winner""",
)
def class_counts(spark, sf_dir):
    """How often each expert strictly wins (the balancing classes; ties excluded)."""
    t = prepare.clean(_score_table(spark, sf_dir), EXPERTS)
    w = t.select(prepare.winner(EXPERTS).alias("winner")).filter(F.col("winner").isNotNull())
    return w.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@register(
    "metrics_summary_binary",
    SQL_ALL_CTE
    + """,
bhits AS (SELECT m.query_id, m.model, k.k, sum(CASE WHEN q.relevance > 0 THEN 1 ELSE 0 END) AS rel_at_k
          FROM model_runs m JOIN qrels q ON q.query_id = m.query_id AND q.doc_id = m.doc_id
          JOIN ks k ON m.rank <= k.k GROUP BY 1, 2, 3),
bmpq AS (
  SELECT md.model, nj.query_id, ks.k,
         coalesce(h.rel_at_k, 0)::DOUBLE / ks.k AS precision,
         CASE WHEN nj.n_judged > 0 THEN coalesce(h.rel_at_k, 0)::DOUBLE / nj.n_judged ELSE 0.0 END AS recall
  FROM nj CROSS JOIN (VALUES ('sparse'), ('dense'), ('fused')) md(model) CROSS JOIN ks
  LEFT JOIN bhits h ON h.query_id = nj.query_id AND h.model = md.model AND h.k = ks.k)
SELECT model, k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) AS n_queries
FROM bmpq GROUP BY model, k""",
)
def metrics_summary_binary(spark, sf_dir):
    """As ``metrics_summary`` with binary relevance (a judged document counts 1 whatever its grade)."""
    runs, q = _model_runs(spark, sf_dir)
    s = metrics.summary(metrics.per_query(runs, q, ("sparse", "dense", "fused"), graded=False))
    return s.select("model", "k", r6("precision"), r6("recall"), "n_queries")


@register(
    "bm25_topk_stored",
    "WITH" + SQL_BM25_CTE + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse_run",
)
def bm25_topk_stored(spark, sf_dir):
    """``bm25_topk`` through the persisted index: written as Parquet (postings partitioned by term
    bucket) into the shared checkpoint folder, read back, searched with the bucket partition filter."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import index_store

    path = os.path.join(ensure_checkpoint_dir(spark), f"bm25-index-{uuid.uuid4().hex}")
    idx = index_store.sparse_index(td.corpus(spark, sf_dir), path)
    run = sparse.search(idx, td.queries(spark, sf_dir), k=K, expert=None)
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


# ---------------------------------------------------------------- preparation over labelled documents

# A score table from the given data in which every branch occurs: zero rows, both winners, ties and
# repeated texts. sparse = quality / (1 + n_chars % 7), dense = toxic / (1 + n_chars % 5).
SQL_LABELLED = f"""WITH wide AS (
  SELECT l.doc_id AS query_id, d.text AS query, l.quality / (1 + d.n_chars % 7)::DOUBLE AS sparse, l.toxic / (1 + d.n_chars % 5)::DOUBLE AS dense
  FROM labels l JOIN documents d USING (doc_id)),
normed AS (
  SELECT *, CASE WHEN sparse + dense > 0 THEN sparse / (sparse + dense) ELSE sparse END AS sparse_l1,
         CASE WHEN sparse + dense > 0 THEN dense / (sparse + dense) ELSE dense END AS dense_l1,
         exp(sparse) / (exp(sparse) + exp(dense)) AS sparse_softmax, exp(dense) / (exp(sparse) + exp(dense)) AS dense_softmax FROM wide),
clean AS (SELECT *, {SQL_H} AS h FROM normed WHERE sparse <> 0 OR dense <> 0),
splits AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY h, query_id) <= (SELECT round({TRAIN_FRACTION} * count(*)) FROM clean)
                          THEN 'train' ELSE 'test' END AS split FROM clean)
"""


def _labelled(spark, sf_dir):
    """``query_id, query, {e}, {e}_l1, {e}_softmax``: one row per labelled document."""
    docs = td.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    rows = td.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(docs, "doc_id")
    scores = {"sparse": F.col("quality") / (1 + F.col("n_chars") % 7), "dense": F.col("toxic") / (1 + F.col("n_chars") % 5)}
    long = rows.select(
        F.col("doc_id").alias("query_id"),
        F.explode(F.array(*[F.struct(F.lit(e).alias("expert"), c.cast("double").alias("score")) for e, c in scores.items()])).alias("s"),
    ).select("query_id", "s.*")
    wide = labels.to_wide(labels.normalize_scores(long), EXPERTS)
    return wide.join(rows.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id")


def _labelled_clean(spark, sf_dir):
    return prepare.clean(_labelled(spark, sf_dir), EXPERTS)


@register("labelled_clean", SQL_LABELLED + "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM clean")
def labelled_clean(spark, sf_dir):
    return _labelled_clean(spark, sf_dir).select("query_id", *[r6(c) for c in SCORE_COLS])


@register("labelled_split_exact", SQL_LABELLED + "SELECT query_id, split FROM splits")
def labelled_split_exact(spark, sf_dir):
    """Exactly 80 % of the rows train."""
    train, test = prepare.split_exact(_labelled_clean(spark, sf_dir), TRAIN_FRACTION, SEED, "query_id")
    return train.select("query_id", F.lit("train").alias("split")).unionByName(test.select("query_id", F.lit("test").alias("split")))


@register(
    "labelled_deleak",
    SQL_LABELLED + "SELECT query_id FROM splits s WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM splits t WHERE t.split = 'test' AND t.query = s.query)",
)
def labelled_deleak(spark, sf_dir):
    """Train rows without those whose text a test row repeats."""
    train, test = prepare.split_exact(_labelled_clean(spark, sf_dir), TRAIN_FRACTION, SEED, "query_id")
    return prepare.deleak(train, test, "query").select("query_id")


SQL_LABELLED_WINNERS = SQL_LABELLED + """, w AS (
  SELECT *, CASE WHEN sparse > dense THEN 'sparse' WHEN dense > sparse THEN 'dense' END AS winner FROM clean)
"""


@register("labelled_class_counts", SQL_LABELLED_WINNERS + "SELECT winner, count(*) AS n FROM w WHERE winner IS NOT NULL GROUP BY winner")
def labelled_class_counts(spark, sf_dir):
    w = _labelled_clean(spark, sf_dir).select(prepare.winner(EXPERTS).alias("winner")).filter(F.col("winner").isNotNull())
    return w.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@register(
    "labelled_balance",
    SQL_LABELLED_WINNERS
    + """SELECT query_id, winner FROM w WHERE winner IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY winner ORDER BY h, query_id)
        <= (SELECT min(c) FROM (SELECT count(*) AS c FROM w WHERE winner IS NOT NULL GROUP BY winner))""",
)
def labelled_balance(spark, sf_dir):
    """Both classes occur: the larger one is cut to the size of the smaller."""
    b = prepare.balance(_labelled_clean(spark, sf_dir), EXPERTS, SEED, "query_id")
    return b.select("query_id", prepare.winner(EXPERTS).alias("winner"))


# A router with given coefficients over two features of the query, so that SQL can predict the same.
FIXED_COEFFICIENTS = ((0.5, -0.25), (-0.75, 0.5))
FIXED_INTERCEPTS = (0.5, -0.5)


def _sql_fixed(e: int) -> str:
    a, b = FIXED_COEFFICIENTS[e]
    return f"exp({a} * f0 + {b} * f1 + {FIXED_INTERCEPTS[e]})"


SQL_FIXED = SQL_LABELLED + f""", feats AS (SELECT *, (length(query) % 3)::DOUBLE AS f0, (length(query) % 4)::DOUBLE AS f1 FROM clean),
pred AS (SELECT *, {_sql_fixed(0)} / ({_sql_fixed(0)} + {_sql_fixed(1)}) AS p_sparse, {_sql_fixed(1)} / ({_sql_fixed(0)} + {_sql_fixed(1)}) AS p_dense FROM feats),
ev AS (SELECT query_id, (CASE WHEN dense_l1 > sparse_l1 THEN 1 ELSE 0 END) AS true_class, (CASE WHEN p_dense > p_sparse THEN 1 ELSE 0 END) AS pred_class,
         abs(sparse_l1 - dense_l1) <= 1e-8 + 1e-5 * abs(dense_l1) AS tie,
         (CASE WHEN sparse_l1 > 0 THEN sparse_l1 * (ln(sparse_l1) - ln(p_sparse)) ELSE 0 END)
         + (CASE WHEN dense_l1 > 0 THEN dense_l1 * (ln(dense_l1) - ln(p_dense)) ELSE 0 END) AS kl FROM pred)
"""


def _fixed_predictions(spark, sf_dir):
    t = _labelled_clean(spark, sf_dir)
    feats = t.withColumn("features", F.array(*[(F.length("query") % m).cast("double") for m in (3, 4)]))
    return t, router.predict(router.from_coefficients(spark, FIXED_COEFFICIENTS, FIXED_INTERCEPTS), feats, EXPERTS)


@register("router_predict_fixed", SQL_FIXED + "SELECT query_id, round(p_sparse, 6) AS sparse, round(p_dense, 6) AS dense FROM pred")
def router_predict_fixed(spark, sf_dir):
    """Weights of a router with given coefficients."""
    _, w = _fixed_predictions(spark, sf_dir)
    wide = router.wide_weights(w, EXPERTS)
    return wide.select("query_id", *[F.round(F.col("w")[i], 6).alias(e) for i, e in enumerate(EXPERTS)])


@register(
    "router_eval_fixed",
    SQL_FIXED + """SELECT query_id, true_class, pred_class, tie, CASE WHEN NOT tie THEN true_class = pred_class END AS correct, round(kl, 6) AS kl FROM ev""",
)
def router_eval_fixed(spark, sf_dir):
    """Evaluation of that router: both classes are true and predicted, some rows tie."""
    t, w = _fixed_predictions(spark, sf_dir)
    ev = router.evaluate(w, t, EXPERTS, "l1")
    return ev.select("query_id", F.col("true_class").cast("int"), F.col("pred_class").cast("int"), "tie", "correct", r6("kl"))


@register(
    "router_accuracy_fixed",
    SQL_FIXED
    + """SELECT round(coalesce(avg(CASE WHEN NOT tie THEN (true_class = pred_class)::INTEGER END), 0.0), 6) AS accuracy,
       count(CASE WHEN NOT tie THEN 1 END) AS n_eval, sum(tie::INTEGER)::BIGINT AS n_ties, round(avg(kl), 6) AS mean_kl FROM ev""",
)
def router_accuracy_fixed(spark, sf_dir):
    t, w = _fixed_predictions(spark, sf_dir)
    a = router.accuracy(router.evaluate(w, t, EXPERTS, "l1"))
    return a.select(r6("accuracy"), "n_eval", F.col("n_ties").cast("long"), r6("mean_kl"))


@register("router_fit_mean", SQL_LABELLED + "SELECT round(avg(sparse_l1), 3) AS sparse, round(avg(dense_l1), 3) AS dense FROM clean")
def router_fit_mean(spark, sf_dir):
    """A router fitted on constant features learns the mean soft label."""
    data = materialize(_labelled_clean(spark, sf_dir).withColumn("features", F.array(F.lit(1.0))))
    model = router.fit(data, EXPERTS, "l1", reg_param=0.0)
    w = router.wide_weights(router.predict(model, data.limit(1), EXPERTS), EXPERTS)
    return w.select(*[F.round(F.col("w")[i], 3).alias(e) for i, e in enumerate(EXPERTS)])


# A router of one hidden layer with given weights (2 features, 2 hidden units, 2 experts).
HIDDEN_WEIGHTS = (((0.5, -0.5), (-0.25, 0.75)), ((0.75, -0.5), (-0.25, 0.5)))
HIDDEN_BIASES = ((0.125, -0.25), (0.25, -0.125))


def _sql_layer(layer: int, out: int, inputs: tuple[str, str]) -> str:
    w, b = HIDDEN_WEIGHTS[layer], HIDDEN_BIASES[layer]
    return f"({w[0][out]}::DOUBLE * {inputs[0]} + {w[1][out]}::DOUBLE * {inputs[1]} + {b[out]}::DOUBLE)"


def _sql_gradient() -> str:
    """Mean gradient in the order of the parameters: weights row by row, then biases, layer after layer."""
    cells = [f"avg(f{i} * d{j})" for i in range(2) for j in range(2)] + [f"avg(d{j})" for j in range(2)]
    cells += [f"avg(h{i} * e{j})" for i in range(2) for j in range(2)] + [f"avg(e{j})" for j in range(2)]
    return " UNION ALL ".join(f"SELECT {n}::INTEGER AS parameter, round({c}, 6) AS gradient FROM back" for n, c in enumerate(cells))


SQL_HIDDEN = SQL_FIXED.split("pred AS (")[0] + f"""
hid AS (SELECT *, greatest({_sql_layer(0, 0, ('f0', 'f1'))}, 0) AS h0, greatest({_sql_layer(0, 1, ('f0', 'f1'))}, 0) AS h1 FROM feats),
logit AS (SELECT *, exp({_sql_layer(1, 0, ('h0', 'h1'))}) AS x0, exp({_sql_layer(1, 1, ('h0', 'h1'))}) AS x1 FROM hid),
net AS (SELECT *, x0 / (x0 + x1) AS p0, x1 / (x0 + x1) AS p1 FROM logit),
err AS (SELECT *, p0 * (sparse_l1 + dense_l1) - sparse_l1 AS e0, p1 * (sparse_l1 + dense_l1) - dense_l1 AS e1 FROM net),
back AS (SELECT *, (CASE WHEN h0 > 0 THEN {HIDDEN_WEIGHTS[1][0][0]} * e0 + {HIDDEN_WEIGHTS[1][0][1]} * e1 ELSE 0 END)::DOUBLE AS d0,
         (CASE WHEN h1 > 0 THEN {HIDDEN_WEIGHTS[1][1][0]} * e0 + {HIDDEN_WEIGHTS[1][1][1]} * e1 ELSE 0 END)::DOUBLE AS d1 FROM err)
"""


def _hidden_inputs(spark, sf_dir):
    import numpy as np

    t = _labelled_clean(spark, sf_dir)
    feats = t.withColumn("features", F.array(*[(F.length("query") % m).cast("double") for m in (3, 4)]))
    return feats, soft_router.SoftRouter([np.array(w) for w in HIDDEN_WEIGHTS], [np.array(b) for b in HIDDEN_BIASES])


@register("soft_router_predict_fixed", SQL_HIDDEN + "SELECT query_id, round(p0, 6) AS sparse, round(p1, 6) AS dense FROM net")
def soft_router_predict_fixed(spark, sf_dir):
    """Weights of a hidden-layer router with given layers."""
    feats, model = _hidden_inputs(spark, sf_dir)
    wide = router.wide_weights(router.predict(model, feats, EXPERTS), EXPERTS)
    return wide.select("query_id", *[F.round(F.col("w")[i], 6).alias(e) for i, e in enumerate(EXPERTS)])


@register("soft_router_gradient_fixed", SQL_HIDDEN + _sql_gradient())
def soft_router_gradient_fixed(spark, sf_dir):
    """The mean gradient of its KL loss on the soft labels, a row per parameter."""
    feats, model = _hidden_inputs(spark, sf_dir)
    data = soft_router.training_table(feats, EXPERTS, "l1", False)
    _, n, _, _, g = soft_router.sums(data, model.flat(), model.sizes)
    return spark.createDataFrame([(i, float(v) / n) for i, v in enumerate(g)], "parameter int, gradient double").select("parameter", r6("gradient"))


# A router over the hashed features whose weights depend on one dimension, so that SQL can route too.
SQL_ROUTED = SQL_ALL_CTE + """,
rf AS (SELECT j.query_id, coalesce(h.value, 0.0) AS x FROM judged j LEFT JOIN hq h ON h.id = j.query_id AND h.dim = 0),
rw AS (SELECT query_id, 'sparse' AS expert, exp(4 * x + 0.5) / (exp(4 * x + 0.5) + exp(-2 * x)) AS weight FROM rf
       UNION ALL SELECT query_id, 'dense', exp(-2 * x) / (exp(4 * x + 0.5) + exp(-2 * x)) FROM rf),
rscored AS (
  SELECT r.query_id, r.doc_id, sum(w.weight / r.rank) AS score, min(CASE WHEN r.expert = 'sparse' THEN 0 ELSE 1 END * 1000000 + r.rank) AS first_seen
  FROM runs r JOIN rw w ON w.query_id = r.query_id AND w.expert = r.expert GROUP BY 1, 2),
rfused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, doc_id) AS rank
           FROM rscored QUALIFY rank <= 25)
"""


@register("routed_search_fixed", SQL_ROUTED + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM rfused")
def routed_search_fixed(spark, sf_dir):
    """``jobs.routed_search`` of the judged queries with a router of given coefficients."""
    from . import jobs

    i = Inputs(spark, sf_dir)
    judged = materialize(judgments.judged_queries(i.queries, i.qrels))
    zeros = [0.0] * (DIM - 1)
    model = router.from_coefficients(spark, [[4.0, *zeros], [-2.0, *zeros]], [0.5, 0.0])
    experts = jobs.Experts(sparse=jobs.SparseExpert(i.corpus), dense=jobs.DenseExpert(i.corpus))
    run = jobs.routed_search(experts, model, judged, K)
    return run.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))


SQL_TWO_TABLES = SQL_LABELLED + """, tables AS (
  SELECT 'even' AS source, (query_id // 2)::VARCHAR AS query_id, * EXCLUDE (query_id) FROM normed WHERE query_id % 2 = 0
  UNION ALL SELECT 'odd', (query_id // 2)::VARCHAR, * EXCLUDE (query_id) FROM normed WHERE query_id % 2 = 1)
"""


def _two_tables(spark, sf_dir):
    """The labelled table written as two score tables whose ids overlap, and read back as one."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import writers

    t = _labelled(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark)}/score-tables-{uuid.uuid4().hex}"
    for parity, source in ((0, "even"), (1, "odd")):
        part = t.filter(F.pmod("query_id", F.lit(2)) == parity).withColumn("query_id", F.floor(F.col("query_id") / 2).cast("string"))
        writers.write_score_table(part.select("query_id", "query", *SCORE_COLS), f"{root}/{source}")
    return readers.read_score_tables(spark, [f"{root}/even", f"{root}/odd"], EXPERTS, sources=["even", "odd"])


@register(
    "score_table_union",
    SQL_TWO_TABLES + "SELECT source, query_id, length(query)::INTEGER AS n_chars, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM tables",
)
def score_table_union(spark, sf_dir):
    return _two_tables(spark, sf_dir).select("source", "query_id", F.length("query").alias("n_chars"), *[r6(c) for c in SCORE_COLS])


@register("score_table_positions", SQL_LABELLED + "SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1)::BIGINT AS query_idx FROM normed")
def score_table_positions(spark, sf_dir):
    """Each row's place in the score table, as its CSV has it."""
    return ranking.with_position(_labelled(spark, sf_dir), ["query_id"], "query_idx").select("query_id", "query_idx")


@register(
    "router_training_rows",
    SQL_TWO_TABLES + """SELECT source, query_id, label, round(weight, 6) AS weight FROM (
  SELECT source, query_id, 0.0::DOUBLE AS label, sparse_l1 AS weight FROM tables WHERE sparse <> 0 OR dense <> 0
  UNION ALL SELECT source, query_id, 1.0::DOUBLE, dense_l1 FROM tables WHERE sparse <> 0 OR dense <> 0) WHERE weight > 0""",
)
def router_training_rows(spark, sf_dir):
    """Training rows of both tables: an id that both hold stays two queries."""
    keyed = readers.with_query_key(prepare.clean(_two_tables(spark, sf_dir), EXPERTS))
    rows = router.training_rows(
        keyed.withColumn("query_id", F.col("query_key")).withColumn("features", F.array(F.lit(1.0))), EXPERTS, "l1"
    )
    own = F.from_json("query_id", "source string, query_id string")
    return rows.select(own.alias("own"), "label", r6("weight")).select("own.source", "own.query_id", "label", "weight")


SQL_PER_QUERY_FUSION = SQL_ALL_CTE + """,
pw AS (SELECT query_id, 'sparse' AS expert, sparse_l1 AS weight FROM wide UNION ALL SELECT query_id, 'dense', dense_l1 FROM wide),
pscored AS (
  SELECT r.query_id, r.doc_id, sum(w.weight / r.rank) AS score, min(CASE WHEN r.expert = 'sparse' THEN 0 ELSE 1 END * 1000000 + r.rank) AS first_seen
  FROM runs r JOIN pw w ON w.query_id = r.query_id AND w.expert = r.expert GROUP BY 1, 2),
pfused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, doc_id) AS rank
           FROM pscored QUALIFY rank <= 25)
"""


@register("fused_topk_weighted", SQL_PER_QUERY_FUSION + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM pfused")
def fused_topk_weighted(spark, sf_dir):
    """Fusion with each query's own l1 labels as weights."""
    _, queries, judged, runs, _, _, q = _label_inputs(spark, sf_dir)
    t = labels.score_table(runs, q, queries, EXPERTS, K)
    pairs = F.array(*[F.struct(F.lit(e).alias("expert"), F.col(f"{e}_l1").alias("weight")) for e in EXPERTS])
    w = t.select("query_id", F.explode(pairs).alias("w")).select("query_id", "w.*")
    judged_runs = runs.join(judged.select("query_id"), "query_id", "left_semi")
    f = fusion.fuse(judged_runs, w, EXPERTS, K)
    return f.select("query_id", "doc_id", F.col("rank").cast("int"), r6("score"))
