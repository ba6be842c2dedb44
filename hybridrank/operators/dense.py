"""Dense (inner-product) retrieval: exact top-k over L2-normalised vectors, in two forms.

:func:`knn` streams the corpus past the queries: a bounded block of query vectors is sent once to every
task, corpus batches meet it in matrix products of fixed size, and a task keeps the best k so far of
each query. No vector is shuffled; only k candidates per query and task are.

:func:`knn_pruned` is for many queries. Corpus vectors are dealt to cells around centres; by the triangle
inequality a cell holds no vector closer to a query than its centre's distance less its radius. Each
query visits its nearest cell, then those cells only that could still beat its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize
from ..schemas import require
from ..session import materialize
from .ranking import RANK_DIGITS, top_k

#: Query vectors sent to the tasks at once; more queries take more passes over the corpus.
PASS_QUERIES = 16_384
#: Corpus vectors and queries of one matrix product.
TILE, CHUNK = 4096, 64


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """A matrix of normalised rows; a zero vector stays zero."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.zeros((0, 0))
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    m = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    n[n == 0] = 1.0
    m /= n[:, None]  # a copy of its own, see above
    return m


def tile_topk(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of exactly the best k finite entries of each row (all, if fewer).

    Entries are compared after rounding; of equal ones those further left stay.
    """
    keep = np.isfinite(s)
    n = s.shape[1]
    if n > k:
        rounded = np.round(s, RANK_DIGITS)
        kth = np.partition(rounded, n - k, axis=1)[:, n - k][:, None]
        tied, above = rounded == kth, rounded > kth
        keep &= above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)


class Best:
    """The best k documents so far of each of some queries: scores and ids, ties to the smaller id."""

    def __init__(self, queries: int, k: int, ids: pa.DataType) -> None:
        self.k, self.ids = k, pa.array([], ids)
        self.query, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, ids: pa.Array, at: np.ndarray, score: np.ndarray) -> None:
        pool = pa.concat_arrays([self.ids, ids])
        query, at, score = (np.concatenate(x) for x in ((self.query, query), (self.at, at + len(self.ids)), (self.score, score)))
        rank = np.empty(len(pool), np.int64)
        rank[pc.sort_indices(pool).to_numpy()] = np.arange(len(pool))
        order = np.lexsort((rank[at], -np.round(score, RANK_DIGITS), query))
        of = query[order]
        first = np.searchsorted(of, of)  # where each one's query begins
        order = order[np.arange(len(of)) - first < self.k]
        used, self.at = np.unique(at[order], return_inverse=True)
        self.query, self.score, self.ids = query[order], score[order], pool.take(pa.array(used))


class Stream:
    """Best documents so far of some queries, as batches of vectors pass."""

    def __init__(self, query_ids: pa.Array, q: np.ndarray, k: int, exclude_self: bool, tile: int, chunk: int) -> None:
        self.query_ids, self.q, self.k, self.exclude_self, self.tile, self.chunk = query_ids, q, k, exclude_self, tile, chunk
        self.best = None

    def add(self, batch) -> None:
        q, k, chunk = self.q, self.k, self.chunk
        for at in range(0, batch.num_rows, self.tile):
            part = batch.slice(at, self.tile)
            part = part.take(pc.sort_indices(part.column("doc_id")))  # ties go to the smaller id
            ids, vectors = part.column("doc_id"), unit_rows(part.column("vec"))
            own = pc.index_in(ids, self.query_ids).to_numpy(zero_copy_only=False) if self.exclude_self else None
            self.best = self.best or Best(len(q), k, ids.type)
            found = []
            if not len(q):
                continue
            for start in range(0, len(q), chunk):
                s = q[start : start + chunk] @ vectors.T
                if self.exclude_self:
                    mine = np.flatnonzero((own >= start) & (own < start + len(s)))
                    s[own[mine].astype(np.int64) - start, mine] = -np.inf
                qi, ci = tile_topk(s, k)
                found.append((qi + start, ci, s[qi, ci]))
            self.best.add(np.concatenate([f[0] for f in found]), ids, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))

    def found(self):
        if (best := self.best) is not None:
            yield pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(best.query)), best.ids.take(pa.array(best.at)), pa.array(best.score)], names=["query_id", "doc_id", "score"])


def _inputs(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    require(queries, ("query_id", "embedding"), "queries")
    require(corpus, ("doc_id", "embedding"), "corpus")
    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("vec"))
    c = corpus.filter(F.col("embedding").isNotNull()).select("doc_id", F.col("embedding").alias("vec"))
    kinds = [df.schema[n].dataType.simpleString() for df, n in ((q, "query_id"), (c, "doc_id"))]
    return q, c, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"


def _run(candidates: DataFrame, k: int, expert: str | None) -> DataFrame:
    ranked = top_k(candidates, k)
    cols = ["query_id", "doc_id", "rank", "score"]
    if expert is not None:
        ranked = ranked.withColumn("expert", F.lit(expert))
        cols.insert(1, "expert")
    return ranked.select(*cols)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    *,
    exclude_self: bool = False,
    expert: str | None = "dense",
    pass_queries: int = PASS_QUERIES,
    tile: int = TILE,
    chunk: int = CHUNK,
) -> DataFrame:
    """Top-k inner-product run ``(query_id, [expert], doc_id, rank, score)``.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)``; vectors are L2-normalised, null ones
    left out. ``exclude_self`` skips a document whose id equals the query id (leave-one-out search).
    Ties: rounded score descending, doc_id ascending. If ``k`` exceeds the corpus, all documents.

    Up to ``pass_queries`` query vectors (32 MB at 256 dimensions) go to the tasks at a time. More queries
    are dealt to passes, whose candidates are written before the next begins. A task holds them, ``k``
    candidates of each, and ``chunk x tile`` scores.
    """
    q, c, schema = _inputs(queries, corpus)
    q = materialize(q)
    passes = max(1, -(-q.count() // pass_queries))
    out = None
    for i in range(passes):
        own = (q if passes == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)).toArrow()
        ids, vectors = own.column("query_id").combine_chunks(), unit_rows(own.column("vec").combine_chunks())
        sent = q.sparkSession.sparkContext.broadcast((ids, vectors))

        def search(batches, sent=sent):
            stream = Stream(*sent.value, k, exclude_self, tile, chunk)
            for batch in batches:
                stream.add(batch)
            yield from stream.found()

        part = c.mapInArrow(search, schema)
        part = part if passes == 1 else materialize(part)
        out = part if out is None else out.unionByName(part)
    return _run(out, k, expert)


# ---------------------------------------------------------------- many queries: cells and bounds

#: Vectors and queries of one cell that meet in one task.
CELL_ROWS = 8192
#: What rounding may add to an angle.
SLACK = 1e-6


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def choose_centres(corpus: DataFrame, n: int, rounds: int = 5, per_centre: int = 32) -> np.ndarray:
    """``n`` unit vectors, means of the groups of a sample of at most ``n * per_centre`` vectors.

    Centres only decide how much is pruned, never the result. The sample is by hash of the id.
    """
    sample = corpus.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(n * per_centre).toArrow()
    vectors = unit_rows(sample.column("vec").combine_chunks())
    centres = vectors[:: max(1, len(vectors) // n)][:n]
    for _ in range(rounds if len(vectors) else 0):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def _cell_scores(k: int, exclude_self: bool, chunk: int):
    """Best k of a part of a cell for each query that visits it, and how many products that took."""

    def score(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        corpus = corpus.take(pc.sort_indices(corpus.column("doc_id")))
        ids, query_ids = corpus.column("doc_id").combine_chunks(), queries.column("query_id").combine_chunks()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(query_ids):
            vectors, q = unit_rows(corpus.column("vec").combine_chunks()), unit_rows(queries.column("vec").combine_chunks())
            own = pc.index_in(ids, query_ids).to_numpy(zero_copy_only=False) if exclude_self else None
            for start in range(0, len(q), chunk):
                s = q[start : start + chunk] @ vectors.T
                if exclude_self:
                    mine = np.flatnonzero((own >= start) & (own < start + len(s)))
                    s[own[mine].astype(np.int64) - start, mine] = -np.inf
                qi, ci = tile_topk(s, k)
                out.append((qi + start, ci, s[qi, ci]))
        qi, ci, s = (np.concatenate(x) for x in zip(*out, strict=True))
        first = np.diff(qi, prepend=-1) > 0  # a visit's work stands on its first row
        return pa.table({"query_id": query_ids.take(pa.array(qi)), "doc_id": ids.take(pa.array(ci)), "score": s, "products": np.where(first, len(ids), 0)})

    return score


def knn_pruned(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    *,
    exclude_self: bool = False,
    expert: str | None = "dense",
    centres: int = 64,
    cell_rows: int = CELL_ROWS,
    report: bool = False,
):
    """As :func:`knn`, exact, without comparing every query with every vector.

    Every vector goes to the cell of its nearest centre; a cell's radius is its largest angle. A query
    first visits the cells, in order of their bound, that together hold k vectors; its k-th score
    there is what other cells must be able to reach: by the triangle inequality no vector of a cell has a
    larger product than cos(angle to the centre - radius). Cells and their visitors are split into parts of ``cell_rows``, so
    a cell may hold any share of the rows. ``centres`` vectors (a parameter) are sent to every task.

    With ``report``, returns ``(run, work)``, ``work`` one row: ``visits`` and ``products`` against ``all_products``.
    """
    q, c, schema = _inputs(queries, corpus)
    c, q = materialize(c), materialize(q)
    spark, kinds = c.sparkSession, schema.removesuffix(", score double")
    mid = choose_centres(c, centres)
    if not len(mid):
        empty = spark.createDataFrame([], schema)
        work = spark.createDataFrame([(0, 0, 0)], "visits long, products long, all_products long")
        return (_run(empty, k, expert), work) if report else _run(empty, k, expert)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                angles = _angles(unit_rows(part.column("vec")), mid)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=["doc_id", "vec", "cell", "angle"])

    vec = c.schema["vec"].dataType.simpleString()
    placed = materialize(c.mapInArrow(assign, f"doc_id {kinds.split('doc_id ')[1]}, vec {vec}, cell int, angle double"))
    cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row per centre
    known = np.array(sorted(cells))
    counts, radii = np.array([cells[i][0] for i in known]), np.array([cells[i][1] for i in known])
    mid, total = mid[known], int(counts.sum())
    need = k + int(exclude_self)

    def visits(first: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    part = batch.slice(at, TILE)
                    low = np.maximum(_angles(unit_rows(part.column("vec")), mid) - radii - SLACK, 0.0)
                    order = np.argsort(low, axis=1, kind="stable")
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    early = np.zeros(low.shape, bool)
                    np.put_along_axis(early, order, before < need, axis=1)  # the cells that hold k vectors
                    if first:
                        go = early
                    else:
                        kth = part.column("kth").to_numpy(zero_copy_only=False)
                        reach = np.where(np.isfinite(kth), np.arccos(np.clip(kth - 2 * 10.0**-RANK_DIGITS, -1.0, 1.0)) + SLACK, np.inf)
                        go = ~early & (low <= reach[:, None])
                    row, cell = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), part.column("vec").take(pa.array(row)), pa.array(known[cell].astype(np.int32))], names=["query_id", "vec", "cell"])

        return run

    parts = F.create_map(*[F.lit(int(x)) for i, n in zip(known, counts, strict=True) for x in (i, -(-int(n) // cell_rows))])
    part_of = lambda key: F.pmod(F.xxhash64(key), parts[F.col("cell")]).cast("int").alias("part")
    blocks = placed.select("doc_id", "vec", "cell", part_of("doc_id"))
    qvec = q.schema["vec"].dataType.simpleString()

    def scored(asked: DataFrame, first: bool) -> DataFrame:
        rows = materialize(asked.mapInArrow(visits(first), f"{kinds.split(', doc_id')[0]}, vec {qvec}, cell int"))
        visitors = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per centre
        turns = F.create_map(*[F.lit(int(x)) for i in known for x in (i, max(1, -(-visitors.get(int(i), 0) // cell_rows)))])
        each = F.sequence(F.lit(0), parts[F.col("cell")] - 1)
        asking = rows.select("query_id", "vec", "cell", F.pmod(F.xxhash64("query_id"), turns[F.col("cell")]).cast("int").alias("turn"), F.explode(each).alias("part"))
        held = blocks.filter(F.col("cell").isin([int(i) for i in visitors])).withColumn("turn", F.explode(F.sequence(F.lit(0), turns[F.col("cell")] - 1)))
        keys = ["cell", "part", "turn"]
        return materialize(held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_cell_scores(k, exclude_self, CHUNK), f"{schema}, products long"))

    near = scored(q, True)
    kth = top_k(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = q.join(kth, "query_id", "left")
    far = scored(rest, False)
    both = near.unionByName(far)
    out = _run(both.drop("products"), k, expert)
    if not report:
        return out
    work = both.agg(
        F.count_if(F.col("products") > 0).alias("visits"), F.coalesce(F.sum("products"), F.lit(0)).cast("long").alias("products"),
        F.lit(total * q.count()).cast("long").alias("all_products"),
    )
    return out, work


def score_pairs(queries: DataFrame, corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inner product of normalised vectors for given ``pairs(query_id, doc_id)``; unknown ids → 0.0."""
    require(pairs, ("query_id", "doc_id"), "pairs")
    qv = queries.select("query_id", l2_normalize("embedding").alias("qv"))
    dv = corpus.select("doc_id", l2_normalize("embedding").alias("dv"))
    return (
        pairs.join(qv, "query_id", "left")
        .join(dv, "doc_id", "left")
        .select(
            *pairs.columns,
            F.coalesce(F.when(F.col("qv").isNotNull() & F.col("dv").isNotNull(), dot("qv", "dv")), F.lit(0.0)).alias(
                "score"
            ),
        )
    )
