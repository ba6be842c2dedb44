"""Text → vector encoders.

The default encoder is a signed feature-hashing of word tokens (md5 of the term picks the dimension
and the sign; counts are summed and L2-normalised), batch by batch where the texts are read. A user
encoder (e.g. a neural sentence model) can be plugged in with :func:`encode_with`, which loads it
once per task and encodes Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import term_bucket, term_sign
from ..functions.text import doc_text, token_pieces

DEFAULT_DIM = 256


#: Terms whose dimension and sign a task remembers; texts whose vectors it makes at once.
KNOWN_TERMS, TEXTS = 1 << 17, 1024


def _place(term: str, dim: int) -> int:
    """Dimension and sign of a term, as ``functions.hashing`` has them in SQL: twice the dimension, and one more if negative."""
    digest = hashlib.md5(term.encode("utf-8")).hexdigest()
    return 2 * (int(digest[:8], 16) % dim) + int(digest[8], 16) % 2


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, over all cores where these are too few to keep them busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hashed_embedding(df: DataFrame, id_col: str, text: F.Column, dim: int = DEFAULT_DIM, out_id: str | None = None) -> DataFrame:
    """``(id, embedding array<double>)``: dense, L2-normalised hashed vector of each row's text.

    Nothing is shuffled: a task adds up the pieces of its texts, ``TEXTS`` vectors at a time, and looks
    most terms up once. A batch holds pieces of bounded length, so a task's memory doesn't follow from the
    length of its texts. Rows without any token get a zero vector.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def vectors(ids, sums):
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        sums /= np.where(norm > 0, norm, 1.0)
        offsets = pa.array(np.arange(len(sums) + 1) * dim, pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=[id_col, "embedding"])

    def encode(batches):
        codes = list(range(2 * dim))  # one object for each code, however many terms have it
        known: dict[str, int] = {}
        open_id, open_sums = None, np.zeros((0, dim))  # the last text so far, which may go on
        for batch in batches:
            begins = np.flatnonzero(batch.column("piece").to_numpy() == 0)
            # pieces before the first beginning go on with the open text, in the first round
            cuts = np.unique([0, *begins[TEXTS::TEXTS].tolist(), batch.num_rows])
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(s, e - s)
                first = part.column("piece").to_numpy() == 0
                texts = part.filter(pa.array(first)).column("id")
                held = len(open_sums)
                pieces = part.column("tokens")
                coded = pc.list_flatten(pieces).dictionary_encode()
                if len(known) > KNOWN_TERMS:
                    known.clear()
                places = np.fromiter((known[t] if t in known else known.setdefault(t, codes[_place(t, dim)]) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                n = held + len(texts)
                row = np.repeat(np.cumsum(first) - 1 + held, pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
                place = places[coded.indices.to_numpy(zero_copy_only=False)]
                sums = np.bincount(row * dim + (place >> 1), 1.0 - 2.0 * (place & 1), n * dim).astype(np.float64, copy=False).reshape(n, dim)
                sums[:held] += open_sums
                ids = pa.concat_arrays([open_id, texts]) if held else texts
                if n > 1:
                    yield vectors(ids.slice(0, n - 1), sums[:-1])
                open_id, open_sums = ids.take(pa.array([n - 1])), sums[n - 1 :].copy()
        if len(open_sums):
            yield vectors(open_id, open_sums)

    pieces = df.select(F.col(id_col).alias("id"), F.posexplode(token_pieces(F.coalesce(text, F.lit("")))).alias("piece", "tokens"))
    out = pieces.mapInArrow(encode, f"`{id_col}` {kind}, embedding array<double>")
    return out.withColumnRenamed(id_col, out_id) if out_id else out


def hashed_terms(df: DataFrame, id_col: str, text: F.Column, dim: int = DEFAULT_DIM) -> DataFrame:
    """Long form ``(id, dim, value)`` of the normalised hashed vector; zero entries are omitted."""
    long = hashed_embedding(df, id_col, text, dim, "id").select("id", F.posexplode("embedding").alias("dim", "value"))
    return long.filter(F.col("value") != 0)


def embed_postings(postings: DataFrame, terms: DataFrame, doc_ids: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """``(doc_id, embedding)`` from an existing BM25 index instead of re-tokenising the corpus.

    Each distinct term is hashed once and
    weighted by its term frequency: Σ over tokens of sign = Σ over terms of sign·tf, so the vectors
    equal :func:`embed_corpus`'s. ``doc_ids`` supplies documents without any token (zero vectors).
    """
    vocab = terms.select("term", term_bucket("term", dim).alias("dim"), term_sign("term").alias("sign"))
    raw = (
        postings.select("term", "doc_id", "tf")
        .join(vocab, "term")
        .groupBy("doc_id", "dim")
        .agg(F.sum(F.col("sign") * F.col("tf")).alias("value"))
    )
    return _assemble(raw.withColumnRenamed("doc_id", "id"), doc_ids.select(F.col("doc_id").alias("id")), dim).withColumnRenamed(
        "id", "doc_id"
    )


def _assemble(raw: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """Dense normalised arrays from ``(id, dim, value)`` sums; ids without entries get zero vectors."""
    per_id = raw.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))
        / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)),
    )
    return ids.join(per_id, "id", "left").select(
        "id",
        F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(dense).alias("embedding"),
    )


def embed_corpus(corpus: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """``(doc_id, embedding)`` of ``title + " " + text``."""
    title = F.col("title") if "title" in corpus.columns else None
    return hashed_embedding(corpus.select("doc_id", doc_text(title, F.col("text")).alias("_t")), "doc_id", F.col("_t"), dim)


def embed_queries(queries: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """``(query_id, embedding)`` of the query text."""
    return hashed_embedding(queries, "query_id", F.col("text"), dim)


def encode_with(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    out_col: str = "embedding",
) -> DataFrame:
    """Encode ``text_col`` with a user model: ``make_encoder()`` runs once per task and returns a
    function from a list of texts to a ``(n, d)`` array. Batches travel as Arrow."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for b in batches:
            vecs = np.asarray(encode(b[text_col].fillna("").tolist()), dtype=np.float32)
            yield pd.DataFrame({id_col: b[id_col], out_col: list(vecs)})

    return df.select(id_col, text_col).mapInPandas(run, schema)
