"""Quality scores by votes of the nearest labelled documents.

Terms of a document: its byte pairs and the shapes of its words (classes of the first two and the last
byte; whether the word repeats the one before it), hashed into a fixed number of columns. The columns'
main directions over labelled documents (latent semantic analysis) turn a document into a short vector.
A document's score is the share of label 1 among its nearest labelled vectors, weighted by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, whole_rows
from .kernels import PrefixHash, blocks, byte_codes, is_word_byte, powers, runs_of

#: Columns for byte pairs and for word shapes; weight of the latter.
PAIRS, SHAPES, SHAPE_WEIGHT = 2048, 256, 2.0
FEATURES = PAIRS + SHAPES
#: Places to which cosines are compared: single floats of one value may differ beyond.
COSINE_DIGITS = 6


@dataclass(frozen=True)
class Model:
    """``axes``: features x dimensions; ``vectors``: labelled documents x dimensions, of length 1."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float


def _classes() -> np.ndarray:
    table = np.full(256, 4, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[128:] = 3
    return table


class Features:
    """Rows of features of many texts, each text read in whole."""

    def __init__(self) -> None:
        self.word, self.classes, self.codes = is_word_byte(), _classes(), byte_codes()
        self.up, self.down = powers(1 << 20)

    def of(self, texts: pa.Array):
        """First row and a block of feature rows, again and again."""
        for row, data, offsets in blocks(texts):
            n = len(offsets) - 1
            if len(data) >= len(self.up):
                self.up, self.down = powers(2 * len(data))
            with np.errstate(over="ignore"):
                yield row, np.hstack([self._pairs(data, offsets, n), SHAPE_WEIGHT * self._shapes(data, offsets, n)])

    @staticmethod
    def _unit(owner: np.ndarray, column: np.ndarray, n: int, width: int) -> np.ndarray:
        """Square roots of the columns' shares, so that every row with any term has length 1."""
        out = np.sqrt(np.bincount(owner * width + column, minlength=n * width).reshape(n, width).astype(np.float32))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _pairs(self, data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        owner = np.repeat(np.arange(n), np.diff(offsets))
        code = ((data[:-1].astype(np.uint32) << np.uint32(8)) | data[1:]) * np.uint32(2654435761) >> np.uint32(21)
        same = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
        return self._unit(owner[:-1][same], code[same].astype(np.int64), n, PAIRS)

    def _shapes(self, data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        starts, ends = runs_of(self.word[data], offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        hashes = PrefixHash(data, self.codes, self.up, self.down).of(starts, ends)
        again = np.zeros(len(starts), np.int64)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        of = lambda at: self.classes[data[at]]
        return self._unit(owner, again + 2 * (of(starts) + 5 * (of(ends - 1) + 5 * of(np.minimum(starts + 1, ends - 1)))), n, SHAPES)


def _rows(texts: pa.Array) -> np.ndarray:
    kernel = Features()
    return np.vstack([np.zeros((0, FEATURES), np.float32), *(f for _, f in kernel.of(texts))])


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _axes(x: np.ndarray, dimensions: int, spare: int = 32, rounds: int = 40, block: int = 512) -> np.ndarray:
    """The main directions of the rows of ``x``, by subspace iteration over their products, a block at a time.

    Like the directions of a full decomposition but for those of nearly equal weight at the end, without its memory.
    """
    products = np.zeros((x.shape[1], x.shape[1]), np.float32)
    for k in range(0, len(x), block):
        part = x[k : k + block].astype(np.float32)
        products += part.T @ part
    basis = np.random.default_rng(0).standard_normal((x.shape[1], dimensions + spare), np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(products @ basis)
    _, turn = np.linalg.eigh(basis.T @ products @ basis)
    return np.ascontiguousarray(basis @ turn[:, ::-1][:, :dimensions], np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2048, dimensions: int = 64, neighbours: int = 16, power: float = 8.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from labelled documents: at most ``per_label`` of each label 0 and 1, those whose ids have the least hashes.

    That documented bound holds for all that is broadcast or gathered here. Labels other than 0 and 1,
    null labels and ids are left out; a null text counts as empty; an id that ``labels`` repeats counts
    once, with its largest label, and an id that ``docs`` repeats once, with the text of the least hash.
    Without any labelled document of label 0 or of label 1 every score is 1 or 0, without both 0.5.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_label) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_label rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("id", "label", "least.text")

    def features(batches):
        for batch in batches:
            rows = _rows(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.astype("<f2").tobytes() for r in rows], pa.binary())], names=["id", "label", "features"])

    got = texts.mapInArrow(features, "id long, label int, features binary").toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    x = np.array([np.frombuffer(r.as_buffer(), "<f2") for r in got["features"]], "<f2").reshape(len(got), FEATURES)
    known = got["label"].to_numpy().astype(np.float32)
    del got
    axes = _axes(x, dimensions)
    vectors = [x[k : k + 512].astype(np.float32) @ axes for k in range(0, len(x), 512)]
    return Model(axes, _unit_rows(np.vstack([np.zeros((0, dimensions), np.float32), *vectors])), known, neighbours, power)


def vote(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by a power of the cosine.

    Cosines are compared to six places; of equal ones at the edge, those that come first are taken.
    """
    if not len(model.labels):
        return np.full(len(vectors), 0.5)
    cosines = vectors @ model.vectors.T
    k = min(model.neighbours, len(model.labels))
    if k < len(model.labels):
        rounded = np.round(cosines, COSINE_DIGITS)
        edge = np.partition(rounded, -k, axis=1)[:, -k][:, None]
        tied, above = rounded == edge, rounded > edge
        near = np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))))[1].reshape(-1, k)
    else:
        near = np.tile(np.arange(k), (len(vectors), 1))
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** model.power
    return np.clip((weight * model.labels[near]).sum(1) / weight.sum(1), 0.0, 1.0)


def scorer(spark, model: Model):
    """A column function: text to score in [0, 1]. A null text counts as empty. The model's size is fixed by :func:`fit`'s bounds."""
    # plain values: workers need no copy of this package to read them
    sent = spark.sparkContext.broadcast((model.axes, model.vectors, model.labels, model.neighbours, model.power))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        kernel, own, out = Features(), Model(*sent.value), np.zeros(len(texts))
        for row, x in kernel.of(texts):
            out[row : row + len(x)] = vote(own, _unit_rows(x @ own.axes))
        return pa.array(out)

    return lambda column: score(F.coalesce(column.cast("string"), F.lit("")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == 0


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    The model learns from labels of rows that are not held out. An empty text gets the vote of the
    nearest to nothing (all cosines alike), repeated rows equal scores; an empty table gives no rows.
    Other columns are not read.
    """
    model = fit(docs, labels.filter(~held_out(F.col(id_col), folds)), id_col=id_col, text_col=text_col, label_col=label_col, **settings)
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings) -> DataFrame:
    """``docs`` without rows scored below ``threshold``, all columns as they are."""
    model = fit(docs, labels.filter(~held_out(F.col(id_col), folds)), id_col=id_col, text_col=text_col, label_col=label_col, **settings)
    marked = docs.select(whole_rows(docs), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return marked.filter(F.col("score") >= threshold).select("row.*")
