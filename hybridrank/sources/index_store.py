"""Persistence of indices and routers as Parquet / Spark ML folders, and the build-or-load policy."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..operators import sparse
from ..operators.soft_router import SoftRouter
from ..operators.sparse import BM25Params, CorpusStats, SparseIndex
from .paths import delete, folders, path_exists


def _exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a completed Spark write (``_SUCCESS`` marker)."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


class IndexMismatch(ValueError):
    """A stored index belongs to another corpus or other BM25 constants."""


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, dict]]:
    """Completed versions of a stored index, oldest first: when, folder, manifest."""
    out = []
    for folder in folders(spark, f"{path.rstrip('/')}/versions"):
        if _exists(spark, f"{folder}/manifest"):
            manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
            out.append((manifest["created"], folder, manifest))
    return sorted(out, key=lambda v: v[:2])


def save_sparse_index(corpus: DataFrame, path: str, params: BM25Params = BM25Params()) -> SparseIndex:
    """Build an index of ``corpus`` as a new version under ``path`` and open it.

    The version's manifest is written last and is what makes it count: a build that is interrupted, or
    runs beside another, leaves the earlier version as it is. Of several the newest is read.
    """
    spark = corpus.sparkSession
    folder = f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"
    constants = sparse.write_index(corpus, folder)
    manifest = {"created": time.time_ns(), "constants": asdict(constants), "params": asdict(params)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return sparse.open_index(spark, folder, constants, params)


def load_sparse_index(spark: SparkSession, path: str) -> SparseIndex:
    """The newest completed version under ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} holds no completed index")
    _, folder, manifest = versions[-1]
    return sparse.open_index(spark, folder, CorpusStats(**manifest["constants"]), BM25Params(**manifest["params"]))


def sparse_index(corpus: DataFrame, path: str | None = None, force: bool = False, save: bool = True,
                 params: BM25Params = BM25Params(), verify: bool = True) -> SparseIndex:
    """Build-or-load: reuse a stored index at ``path`` unless ``force``; otherwise build (and save).

    A stored index of other BM25 constants raises, and so does one of another corpus: its fingerprint is
    compared, one scan of the corpus without a shuffle. ``verify=False`` leaves that scan out.
    """
    spark = corpus.sparkSession
    if path and not force and _versions(spark, path):
        index = load_sparse_index(spark, path)
        if index.params != params:
            raise IndexMismatch(f"the index at {path} has {index.params}, not {params}")
        if verify and sparse.fingerprint(corpus)[1] != index.constants.fingerprint:
            raise IndexMismatch(f"the index at {path} is of another corpus")
        return index
    return save_sparse_index(corpus, path, params) if path and save else sparse.build_index(corpus, params)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions but the newest completed one (nobody may be reading or writing them); how many."""
    versions = _versions(spark, path)
    old = [f for f in folders(spark, f"{path.rstrip('/')}/versions") if versions and f != versions[-1][1]]
    for folder in old:
        delete(spark, folder)
    return len(old)


def save_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Dense index: the (id, embedding) table as Parquet."""
    vectors.write.mode(mode).parquet(path)


def dense_vectors(vectors: DataFrame, path: str | None = None, force: bool = False, save: bool = True) -> DataFrame:
    """Build-or-load of a vector table."""
    spark = vectors.sparkSession
    if path and not force and _exists(spark, path):
        return spark.read.parquet(path)
    if path and save:
        save_vectors(vectors, path, mode="overwrite" if force else "errorifexists")
        return spark.read.parquet(path)
    return vectors


def save_router(model, folder: str, norm: str) -> str:
    """Save under ``{folder}/router_{norm}`` (the label normalisation is part of the name)."""
    path = f"{folder.rstrip('/')}/router_{norm}"
    if isinstance(model, SoftRouter):
        spark = SparkSession.getActiveSession()
        layers = [(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(zip(model.weights, model.biases, strict=True))]
        spark.createDataFrame(layers, LAYERS).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
    return path


LAYERS = "layer int, weights array<array<double>>, biases array<double>"


def load_router(folder: str, norm: str):
    """The saved router: a logistic regression or perceptron, whichever its metadata name, or one of hidden layers."""
    spark, path = SparkSession.getActiveSession(), f"{folder.rstrip('/')}/router_{norm}"
    if not path_exists(spark, f"{path}/metadata"):
        rows = spark.read.schema(LAYERS).parquet(path).orderBy("layer").collect()  # a row per layer
        return SoftRouter([np.array(r.weights) for r in rows], [np.array(r.biases) for r in rows])
    kind = DefaultParamsReader.loadMetadata(path, spark)["class"].rsplit(".", 1)[1]
    kinds = {k.__name__: k for k in (LogisticRegressionModel, MultilayerPerceptronClassificationModel)}
    if kind not in kinds:
        raise ValueError(f"{path} holds a {kind}, not a router")
    return kinds[kind].load(path)
