"""Query router: predicts per-query expert weights from query features.

Training target is a distribution over experts (soft labels). A multinomial logistic regression
fitted with every query repeated once per expert (label = expert position, instance weight =
target probability) minimises Σ_q Σ_e p_qe · (−log q_e), i.e. the KL divergence to the soft labels
up to a constant — the reference's loss, solved by Spark ML's distributed L-BFGS instead of
mini-batch SGD. Predicted weights are the softmax of the logits (the model's probabilities).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import require
from . import soft_router

# numpy.isclose defaults (fixed values)
RTOL = 1e-5
ATOL = 1e-8


def label_columns(experts: Sequence[str], norm: str) -> list[str]:
    return [f"{e}_{norm}" for e in experts]


def training_rows(df: DataFrame, experts: Sequence[str], norm: str = "l1", features: str = "features") -> DataFrame:
    """``(query_id, features VECTOR, label DOUBLE, weight DOUBLE)``: one row per query and expert."""
    cols = label_columns(experts, norm)
    require(df, ["query_id", features, *cols], "training table")
    probs = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(
        "query_id", array_to_vector(F.col(features)).alias("features"), F.posexplode(probs).alias("label", "weight")
    ).filter(F.col("weight") > 0).select(
        "query_id", "features", F.col("label").cast("double").alias("label", metadata=_classes(len(experts))), "weight"
    )


def _classes(n: int) -> dict:
    """Label metadata that names ``n`` classes, so that an expert nobody prefers keeps its output."""
    return {"ml_attr": {"type": "nominal", "name": "label", "vals": [str(float(i)) for i in range(n)]}}


def fit(
    df: DataFrame,
    experts: Sequence[str] = ("sparse", "dense"),
    norm: str = "l1",
    reg_param: float = 1e-4,
    max_iter: int = 100,
    features: str = "features",
) -> LogisticRegressionModel:
    """Fit the router on ``df(query_id, features array<double>, {e}_{norm}...)``."""
    rows = training_rows(df, experts, norm, features)
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        regParam=reg_param,
        elasticNetParam=0.0,
        maxIter=max_iter,
    )
    return lr.fit(rows)


def from_coefficients(spark, coefficients: Sequence[Sequence[float]], intercepts: Sequence[float]) -> LogisticRegressionModel:
    """A router with given coefficients (a row per expert) and intercepts."""
    from pyspark.ml.linalg import DenseMatrix, Vectors
    from pyspark.ml.wrapper import JavaWrapper

    flat = [float(x) for row in coefficients for x in row]
    matrix = DenseMatrix(len(coefficients), len(coefficients[0]), flat, isTransposed=True)
    make = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    uid = spark.sparkContext._jvm.org.apache.spark.ml.util.Identifiable.randomUID("router")
    args = [JavaWrapper._new_java_obj("org.apache.spark.ml.linalg.DenseMatrix", matrix.numRows, matrix.numCols, _doubles(spark, matrix.values), True)]
    vector = JavaWrapper._new_java_obj("org.apache.spark.ml.linalg.DenseVector", _doubles(spark, Vectors.dense(intercepts).values))
    return LogisticRegressionModel(make(uid, args[0], vector, len(coefficients), True)).setFeaturesCol("features")


def _doubles(spark, values):
    sc = spark.sparkContext
    out = sc._gateway.new_array(sc._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def fit_mlp(
    df: DataFrame,
    experts: Sequence[str] = ("sparse", "dense"),
    norm: str = "l1",
    hidden: Sequence[int] = (128, 64),
    max_iter: int = 100,
    seed: int = 42,
    features: str = "features",
):
    """Optional hidden-layer router (d → 128 → 64 → experts). Spark's perceptron has no instance
    weights, so it learns the hard winner (argmax of the soft label, first on ties) instead."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    cols = label_columns(experts, norm)
    rows = df.select(
        array_to_vector(F.col(features)).alias("features"),
        argmax(F.array(*[F.col(c).cast("double") for c in cols])).cast("double").alias("label"),
    )
    dim = len(df.select(features).first()[0])  # feature width (one row)
    mlp = MultilayerPerceptronClassifier(layers=[dim, *hidden, len(experts)], maxIter=max_iter, seed=seed)
    return mlp.fit(rows)


def predict(model: LogisticRegressionModel, df: DataFrame, experts: Sequence[str], features: str = "features") -> DataFrame:
    """Long ``(query_id, expert, weight)``; weights of a query sum to 1."""
    if model.numClasses != len(experts):
        raise ValueError(f"the router has {model.numClasses} outputs for {len(experts)} experts")
    if isinstance(model, soft_router.SoftRouter):
        return soft_router.predict(model, df, experts, features)
    names = F.array(*[F.lit(e) for e in experts])
    scored = model.transform(df.select("query_id", array_to_vector(F.col(features)).alias("features")))
    return scored.select("query_id", F.posexplode(vector_to_array("probability")).alias("pos", "weight")).select(
        "query_id", F.element_at(names, F.col("pos") + 1).alias("expert"), "weight"
    )


def wide_weights(weights: DataFrame, experts: Sequence[str]) -> DataFrame:
    """``(query_id, w array<double>)`` in expert order."""
    return weights.groupBy("query_id").agg(
        F.array(*[F.first(F.when(F.col("expert") == e, F.col("weight")), ignorenulls=True) for e in experts]).alias("w")
    )


def argmax(arr: Column) -> Column:
    """0-based position of the largest element; the first one wins a tie."""
    return F.array_position(arr, F.array_max(arr)) - 1


def isclose(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(b)


def kl(p: Column, q: Column) -> Column:
    """Σ p·(ln p − ln q) over aligned arrays, terms with p = 0 contributing 0."""
    return F.aggregate(
        F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(y))).otherwise(F.lit(0.0))),
        F.lit(0.0),
        lambda s, t: s + t,
    )


def evaluate(
    predicted: DataFrame, labels: DataFrame, experts: Sequence[str] = ("sparse", "dense"), norm: str = "l1"
) -> DataFrame:
    """Per query: true and predicted weights, classes, tie flag, correctness and KL divergence.

    A query whose true labels tie (numpy ``isclose`` of the first two experts; for more experts,
    of the top label with any other) is excluded from accuracy.
    """
    cols = label_columns(experts, norm)
    truth = labels.select("query_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("t"))
    both = truth.join(wide_weights(predicted, experts), "query_id")
    if len(experts) == 2:
        tie = isclose(F.col("t")[0], F.col("t")[1])
    else:
        top = F.array_max("t")
        tie = F.size(F.filter("t", lambda x: isclose(x, top))) > 1
    return both.select(
        "query_id",
        *[F.col("t")[i].alias(f"true_{e}") for i, e in enumerate(experts)],
        *[F.col("w")[i].alias(f"pred_{e}") for i, e in enumerate(experts)],
        argmax(F.col("t")).alias("true_class"),
        argmax(F.col("w")).alias("pred_class"),
        tie.alias("tie"),
        kl(F.col("t"), F.col("w")).alias("kl"),
    ).withColumn("correct", F.when(~F.col("tie"), F.col("true_class") == F.col("pred_class")))


def accuracy(evaluated: DataFrame) -> DataFrame:
    """One row: ``accuracy`` (correct / non-tied, 0.0 if none), ``n_eval``, ``n_ties``, ``mean_kl``."""
    return evaluated.agg(
        F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.count("correct").alias("n_eval"),
        F.sum(F.col("tie").cast("int")).alias("n_ties"),
        F.avg("kl").alias("mean_kl"),
    )


def select_model(
    train: DataFrame,
    validation: DataFrame,
    experts: Sequence[str] = ("sparse", "dense"),
    norm: str = "l1",
    reg_params: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1),
    max_iter: int = 100,
    patience: int = 2,
    hidden: Sequence[int] | None = None,
):
    """``(model, history)``: the model of the lowest validation KL along a path of penalties, strongest first.

    The path ends when ``patience`` penalties in a row have not improved the loss. ``history`` has a row
    per penalty tried: ``reg_param, val_loss``; with ``hidden`` layers (which start from the model before)
    also its ``steps``.
    """
    best, best_loss, since, history, last = None, float("inf"), 0, [], None
    for rp in sorted(reg_params, reverse=True):
        if hidden:
            m = last = soft_router.fit(train, validation, experts, norm, hidden, rp, max_iter, start=last)
        else:
            m = fit(train, experts, norm, rp, max_iter)
        ev = evaluate(predict(m, validation, experts), validation, experts, norm)
        loss = ev.agg(F.avg("kl")).first()[0]
        loss = float("inf") if loss is None else loss
        history.append({"reg_param": rp, "val_loss": loss, **({"steps": m.history} if hidden else {})})
        if best is None or loss < best_loss:
            best, best_loss, since = m, loss, 0
        else:
            since += 1
            if since >= patience:
                break
    return best, history
