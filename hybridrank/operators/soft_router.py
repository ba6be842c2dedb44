"""The hidden-layer router fitted on soft labels: features, hidden ReLU layers, softmax over the experts.

The loss is the mean KL divergence between the labels and the predicted weights, plus an L2 penalty on the
weights. Loss and gradient are sums over Arrow batches of the training table, added up in a tree of groups;
a quasi-Newton loop on the driver takes one such sum per step and holds nothing but the parameters.
Training stops once the validation loss has not fallen for ``patience`` steps, and keeps the best step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require

# The sizes of the hidden layers.
HIDDEN = (128, 64)
PARTIAL = "loss double, n long, val_loss double, val_n long, gradient array<double>"


@dataclass
class SoftRouter:
    """Weights ``(inputs x outputs)`` and biases of each layer."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    history: list[dict] = field(default_factory=list)

    @property
    def numClasses(self) -> int:  # noqa: N802 - as the fitted models of Spark ML name it
        return len(self.biases[-1])

    @property
    def sizes(self) -> list[int]:
        return [len(self.weights[0]), *(len(b) for b in self.biases)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for pair in zip(self.weights, self.biases, strict=True) for x in pair])


def initial(sizes: Sequence[int], seed: int = 42) -> SoftRouter:
    """Weights drawn evenly from +-sqrt(6 / (inputs + outputs)), biases zero."""
    rng = np.random.default_rng(seed)
    ends = [math.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    return SoftRouter([rng.uniform(-e, e, (a, b)) for e, a, b in zip(ends, sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]])


def unflat(x: np.ndarray, sizes: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    weights, biases, at = [], [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        weights.append(x[at : at + a * b].reshape(a, b))
        biases.append(x[at + a * b : at + a * b + b])
        at += a * b + b
    return weights, biases


def forward(weights, biases, x: np.ndarray) -> list[np.ndarray]:
    """The layers' outputs; the last are log-weights of the experts."""
    out = [x]
    for w, b in zip(weights[:-1], biases[:-1], strict=True):
        out.append(np.maximum(out[-1] @ w + b, 0.0))
    logits = out[-1] @ weights[-1] + biases[-1]
    top = logits.max(axis=1, keepdims=True)
    return [*out, logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))]


def _kl(target: np.ndarray, log_q: np.ndarray) -> np.ndarray:
    return (target * (np.log(np.where(target > 0, target, 1.0)) - log_q)).sum(axis=1)


def gradient(weights, biases, x: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed KL divergence and its gradient, in the order of ``SoftRouter.flat``."""
    outs = forward(weights, biases, x)
    delta = np.exp(outs[-1]) * target.sum(axis=1, keepdims=True) - target
    parts = []
    for i in range(len(weights) - 1, -1, -1):
        parts = [(outs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        delta = (delta @ weights[i].T) * (outs[i] > 0) if i else delta
    return float(_kl(target, outs[-1]).sum()), np.concatenate(parts)


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sums(data: DataFrame, x: np.ndarray, sizes: Sequence[int]) -> tuple[float, int, float, int, np.ndarray]:
    """Training loss, rows and gradient, and validation loss and rows, over ``data(features, target, held)``.

    A task sums its batches; tasks' sums are added in groups, and the driver adds the groups' rows: as
    many as the square root of the tasks.
    """
    sent = data.sparkSession.sparkContext.broadcast(x)
    sizes, groups = list(sizes), max(1, math.isqrt(data.rdd.getNumPartitions()))

    def partial(batches):
        weights, biases = unflat(sent.value, sizes)
        loss = val = n = val_n = 0
        total = np.zeros(len(sent.value))
        for batch in batches:
            features, target, held = _rows(batch.column("features")), _rows(batch.column("target")), batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            if not held.all():
                own, g = gradient(weights, biases, features[~held], target[~held])
                loss, n, total = loss + own, n + int((~held).sum()), total + g
            if held.any():
                val, val_n = val + float(_kl(target[held], forward(weights, biases, features[held])[-1]).sum()), val_n + int(held.sum())
        yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([n]), pa.array([float(val)]), pa.array([val_n]), pa.array([total])], names=["loss", "n", "val_loss", "val_n", "gradient"])

    def added(table: pa.Table) -> pa.Table:
        one = {c: [table.column(c).to_numpy().sum()] for c in ("loss", "n", "val_loss", "val_n")}
        return pa.table({**one, "gradient": pa.array([_rows(table.column("gradient")).sum(axis=0)])})

    rows = data.select("features", "target", "held").mapInArrow(partial, PARTIAL)
    rows = rows.groupBy((F.spark_partition_id() % groups).alias("g")).applyInArrow(lambda t: added(t.drop_columns(["g"]) if "g" in t.column_names else t), PARTIAL).collect()
    return sum(r.loss for r in rows), sum(r.n for r in rows), sum(r.val_loss for r in rows), sum(r.val_n for r in rows), np.sum([r.gradient for r in rows], axis=0)


def training_table(df: DataFrame, experts: Sequence[str], norm: str, held: bool, features: str = "features") -> DataFrame:
    cols = [f"{e}_{norm}" for e in experts]
    require(df, ["query_id", features, *cols], "training table")
    return df.select(F.col(features).alias("features"), F.array(*[F.col(c).cast("double") for c in cols]).alias("target"), F.lit(held).alias("held"))


class _Directions:
    """Two-loop recursion over the last steps of a quasi-Newton search."""

    def __init__(self, memory: int) -> None:
        self.memory, self.pairs = memory, []

    def seen(self, step: np.ndarray, change: np.ndarray) -> None:
        if step @ change > 1e-12:
            self.pairs = [*self.pairs, (step, change)][-self.memory :]

    def down(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def fit(
    train: DataFrame,
    validation: DataFrame,
    experts: Sequence[str] = ("sparse", "dense"),
    norm: str = "l1",
    hidden: Sequence[int] = HIDDEN,
    reg_param: float = 1e-4,
    max_iter: int = 50,
    patience: int = 5,
    seed: int = 42,
    memory: int = 10,
    start: SoftRouter | None = None,
) -> SoftRouter:
    """Fit on ``train`` until ``validation`` has not improved for ``patience`` steps.

    Both have ``query_id, features, {e}_{norm}...``; write them once before, they are read at every step.
    The router returned is that of the best validation loss; ``history`` has a row per step:
    ``step, train_loss, val_loss``. ``start`` continues from given weights.
    """
    from ..session import materialize

    data = materialize(training_table(train, experts, norm, False).unionByName(training_table(validation, experts, norm, True)))
    first = data.first()
    if first is None:
        raise ValueError("nothing to train on")
    sizes = start.sizes if start else [len(first.features), *hidden, len(experts)]
    x = (start or initial(sizes, seed)).flat()
    weight = np.concatenate([y for a, b in zip(sizes, sizes[1:], strict=False) for y in (np.ones(a * b), np.zeros(b))])

    def at(x):
        loss, n, val, val_n, g = sums(data, x, sizes)
        penalised = loss / max(n, 1) + 0.5 * reg_param * float((weight * x * x).sum())
        return penalised, loss / max(n, 1), val / val_n if val_n else loss / max(n, 1), g / max(n, 1) + reg_param * weight * x

    value, train_loss, val_loss, g = at(x)
    history = [{"step": 0, "train_loss": train_loss, "val_loss": val_loss}]
    best, best_x, since, search = val_loss, x, 0, _Directions(memory)
    for step in range(1, max_iter + 1):
        direction = search.down(g)
        slope = float(g @ direction)
        if slope > -1e-12:
            break
        length = 1.0 if search.pairs else min(1.0, 1.0 / float(np.abs(g).sum()))
        for _ in range(20):  # until the value falls enough
            new = x + length * direction
            found = at(new)
            if found[0] <= value + 1e-4 * length * slope:
                break
            length *= 0.5
        else:
            break
        search.seen(new - x, found[3] - g)
        x, (value, train_loss, val_loss, g) = new, found
        history.append({"step": step, "train_loss": train_loss, "val_loss": val_loss})
        if val_loss < best:
            best, best_x, since = val_loss, x, 0
        else:
            since += 1
            if since >= patience:
                break
    return SoftRouter(*unflat(best_x, sizes), history)


def predict(model: SoftRouter, df: DataFrame, experts: Sequence[str], features: str = "features") -> DataFrame:
    """Long ``(query_id, expert, weight)``; weights of a query sum to 1."""
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.biases))
    kind = df.schema["query_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            q = np.exp(forward(*sent.value, _rows(batch.column("features")))[-1]) if batch.num_rows else np.zeros((0, len(experts)))
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(experts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.ListArray.from_arrays(offsets, pa.array(q.ravel()))], names=["query_id", "w"])

    wide = df.select("query_id", F.col(features).alias("features")).mapInArrow(run, f"query_id {kind}, w array<double>")
    names = F.array(*[F.lit(e) for e in experts])
    return wide.select("query_id", F.posexplode("w").alias("pos", "weight")).select("query_id", F.get(names, F.col("pos")).alias("expert"), "weight")
