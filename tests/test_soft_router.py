"""The hidden-layer router on soft labels, its selection and its store; positions and column types."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.operators import prepare, ranking, router, soft_router
from hybridrank.schemas import require
from hybridrank.sources import index_store, readers, writers

SCHEMA = "query_id long, features array<double>, sparse_l1 double, dense_l1 double"


def crossed(n, seed):
    """Soft labels that no linear router can learn: they depend on whether two features agree."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    p = np.where(x[:, 0] * x[:, 1] > 0, 0.9, 0.2)
    return [(i, [float(a), float(b)], float(q), float(1 - q)) for i, ((a, b), q) in enumerate(zip(x, p, strict=True))]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    model = soft_router.initial([3, 5, 4, 2], 7)
    model.biases = [rng.normal(size=len(b)) for b in model.biases]  # away from the kinks at 0
    x, t = rng.normal(size=(20, 3)), rng.dirichlet([1, 1], 20)
    t[0] = [1.0, 0.0]
    flat = model.flat()
    loss, g = soft_router.gradient(model.weights, model.biases, x, t)
    for i in rng.choice(len(flat), 15, replace=False):
        up, down = (soft_router.gradient(*soft_router.unflat(flat + s * 1e-6 * (np.arange(len(flat)) == i), model.sizes), x, t)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    assert loss > 0


@pytest.fixture(scope="module")
def fitted(spark):
    train, val = (spark.createDataFrame(crossed(n, s), SCHEMA).repartition(3) for n, s in ((300, 1), (80, 2)))
    return soft_router.fit(train, val, hidden=(12,), max_iter=40, patience=4, reg_param=1e-4), val


def test_learns_what_a_linear_router_cannot(spark, fitted):
    model, val = fitted
    losses = [h["val_loss"] for h in model.history]
    kl = router.evaluate(router.predict(model, val, ["sparse", "dense"]), val).agg(F.avg("kl")).first()[0]
    assert kl == pytest.approx(min(losses)) and kl < 0.12 < losses[0]
    flat = router.fit(val)
    assert kl < 0.6 * router.evaluate(router.predict(flat, val, ["sparse", "dense"]), val).agg(F.avg("kl")).first()[0]


def test_stops_when_validation_no_longer_improves(spark):
    train = spark.createDataFrame(crossed(30, 1), SCHEMA)
    noise = train.withColumns({"sparse_l1": F.col("dense_l1"), "dense_l1": F.col("sparse_l1")})  # the opposite
    model = soft_router.fit(train, noise, hidden=(6,), max_iter=50, patience=2)
    losses = [h["val_loss"] for h in model.history]
    best = losses.index(min(losses))
    assert len(losses) - 1 <= best + 2
    assert np.allclose(model.flat(), soft_router.initial([2, 6, 2]).flat()) == (best == 0)


def test_saved_and_loaded(spark, fitted, tmp_path):
    model, val = fitted
    index_store.save_router(model, str(tmp_path), "l1")
    again = index_store.load_router(f"file:{tmp_path}", "l1")
    assert again.sizes == [2, 12, 2] and np.array_equal(model.flat(), again.flat())
    with pytest.raises(ValueError):
        router.predict(again, val, ["one", "two", "three"])
    mlp = router.fit_mlp(val, hidden=(3,), max_iter=5)
    index_store.save_router(mlp, str(tmp_path), "softmax")
    assert index_store.load_router(str(tmp_path), "softmax").numClasses == 2


def test_path_of_penalties_stops_early(spark):
    train, val = (spark.createDataFrame(crossed(n, s), SCHEMA) for n, s in ((60, 1), (20, 2)))
    model, history = router.select_model(train, val, reg_params=(1e-3, 1e-1, 1e-2, 1e-4), max_iter=5, patience=1, hidden=(4,))
    assert [h["reg_param"] for h in history] == sorted((h["reg_param"] for h in history), reverse=True)
    losses = [h["val_loss"] for h in history]
    assert all(b < a for a, b in zip(losses[:-1], losses[1:-1], strict=False)) and all(h["steps"] for h in history)
    assert isinstance(model, soft_router.SoftRouter)


def test_validation_share_is_cut_to_a_whole_number(spark):
    for n, held in ((16, 1), (19, 1), (20, 2), (9, 0)):
        train, val = prepare.split_validation(spark.range(n).withColumnRenamed("id", "query_id"), 0.1)
        assert (train.count(), val.count()) == (n - held, held)


def test_positions(spark, tmp_path):
    df = spark.range(100, 300).select((F.col("id") * 7919 % 1009).alias("query_id"), F.lit("q").alias("query"), F.rand(1).alias("sparse"))
    ids = sorted(r.query_id for r in df.collect())
    got = ranking.with_position(df, ["query_id"]).collect()
    assert sorted((r.position, r.query_id) for r in got) == list(enumerate(ids))
    writers.write_score_table(df, str(tmp_path / "t"), positions=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert sorted(int(r.query_idx) for r in back.collect()) == list(range(200)) and "query_id" not in back.columns


def test_types_are_checked(spark):
    ok = spark.createDataFrame([(1, "x", [1.0])], "doc_id long, text string, embedding array<float>")
    require(ok, ("doc_id", "text", "embedding"))
    for bad in ("cast(1 as int) text", "'x' embedding", "array('x') embedding", "'1' relevance"):
        with pytest.raises(ValueError, match="type"):
            require(spark.range(1).selectExpr(bad), (bad.split()[-1],))


def test_files_of_unequal_size_and_repeated_judgements(spark, tmp_path):
    """The last of equal ids wins, in order of file, block and row; the last judgement of a pair too."""
    import json

    folder = tmp_path / "corpus"
    folder.mkdir()
    line = lambda i, text: json.dumps({"_id": i, "title": "", "text": text})
    (folder / "a.jsonl").write_text("\n".join([line("x", "first"), line("y", "only")] + [line(f"f{i}", "filler " * 50) for i in range(3000)] + [line("x", "second")]))
    (folder / "b.jsonl").write_text(line("x", "last"))
    got = {r.doc_id: r.text for r in readers.read_corpus(spark, f"file:{folder}").collect()}
    assert len(got) == 3002 and got["x"] == "last" and got["y"] == "only"
    writers.write_router_results(spark.createDataFrame([(1, [0.5, 0.5])], "query_id int, w array<double>"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().w == [0.5, 0.5]
