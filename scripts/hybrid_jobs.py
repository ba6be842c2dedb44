"""Command-line runner for the three jobs over collection folders.

A collection folder holds ``corpus.jsonl`` ({"_id", "title", "text"}), ``queries.jsonl`` ({"_id", "text"})
and ``qrels/{split}.tsv``. Indices are built once under ``--index-root`` and reused.

  labels     score every expert per judged query → score-table CSV (router training data)
  train      clean / split or de-leak score tables, fit the router, write model, results, config
  benchmark  precision/recall at 1, 5, 10, 25 of each expert and the routed (or equal-weight) fusion

usage:
  python scripts/hybrid_jobs.py labels    --collection DIR --split test --out OUT [--k 25]
  python scripts/hybrid_jobs.py train     --train CSV... [--test CSV...] --norm l1 --run-dir RUN
  python scripts/hybrid_jobs.py benchmark --collection DIR [--collection DIR ...] [--run-dir RUN] --out OUT
"""

from __future__ import annotations

import argparse
import functools
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hybridrank.plans import jobs  # noqa: E402
from hybridrank.session import ensure_checkpoint_dir  # noqa: E402
from hybridrank.sources import index_store, readers, writers  # noqa: E402


def load_collection(spark, folder: str, split: str):
    corpus = readers.read_corpus(spark, os.path.join(folder, "corpus.jsonl"))
    queries = readers.read_queries(spark, os.path.join(folder, "queries.jsonl"))
    qrels = readers.read_split_qrels(spark, folder, split)
    if qrels is None:
        raise SystemExit(f"no '{split}' judgements in {folder}")
    return corpus, queries, qrels


def experts_for(corpus, folder: str, index_root: str | None, force: bool) -> jobs.Experts:
    root = os.path.join(index_root, os.path.basename(os.path.normpath(folder))) if index_root else None
    return jobs.build_experts(corpus, root, force=force)


def cmd_labels(spark, a) -> None:
    corpus, queries, qrels = load_collection(spark, a.collection, a.split)
    ex = experts_for(corpus, a.collection, a.index_root, a.force)
    jobs.generate_labels(ex, queries, qrels, k=a.k, out_path=a.out)


def cmd_train(spark, a) -> None:
    train = readers.read_score_tables(spark, a.train)
    same = sorted(a.train) == sorted(a.test or [])
    test = readers.read_score_tables(spark, a.test) if a.test else None
    tr, te = jobs.prepare_router_data(train, test, same_source=same, fraction=a.fraction)
    model, results, acc, selection = jobs.train_router(tr, te, norm=a.norm, hidden=a.hidden)
    index_store.save_router(model, a.run_dir, a.norm)
    writers.write_router_results(results, os.path.join(a.run_dir, "test_results"))
    row = acc.first()  # one row: the run's accuracy for the config file
    # fixed values: the names of the run config's entries
    config = {
        "train_score_paths": a.train,
        "test_score_paths": a.test or [],
        "score_norm": a.norm,
        "train_val_split": a.fraction,
        "total_accuracy_on_weights_prediction": row.accuracy,
        "model_selection": selection,
    }
    writers.write_run_config(spark, config, os.path.join(a.run_dir, "config"))


def cmd_benchmark(spark, a) -> None:
    model = index_store.load_router(a.run_dir, a.norm) if a.run_dir else None
    names = [os.path.basename(os.path.normpath(folder)) for folder in a.collection]
    if len(set(names)) < len(names):
        raise SystemExit("two collection folders of the same name")
    loaded = [(name, folder, *load_collection(spark, folder, a.split)) for name, folder in zip(names, a.collection, strict=True)]
    if a.index_root:  # an index of its own for each collection, kept for the next run
        each = [
            jobs.benchmark(experts_for(corpus, folder, a.index_root, a.force), queries, qrels, model=model, k=a.k, corpus_name=name)
            for name, folder, corpus, queries, qrels in loaded
        ]
        out = functools.reduce(DataFrame.unionByName, each)
    else:  # all collections in one plan
        all_of = lambda at: functools.reduce(
            lambda x, y: x.unionByName(y, allowMissingColumns=True), [c[at].withColumn("corpus", F.lit(c[0])) for c in loaded]
        )
        out = jobs.benchmark_corpora(all_of(2), all_of(3), all_of(4), model=model, k=a.k)
    writers.write_benchmark(out, a.out)
    if a.report:  # from the files, so that nothing is searched twice
        writers.write_report(spark.read.json(a.out), a.report)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)
    lab = sub.add_parser("labels")
    lab.add_argument("--collection", required=True)
    lab.add_argument("--split", default="test")
    lab.add_argument("--out", required=True)
    lab.add_argument("--k", type=int, default=jobs.DEFAULT_K)
    tr = sub.add_parser("train")
    tr.add_argument("--train", nargs="+", required=True)
    tr.add_argument("--test", nargs="*")
    tr.add_argument("--norm", default="l1", choices=["l1", "softmax"])
    tr.add_argument("--fraction", type=float, default=0.8)
    tr.add_argument("--hidden", nargs="*", type=int, help="sizes of hidden layers, e.g. 128 64")
    tr.add_argument("--run-dir", required=True)
    be = sub.add_parser("benchmark")
    be.add_argument("--collection", nargs="+", required=True)
    be.add_argument("--report", help="folder for a line per corpus and model, with precision@k and recall@k")
    be.add_argument("--split", default="test")
    be.add_argument("--run-dir")
    be.add_argument("--norm", default="l1", choices=["l1", "softmax"])
    be.add_argument("--out", required=True)
    be.add_argument("--k", type=int, default=jobs.DEFAULT_K)
    for s in (lab, be):
        s.add_argument("--index-root")
        s.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"hybridrank-{a.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    {"labels": cmd_labels, "train": cmd_train, "benchmark": cmd_benchmark}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
