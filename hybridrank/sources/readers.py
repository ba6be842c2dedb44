"""Readers for the collection files: corpus / queries (JSON lines), qrels (TSV/CSV/JSON), score tables (CSV)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import path_exists
from ..schemas import CORPUS_FILE_SCHEMA, QUERIES_FILE_SCHEMA, QRELS_FILE_SCHEMA, score_table_schema


SPLITS = ("train", "test", "dev")


def read_corpus(spark: SparkSession, path: str, dedup: str = "last") -> DataFrame:
    """Corpus JSON lines ``{"_id", "title", "text", ...}`` → ``(doc_id, title, text)``.

    ``dedup``: ``"last"`` keeps the last line of a repeated id (read order), ``"none"`` keeps all.
    Missing title/text read as NULL and are treated as empty strings downstream.
    """
    df = spark.read.schema(CORPUS_FILE_SCHEMA).json(path).withColumnRenamed("_id", "doc_id")
    return _dedup_last(df, "doc_id") if dedup == "last" else df


def read_queries(spark: SparkSession, path: str, dedup: str = "last") -> DataFrame:
    """Queries JSON lines ``{"_id", "text", ...}`` → ``(query_id, text)``."""
    df = spark.read.schema(QUERIES_FILE_SCHEMA).json(path).withColumnRenamed("_id", "query_id")
    return _dedup_last(df, "query_id") if dedup == "last" else df


def queries_from_list(spark: SparkSession, texts, ids=None) -> DataFrame:
    """A single query string or a list of them as a queries DataFrame ``(query_id, text)``.

    Ids default to the position in the list. (Interactive helper: the list lives on the driver.)
    """
    if isinstance(texts, str):
        texts = [texts]
    ids = list(range(len(texts))) if ids is None else list(ids)
    if len(ids) != len(texts):
        raise ValueError("ids and texts differ in length")
    rows = [(i, t) for i, t in zip(ids, texts)]
    id_type = "string" if rows and isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"query_id {id_type}, text string")


def _dedup_last(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: of files in order of their paths, the last line wins.

    Only keys and positions move: the last position of each repeated key is an aggregate (a key
    repeated on a third of all rows is combined map-side), and the positions that lose are taken
    out of the table by an anti join.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    placed = df.select("*", at.alias("_at"))
    last = placed.groupBy(*keys).agg(F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = [placed[k].eqNullSafe(last[k]) for k in keys]
    losers = placed.select(*keys, "_at").join(last, same).filter("_at < _last").select("_at")
    return placed.join(losers, "_at", "left_anti").drop("_at")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` for every id that occurs more than once (to report instead of silently dedup)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def read_qrels_tsv(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """``query-id <sep> corpus-id <sep> score`` with one header line; of a repeated pair the last line
    counts, zero judgements are dropped and a malformed line fails the read."""
    df = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .schema(QRELS_FILE_SCHEMA)
        .csv(path)
    )
    return _dedup_last(df, "query_id", "doc_id").filter(F.col("relevance") != 0)


def read_qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``{query_id: {doc_id: score}}`` → long ``(query_id, doc_id, relevance)``; zeros kept.

    The format is one object per file, so a file is parsed by one task; prefer long-form files
    (``read_qrels_jsonl``) for large judgement sets.
    """
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType())))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(m).alias("query_id", "docs"))
        .select("query_id", F.explode("docs").alias("doc_id", "relevance"))
    )


def read_qrels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Long-form JSON lines ``{"query_id", "doc_id", "relevance"}`` (what :func:`write_qrels` writes)."""
    return spark.read.schema(QRELS_FILE_SCHEMA).json(path)


def read_qrels(spark: SparkSession, path: str, fmt: str | None = None, delimiter: str = "\t") -> DataFrame:
    """Dispatch on ``fmt`` or the file suffix: ``.tsv``/``.csv`` → TSV reader (``.csv`` with ``,``),
    ``.json`` → map-of-map, ``.jsonl`` → long form. Anything else raises (no silent empty result)."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind == "tsv":
        return read_qrels_tsv(spark, path, delimiter)
    if kind == "csv":
        return read_qrels_tsv(spark, path, "," if delimiter == "\t" else delimiter)
    if kind == "json":
        return read_qrels_json(spark, path)
    if kind == "jsonl":
        return read_qrels_jsonl(spark, path)
    raise ValueError(f"unsupported qrels format {kind!r} for {path}")


def read_split_qrels(spark: SparkSession, root: str, split: str = "test", delimiter: str = "\t") -> DataFrame | None:
    """Qrels of one split from a collection folder ``{root}/qrels/{split}.tsv``, or from a Parquet
    table partitioned by ``split=`` (partition pruning). ``None`` when the split does not exist."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {split!r}")
    tsv = os.path.join(root, "qrels", f"{split}.tsv")
    if path_exists(spark, tsv):
        return read_qrels_tsv(spark, tsv, delimiter)
    part = os.path.join(root, "qrels", f"split={split}")
    if path_exists(spark, part):
        return spark.read.parquet(os.path.join(root, "qrels")).filter(F.col("split") == split).drop("split")
    return None


def available_splits(root: str, candidates: Sequence[str] = ("test", "train")) -> list[str]:
    """Those of ``candidates`` present under ``{root}/qrels``."""
    q, spark = os.path.join(root, "qrels"), SparkSession.getActiveSession()
    found = lambda s: any(path_exists(spark, os.path.join(q, n)) for n in (f"{s}.tsv", f"split={s}"))
    return [s for s in candidates if found(s)]


def read_score_tables(spark: SparkSession, paths: Sequence[str], experts: Sequence[str] = ("sparse", "dense"),
                      sources: Sequence[str] | None = None) -> DataFrame:
    """UNION ALL of score-table CSVs (header, quoted fields with doubled quotes, multi-line); blank
    paths are skipped and no path gives an empty table of the same schema.

    Query ids are strings and only mean something within their table, so every row names its
    table in ``source``: ``sources`` in the order of ``paths``, by default the paths themselves.
    """
    schema = score_table_schema(experts)
    named = [(p, s) for p, s in zip(paths, sources or paths, strict=True) if p]
    if len({s for _, s in named}) < len(named):
        raise ValueError("two score tables have the same source")
    out = spark.createDataFrame([], schema).withColumns({"query_id": F.col("query_idx"), "source": F.lit("")})
    for path, source in named:
        part = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        out = out.unionByName(part.withColumns({"query_id": F.col("query_idx"), "source": F.lit(source)}))
    return out


def with_query_key(table: DataFrame, key: str = "query_key") -> DataFrame:
    """``table`` with one string that identifies its query: source and id. A NULL id and a repeated key raise."""
    parts = [F.col(c).cast("string").alias(c) for c in ("source", "query_id") if c in table.columns]
    known = F.when(F.col("query_id").isNull(), F.raise_error(F.lit("query_id is NULL"))).otherwise(F.to_json(F.struct(*parts)))
    keyed = table.withColumn(key, known)
    once = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(
        key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated query "), F.col(key)))).otherwise(F.col("_n")).alias("_n")
    )
    return keyed.join(once.filter(F.col("_n") == 1).select(key), key)


def validate_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of sizes and orphan counts: judged queries without text, judged docs not in the corpus."""
    judged_q = qrels.select("query_id").distinct()
    judged_d = qrels.select("doc_id").distinct()
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()  # noqa: E731  (scalar subqueries, no driver collect)
    return corpus.sparkSession.range(1).select(
        n(corpus).alias("n_docs"),
        n(queries).alias("n_queries"),
        n(qrels).alias("n_qrels"),
        n(judged_q).alias("n_judged_queries"),
        n(judged_q.join(queries, "query_id", "left_anti")).alias("orphan_queries"),
        n(judged_d.join(corpus, "doc_id", "left_anti")).alias("orphan_docs"),
    )
