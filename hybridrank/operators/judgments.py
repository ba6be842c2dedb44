"""Relevance judgements (qrels): derivation by verbatim containment, cleaning, and look-ups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schemas import require
from .sparse import SparseIndex


class Listed(NamedTuple):
    """What containment needs of an index: ``lists(term, doc_ids)`` and ``terms(term, df)``."""

    lists: DataFrame
    terms: DataFrame


def containing_documents(
    corpus: DataFrame,
    passages: DataFrame,
    index: SparseIndex | Listed,
) -> DataFrame:
    """``(query_id, doc_id)`` for every document whose text contains the passage verbatim.

    Exact, without comparing all pairs: an *interior* token of a passage (not its first or last,
    which may be cut inside a word) is a whole token of every document containing the passage.
    So each passage is probed only against the posting list of its rarest interior token, and the
    candidates are verified with a substring test on the whole texts. Passages with fewer than three
    tokens have no interior token; they are anchored on a character gram instead (see below).
    """
    require(corpus, ("doc_id", "text"), "corpus")
    require(passages, ("query_id", "text"), "passages")
    p = passages.select("query_id", F.col("text").alias("passage"), tokens(F.col("text")).alias("toks"))
    interior = p.select(
        "query_id",
        F.explode(F.slice("toks", 2, F.greatest(F.size("toks") - 2, F.lit(0)))).alias("term"),
    )
    anchors = (
        interior.join(index.terms.select("term", "df"), "term")
        .groupBy("query_id")
        .agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    )
    # Which side of these joins is broadcast, if any, is left to the planner, which goes by bytes.
    candidates = index.lists.select("term", "doc_ids").join(anchors, "term").select("query_id", F.explode("doc_ids").alias("doc_id"))
    matched = (
        corpus.select("doc_id", "text")
        .join(candidates, "doc_id")
        .join(p.select("query_id", "passage"), "query_id")
        .filter(F.instr(F.col("text"), F.col("passage")) > 0)
        .select("query_id", "doc_id")
    )
    short = p.filter((F.size("toks") < 3) & (F.length("passage") > 0)).select("query_id", "passage")
    if short.isEmpty():
        return matched
    return matched.unionByName(_short_passage_matches(corpus, short))


GRAM = 3  # character anchor length for passages without an interior token


def _short_passage_matches(corpus: DataFrame, short: DataFrame) -> DataFrame:
    """Exact containment for passages with fewer than three tokens, without comparing all pairs.

    Every substring of a passage occurs in a document that contains it; the anchor is the
    passage's middle ``GRAM``-character gram (the whole passage when shorter). Each document's
    distinct grams of the needed lengths are generated in its own task and semi-joined against the
    anchors before anything is shuffled; survivors are verified on the whole texts.
    """
    q = F.least(F.length("passage"), F.lit(GRAM))
    start = F.floor((F.length("passage") - q) / 2).cast("int") + 1
    anchors = short.select("query_id", "passage", F.substring(F.col("passage"), start, q).alias("gram"))
    # the gram lengths in use: a set of at most GRAM small integers
    lens = sorted(r.n for r in anchors.select(F.length("gram").alias("n")).distinct().collect())

    def grams(n: int):  # a look-ahead matches at every position, in one pass over the text
        return F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    per_len = [grams(n) for n in lens]
    doc_grams = corpus.select(
        "doc_id", F.explode(F.array_distinct(F.flatten(F.array(*per_len)))).alias("gram")
    ).join(anchors.select("gram").distinct(), "gram", "left_semi")
    cands = doc_grams.join(anchors, "gram").select("query_id", "doc_id", "passage")
    return (
        corpus.select("doc_id", "text")
        .join(cands, "doc_id")
        .filter(F.instr(F.col("text"), F.col("passage")) > 0)
        .select("query_id", "doc_id")
    )


def graded_qrels(matches: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, relevance)`` with relevance = 1 + quality label (0 when unlabelled)."""
    if labels is None:
        return matches.withColumn("relevance", F.lit(1))
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    return matches.join(lab, "doc_id", "left").select(
        "query_id", "doc_id", (F.lit(1) + F.coalesce(F.col("quality"), F.lit(0))).cast("int").alias("relevance")
    )


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have at least one judgement (left semi join)."""
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def judgments(pairs: DataFrame, qrels: DataFrame, strict: bool = False) -> DataFrame:
    """Relevance of each ``(query_id, doc_id)`` pair; 0 for an unjudged document.

    With ``strict=True`` a pair whose query has no judgement at all raises at run time.
    """
    require(pairs, ("query_id", "doc_id"), "pairs")
    out = pairs.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn(
        "relevance", F.coalesce(F.col("relevance"), F.lit(0))
    )
    if strict:
        known = qrels.select("query_id").distinct().withColumn("_known", F.lit(True))
        out = out.join(known, "query_id", "left").withColumn(
            "relevance",
            F.when(F.col("_known"), F.col("relevance")).otherwise(
                F.raise_error(F.concat(F.lit("unknown query "), F.col("query_id").cast("string")))
            ),
        ).drop("_known")
    return out


def with_query_text(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Judged query ids with their text; a judged query missing from ``queries`` gets ``""``."""
    ids = qrels.select("query_id").distinct()
    return ids.join(queries.select("query_id", "text"), "query_id", "left").select(
        "query_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
