"""Explicit schemas of the data model and a validator used at every public entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

QRELS_FILE_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("relevance", T.IntegerType()),
    ]
)

CORPUS_FILE_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

QUERIES_FILE_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def score_table_schema(experts=("sparse", "dense")) -> T.StructType:
    """Schema of the per-query expert score table (label-generation output)."""
    fields = [T.StructField("query_idx", T.StringType()), T.StructField("query", T.StringType())]
    fields += [T.StructField(e, T.DoubleType()) for e in experts]
    for norm in ("l1", "softmax"):
        fields += [T.StructField(f"{e}_{norm}", T.DoubleType()) for e in experts]
    return T.StructType(fields)


_NUMBER = (T.NumericType,)
#: Types that columns of these names must have; ids may be of any type.
KINDS = {"text": (T.StringType,), "title": (T.StringType, T.NullType), "rank": _NUMBER, "score": _NUMBER, "weight": _NUMBER, "relevance": _NUMBER}


def require(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """Raise ``ValueError`` unless ``df`` is a DataFrame holding every column in ``columns``, of its type."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"{what} must be a Spark DataFrame, got {type(df).__name__}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")
    for c in columns:
        kind = df.schema[c].dataType
        vector = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
        if c in KINDS and not isinstance(kind, KINDS[c]) or c == "embedding" and not vector:
            raise ValueError(f"column {c} of {what} has the type {kind.simpleString()}")
    return df
