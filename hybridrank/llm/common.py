"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but ASCII white space (fixed by the contracts of several queries).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Documents without an id come after all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage like ``checkpoint()`` but stays columnar, so later reads prune columns. The
    files live as long as the cluster's checkpoint folder.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as the query ends, not when the driver happens to collect its garbage.

    For jobs of many ``written`` steps: later steps read only what was written.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def id_or_last(col: str) -> Column:
    """The id as a long; a missing id counts as the largest."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_or_null(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_rows(df: DataFrame) -> Column:
    """All columns of ``df`` in one, so that none can clash with an operator's own; ``select("row.*")`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
