"""Vectors of texts, kept between runs: a text is encoded once for each encoder, whatever rows hold it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_text
from ..session import materialize
from .paths import folders, path_exists

#: ``(df with id_col and text, id_col) → (id_col, embedding)``.
Encoder = Callable[[DataFrame, str], DataFrame]


def content(df: DataFrame) -> Column:
    """What is encoded of a row: ``title + " " + text`` where there is a title column, else the text; NULL is empty."""
    return doc_text("title", "text") if "title" in df.columns else F.coalesce(F.col("text"), F.lit(""))


class VectorStore:
    """``(digest, embedding)`` by sha256 of the text, under ``{path}/{name}``; ``name`` stands for the encoder.

    Each addition is a folder of its own, which counts once it is complete: an interrupted run leaves the
    store as it was. Two runs at once may both encode a text; it is then read once.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, encode: Encoder) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"{name!r} can't name an encoder: letters, digits, _ and - only")
        self.spark, self.encode = spark, encode
        self.path = f"{path.rstrip('/')}/{name}"

    def table(self) -> DataFrame | None:
        """All vectors, a row per digest; None while there are none."""
        parts = [f for f in folders(self.spark, self.path) if path_exists(self.spark, f"{f}/_SUCCESS")]
        if not parts:
            return None
        held = self.spark.read.parquet(*parts)
        # A plain scan lets Spark split a join on a text that very many rows share; only digests are read to tell.
        twice = len(parts) > 1 and not held.groupBy("digest").count().filter("count > 1").isEmpty()
        return held.dropDuplicates(["digest"]) if twice else held

    def add(self, df: DataFrame) -> int:
        """Encode the texts of ``df`` that the store doesn't hold, each once; how many.

        Digests alone decide what is missing. Texts that are held don't move where the missing ones are few
        enough for Spark to broadcast their digests by its own size check, and move once where they aren't.
        """
        texts = df.select(content(df).alias("text")).withColumn("digest", F.sha2("text", 256))
        held = self.table()
        if held is not None:
            missing = materialize(texts.select("digest").distinct().join(held.select("digest"), "digest", "left_anti"))
            if missing.isEmpty():
                return 0
            texts = texts.join(missing, "digest", "left_semi")
        part = f"{self.path}/{uuid.uuid4().hex}"
        self.encode(texts.dropDuplicates(["digest"]), "digest").select("digest", "embedding").write.parquet(part)
        return self.spark.read.parquet(part).count()

    def vectors(self, df: DataFrame, id_col: str) -> DataFrame:
        """``(id, embedding)`` for each row of ``df``; new texts are encoded and kept first.

        Rows that repeat an id, or have none, get a vector each. An empty ``df`` gives an empty table.
        """
        self.add(df)
        rows = df.select(F.col(id_col), F.sha2(content(df), 256).alias("digest"))
        return rows.join(self.table(), "digest").select(id_col, "embedding")
