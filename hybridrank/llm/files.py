"""Binary files in the cluster's shared folder, written and read inside tasks.

A task gives each file a name of its own and reports it in a manifest row. The manifest is committed by
Spark's Parquet writer, so of attempts that were repeated or lost only the files of the one that counts
are listed; others are never read.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

MANIFEST = "part int, seq int, path string, documents long, units long, bytes long"


def filesystem(uri: str):
    """pyarrow's file system for ``uri`` (local, HDFS, S3, GCS, Azure) and the path in it."""
    from pyarrow import fs

    if uri.startswith("/") or uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """A new file in ``folder``: its URI and a stream to write to."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)


def opened(uri: str):
    store, path = filesystem(uri)
    return store.open_input_file(path)


class Manifest:
    """Rows about the files one task has written."""

    def __init__(self) -> None:
        self.part, self.rows = TaskContext.get().partitionId(), []

    def add(self, path: str, documents: int, units: int, size: int) -> None:
        self.rows.append((self.part, len(self.rows), path, documents, units, size))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def dealt(manifest: DataFrame) -> DataFrame:
    """The manifest with its files spread evenly over the tasks that read them."""
    n = partitions(manifest.sparkSession)
    at = F.row_number().over(Window.orderBy("part", "seq"))
    return manifest.withColumn("__to", (at % n).cast("int")).repartitionById(n, "__to").drop("__to")


def slices(batches, rows: int = 512):
    """Smaller batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
