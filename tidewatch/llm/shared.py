"""Folders that the driver and every executor can reach, and a cut of the lineage through them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words, as a class for Java's and Python's regular expressions.
BLANKS = r"[\x20\x09-\x0D]+"


def named(df: DataFrame, column: str) -> Column:
    """df's column of exactly that name, whatever characters the name holds."""
    return df["`" + column.replace("`", "``") + "`"]


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one struct, so that their names meet no others."""
    return F.struct(*[named(df, c) for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where none is set a new local one is made, but only for a local master: executors elsewhere wouldn't share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table and file of this application; frames that still read them can't be read after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, group_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: later jobs read the files, so a lost executor costs no recomputation.

    group_rows: most rows in a row group.  Spark's reader decodes up to 4096 rows of a row group at once, whatever their size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    limit = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.options(**limit).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most rows texts go to a Python worker at a time, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


class SharedFiles:
    """Plain files under a shared folder, from the driver or an executor.

    Local paths are memory-mapped; any other scheme goes through Arrow's file systems.
    """

    def __init__(self, root: str):
        self.root = root
        self.local = root.startswith("file:") or "://" not in root
        if self.local:
            self.base = "/" + root.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(root)

    def write(self, name: str, chunks) -> int:
        """Write whole and then rename, so a task that runs twice leaves one whole file."""
        path, part = f"{self.base}/{name}", f"{self.base}/.{name}.{uuid.uuid4().hex}"
        size = 0
        if self.local:
            os.makedirs(self.base, exist_ok=True)
            with open(part, "wb") as out:
                for chunk in chunks:
                    size += out.write(chunk)
            os.replace(part, path)
            return size
        self.fs.create_dir(self.base, recursive=True)
        with self.fs.open_output_stream(part) as out:
            for chunk in chunks:
                size += out.write(chunk)
        self.fs.move(part, path)
        return size

    def array(self, name: str, dtype):
        """The file as a flat array; memory-mapped where it is local."""
        import numpy as np

        path = f"{self.base}/{name}"
        if self.local:
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
        with self.fs.open_input_file(path) as src:
            return np.frombuffer(src.read(), dtype=dtype)
