"""What the operators share: written tables in the cluster's shared folder, and expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tasks that files or blocks are dealt to at most; each then takes several in turn.
MOST_TASKS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI in ``spark.checkpoint.dir``; where that is unset, in the warehouse.

    ValueError if that is a folder of one machine while the executors are on others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docveil"
        local = root.startswith(("file:", "/"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset and the warehouse is a local folder, which other machines do not see")
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    elif root.startswith("/"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application's operators have written in the shared folder, so also what
    their lazy results still read; to be called when these have been saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(rows: DataFrame) -> DataFrame:
    """Few rows that each are much work, such as files, dealt to a task each (``MOST_TASKS`` at most)."""
    rows = written(rows, "todo")
    return rows.repartition(min(max(1, rows.count()), MOST_TASKS))


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for workers that write files in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


def sized(it: Iterator, column: int, most: int) -> Iterator:
    """Arrow batches cut where the texts of a column reach another ``most`` bytes, between rows."""
    for b in it:
        ends = np.cumsum(pc.coalesce(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype="<i8")
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def batches(it: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
