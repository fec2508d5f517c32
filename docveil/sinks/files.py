"""Rewritten files written out by the executors."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rewritten: DataFrame, folder: str) -> DataFrame:
    """Writes (path, content) to files in ``folder``, a URI all executors reach.

    A file keeps its path below the folder that all paths share, so files of one name in several
    folders stay apart. Returns (path, written), a lazy frame whose action writes; a file without
    content is not written, and its ``written`` is null. A file is written under a name of its own
    first and then moved, so a task that runs again leaves a whole file.
    """
    ends = rewritten.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    shared = os.path.commonprefix([ends.a or "", ends.b or ""]).rpartition("/")[0]

    def run(it):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in it:
            names = []
            for path, content in zip(b["path"], b["content"], strict=True):
                if content is None:
                    names.append(None)
                    continue
                below, _, name = path[len(shared) :].strip("/").rpartition("/")
                if below:
                    store.create_dir(f"{root}/{below}", recursive=True)
                goal = f"{below}/{name}".lstrip("/")
                part = f"{root}/{below}/.{name}.{uuid.uuid4().hex}" if below else f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(bytes(content))
                store.move(part, f"{root}/{goal}")
                names.append(f"{folder}/{goal}")
            yield pd.DataFrame({"path": b["path"], "written": names})

    return rewritten.select("path", "content").mapInPandas(run, "path string, written string")
