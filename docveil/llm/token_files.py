"""Token counts of flat token files without an index, by a scan for end-of-document ids.

A file is ids one after another, 16 or 32 bits each. Blocks of all files are scanned apart: a
vectorised search gives the end ids' places in a block. A prefix scan over the blocks' summaries
(how many ends, and where the last one is) stitches documents that cross blocks and numbers them.
Each block is a task's, so a file of any size is read by as many tasks as it has blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import batches, dealt, filesystem, written

#: Ids of a block.
BLOCK = 1 << 22


def write_token_files(docs: DataFrame, encode, end_id: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes a flat file of 16-bit ids per partition of ``docs`` (doc_id, text).

    ``encode()`` gives, in a worker, a function of a text to little-endian 16-bit ids, none of
    them the end id. Returns the files (path) and their documents (path, ordinal, doc_id). A null
    text is an end id alone; rows keep the order of their partition. Each attempt of a task writes
    a file of its own, and only files in the returned table count.
    """

    def write(it):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        run, end, n = encode(), np.array([end_id], "<u2").tobytes(), 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as sink:
            for whole in it:
                for b in batches([whole], 256):
                    for text in b.column(1).to_pylist():
                        sink.write(run(text or ""))
                        sink.write(end)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * b.num_rows), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=["path", "ordinal", "doc_id"])
                    n += b.num_rows

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "path string, ordinal long, doc_id long")
    documents = written(rows, "documents")
    return documents.select("path").distinct(), documents


def count_tokens(files: DataFrame, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of each document in ``files`` (path).

    ``start`` is the place of its first id, ``n_tokens`` counts its ids without the end id. Two
    end ids in a row give an empty document. Ids after a file's last end id are a last document
    that has not ended. Empty files have no documents; repeated paths count once. A file whose
    size is no multiple of the id's raises ValueError.
    """
    wide = np.dtype(dtype).itemsize

    def sizes(it):
        for b in it:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                size = fs.get_file_info(name).size
                if size % wide:
                    raise ValueError(f"{path}: {size} bytes are no whole ids")
                n = (size // wide + block - 1) // block
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string()), "block": pa.array(np.arange(n))})

    def scan(it):
        for b in it:
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(k * block * wide)
                    ids = np.frombuffer(f.read(block * wide), dtype)
                ends = np.flatnonzero(ids == end_id) + k * block
                yield pa.RecordBatch.from_pydict({"path": [path], "block": [k], "n_ids": pa.array([len(ids)], pa.int64()), "n_ends": pa.array([len(ends)], pa.int64()), "last": pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    schema = "path string, block long, n_ids long, n_ends long, last long, ends array<long>"
    blocks = dealt(files.select("path").distinct()).mapInArrow(sizes, "path string, block long")
    blocks = written(dealt(blocks).mapInArrow(scan, schema), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.drop("ends").select("path", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"))
    joined = blocks.where("n_ends > 0").join(carried, ["path", "block"])
    spans = F.transform("ends", lambda e, i: F.struct(i.alias("i"), (F.when(i > 0, F.get("ends", i - 1)).otherwise(F.col("prior")) + 1).alias("start"), e.alias("end")))
    out = joined.select("path", "base", F.explode(spans).alias("x"))
    out = out.select("path", (F.col("base") + F.col("x.i")).alias("ordinal"), "x.start", "x.end")
    out = out.select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = blocks.groupBy("path").agg(F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n_ids").alias("all"))
    tail = tail.where("all > start").select("path", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return out.unionByName(tail)
