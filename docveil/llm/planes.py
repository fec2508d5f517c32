"""Token ids in chunked files of compressed bit or byte planes.

A file is chunks and then an index. A chunk holds up to ``CHUNK`` ids, transposed into planes:
plane p has byte (or bit) p of every id. Planes that are all zero above the largest id are left
out, each of the others is compressed with zstandard. The index (JSON, compressed) lists for each
chunk its offset, the number of ids and the planes' compressed sizes, and for the documents their
ids and lengths as planes too; a fixed-size tail gives its place, length and checksum.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import dealt, filesystem, shared_dir, sized, written

MAGIC, TAIL = b"DVPLANE1", struct.Struct("<QII8s")
CHUNK = 1 << 16
#: Bytes of texts that are encoded together.
TEXT_BYTES = 16 << 20


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of unsigned ids (32 or 64 bits), lowest first, without the zero ones on top."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), -1)
    most = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [raw[:, p].tobytes() for p in range((most + 7) // 8)]
    return [np.packbits((raw[:, p // 8] >> (p % 8)) & 1).tobytes() for p in range(most)]


def from_planes(planes: list[bytes], n: int, kind: str, dtype: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    for p, plane in enumerate(planes):
        if kind == "byte":
            out[:, p] = np.frombuffer(plane, np.uint8)
        else:
            out[:, p // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (p % 8)
    return out.reshape(-1).view(dtype)


class PlaneWriter:
    """Writes ids to ``sink`` (write) in chunks; documents are added in order."""

    def __init__(self, sink, kind: str = "byte", level: int = 3):
        import zstandard

        self.sink, self.kind, self.zip = sink, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.tables = 0, [], {"doc": [], "length": []}
        self.docs, self.lengths, self.ids, self.held = [], [], [], 0
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def block(self, values: np.ndarray, into: list) -> None:
        planes = [self.zip.compress(p) for p in to_planes(values, self.kind)]
        into.append([self.at, len(values), [len(p) for p in planes], zlib.crc32(values.tobytes())])
        for p in planes:
            self.put(p)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc), self.lengths.append(len(ids)), self.ids.append(ids)
        self.held += len(ids)
        if self.held >= CHUNK:
            self.flush(False)
        if len(self.docs) >= CHUNK:
            self.flush_tables()

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.empty(0, "<u4")
        end = len(flat) if last else len(flat) - len(flat) % CHUNK
        for i in range(0, end, CHUNK):
            self.block(flat[i : min(i + CHUNK, end)], self.chunks)
        self.ids, self.held = [flat[end:]], len(flat) - end

    def flush_tables(self) -> None:
        self.block(np.array(self.docs, "<i8").view("<u8"), self.tables["doc"])
        self.block(np.array(self.lengths, "<u8"), self.tables["length"])
        self.docs, self.lengths = [], []

    def close(self) -> None:
        self.flush(True)
        if self.docs:
            self.flush_tables()
        index = self.zip.compress(json.dumps({"kind": self.kind, "chunks": self.chunks, **self.tables}).encode())
        at = self.at
        self.put(index)
        self.put(TAIL.pack(at, len(index), zlib.crc32(index), MAGIC))


class PlaneReader:
    """Reads a file of ``PlaneWriter`` from a seekable source chunk by chunk and checks it."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        at, size, crc, magic = TAIL.unpack(self.get(end - TAIL.size, TAIL.size))
        index = self.get(at, size)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole plane file")
        self.index = json.loads(self.zip.decompress(index))

    def get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("the file ends too early")
        return data

    def block(self, entry: list, dtype: str) -> np.ndarray:
        at, n, sizes, crc = entry
        data, planes, i = self.get(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.zip.decompress(data[i : i + size]))
            i += size
        values = from_planes(planes, n, self.index["kind"], dtype)
        if zlib.crc32(values.tobytes()) != crc:
            raise ValueError("a chunk's checksum differs")
        return values

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start:end``; only the chunks that hold them are read."""
        first = start // CHUNK
        parts = [self.block(e, "<u4") for e in self.index["chunks"][first : (end + CHUNK - 1) // CHUNK]]
        return (np.concatenate(parts) if parts else np.empty(0, "<u4"))[start - first * CHUNK : end - first * CHUNK]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc id, ids) in the file's order; at most a document and a chunk are held."""
        chunks, held = iter(self.index["chunks"]), np.empty(0, "<u4")
        for d, n in zip(self.index["doc"], self.index["length"], strict=True):
            for doc, size in zip(self.block(d, "<u8").view("<i8").tolist(), self.block(n, "<u8").tolist(), strict=True):
                parts, got = [held], len(held)
                while got < size:
                    parts.append(self.block(next(chunks), "<u4"))
                    got += len(parts[-1])
                held = np.concatenate(parts)
                yield doc, held[:size]
                held = held[size:]


def write_planes(docs: DataFrame, encode, end_id: int, folder: str, kind: str = "byte", many: bool = False) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), in ascending doc_id order over the files.

    ``encode()`` gives, in a worker, a function of a text to little-endian 16-bit ids; if ``many``, of
    an Arrow array of texts to a list of such. Returns the manifest, a row per file in order: path,
    part, n_docs, n_ids. Null texts are empty; a null doc_id comes first, as the id -2^63; rows of one
    id are in the order of their texts' xxhash64 and then of their packed ids, whatever the
    partitions. Texts are encoded where they are and only ids are sorted. Each attempt of a task
    writes a file of its own and only the manifest's count.
    """
    lowest = -(1 << 63)

    def run(it):
        import zstandard

        # Compressed by planes on the way too: they are written, sorted and dealt so.
        ids_of, zip_ = encode(), zstandard.ZstdCompressor(level=1)
        pack = lambda raw: zip_.compress(raw[0::2] + raw[1::2])
        for b in sized(it, 2, TEXT_BYTES):
            ids = ids_of(b.column(2)) if many else map(ids_of, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(pack, ids)), pa.binary())], names=["doc_id", "h", "ids"])

    def write(it):
        import zstandard
        from pyspark import TaskContext

        unzip = zstandard.ZstdDecompressor()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.planes"
        end, docs_n, ids_n = np.array([end_id], "<u4"), 0, 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as sink:
            w = PlaneWriter(sink, kind)
            for b in it:
                for doc, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    low, high = np.frombuffer(unzip.decompress(packed), np.uint8).reshape(2, -1).astype("<u4")
                    ids = np.concatenate([low | high << 8, end])
                    w.add(doc, ids)
                    docs_n, ids_n = docs_n + 1, ids_n + len(ids)
            w.close()
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([part], pa.int64()), "n_docs": pa.array([docs_n], pa.int64()), "n_ids": pa.array([ids_n], pa.int64())})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # Written, as the range partitioning reads its rows twice.
    rows = written(rows.mapInArrow(run, "doc_id long, h long, ids binary"), "ids")
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    # As one file: a row for each task.
    return written(rows.mapInArrow(write, "path string, part long, n_docs long, n_ids long").repartition(1), "manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the manifest's files.

    ``start`` counts the ids of all documents before it, over all files: a running sum over the
    manifest, which has a row per writing task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    todo = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(it):
        for b in it:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                at = start
                with fs.open_input_file(name) as f:
                    for doc, ids in PlaneReader(f).documents():
                        for k, v in zip(out, (None if doc == -(1 << 63) else doc, at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            out[k].append(v)
                        at += len(ids)
                        if len(out["start"]) == 8192:
                            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})
                            out = {k: [] for k in out}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return dealt(todo).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def planes_folder(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession)}/planes"
