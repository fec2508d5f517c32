"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own. The reader goes through a file once: it inflates step by
step, reads a record's header, then exactly Content-Length bytes, and checks the block's digest
and that the member ends where the record does; so a file of any size needs the memory of one
record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import dealt, filesystem, written

STEP = 1 << 16
#: Payloads shorter than this are never replaced by a revisit.
SMALL = 1000
#: Rows of a batch that is read, and the bytes of their URLs and payloads from which it is full.
READ_ROWS, READ_BYTES = 1024, 8 << 20
#: Repeated payloads' digests that may be broadcast: 10 MB.
BROADCAST_DIGESTS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    """A digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file (read); ValueError at the first fault."""
    z, plain, packed, ended = None, bytearray(), b"", False

    def more() -> bool:
        """Inflates one more step of this member into ``plain``."""
        nonlocal z, packed, ended
        if ended:
            return False
        if not packed:
            packed = source.read(STEP)
            if not packed:
                raise ValueError("the file ends within a record")
        plain.extend(z.decompress(packed, STEP))
        packed = z.unconsumed_tail
        if z.eof:
            packed, ended = z.unused_data, True
        return True

    while True:
        if not packed:
            packed = source.read(STEP)
            if not packed:
                return
        z, ended = zlib.decompressobj(31), False
        plain.clear()
        seen = 0
        while (cut := plain.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(plain) - 3)
            if not more():
                raise ValueError("a record without a header")
        lines = bytes(plain[:cut]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {lines[0][:20]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        del plain[: cut + 4]
        while len(plain) < size + 4:
            if not more():
                raise ValueError("a record shorter than its Content-Length")
        while more():
            if len(plain) > size + 4:
                raise ValueError("a record longer than its Content-Length")
        block = bytes(plain[:size])
        if plain[size:] != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        if fields.get("warc-block-digest") not in (None, sha1(block)):
            raise ValueError("a block's digest differs")
        yield fields, block


def urn(page_id: int | None, payload: bytes) -> str:
    """A record id that holds a page's id, if it has one, and 40 bits of its payload's digest."""
    known, low = (0xD0C, page_id & (2**64 - 1)) if page_id is not None else (0xD0D, 0)
    return f"<urn:uuid:{uuid.UUID(int=known << 116 | int.from_bytes(hashlib.sha1(payload).digest()[:5]) << 64 | low)}>"


def page_of(record_id: str) -> int | None:
    """The page's id in a record id; None if it holds none."""
    try:
        n = uuid.UUID(record_id.strip("<>").rpartition(":")[2]).int
    except ValueError:
        return None
    low = n & (2**64 - 1)
    return low - (low >> 63 << 64) if n >> 116 == 0xD0C else None


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes, bool]:
    """(payload, whether the header's payload digest is of just these bytes).

    The payload of an HTTP message is its body; one in a transfer encoding is left as it is.
    """
    if not fields.get("content-type", "").startswith("application/http"):
        return block, True
    head, _, body = block.partition(b"\r\n\r\n")
    return body, b"transfer-encoding:" not in head.lower()


def sha1_hex(digest: str | None) -> str | None:
    """A SHA-1 digest of a header, in base 32 or 16, as bare hex; None for another kind."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def plan_records(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of at least ``small`` bytes the one of the
    largest page_id is a response and the others refer to it, also those without an id. Where none
    has an id all are responses.

    Only digests that occur twice are joined back; both sides of that join are plain exchanges of
    a table, which Spark splits where one payload fills many rows.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.when(F.octet_length(body) >= small, F.sha2(body, 256)).alias("digest"))
    twice = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    twice = written(twice, "payloads")
    few = twice.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    own = F.coalesce("digest", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    joined = rows.withColumn("digest", own).join(F.broadcast(twice) if few else twice, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, small: int = SMALL, at: datetime = datetime(2024, 1, 1, tzinfo=UTC)) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html), a file per partition.

    Returns the files (path, n_records), which the driver holds: a row for each partition. The
    payload is the html in UTF-8, empty if null; a null url is written as an empty one. Each attempt
    of a task writes a file of its own and only the returned ones count. Rows that repeat a page_id
    are records of their own, and so have other record ids where their payloads differ. The record
    of a null page_id has an id without one.
    """
    date = at.strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(it):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as sink:
            info = "software: docveil\r\nformat: WARC File Format 1.1\r\n".encode()
            sink.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
            for b in it:
                for i in range(b.num_rows):
                    page, url, html, first = (c[i] for c in b.columns)
                    page, url, html, first = page.as_py(), url.as_py(), html.as_buffer(), first.as_py()
                    payload = b"" if html is None else html.to_pybytes()
                    fields = [("WARC-Record-ID", urn(page, payload)), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Date", date), ("WARC-Payload-Digest", sha1(payload)), ("X-Payload-Length", str(len(payload)))]
                    if first is None:
                        sink.write(record("response", [*fields, ("Content-Type", "text/html; charset=utf-8")], payload))
                    else:
                        sink.write(record("revisit", [*fields, ("WARC-Refers-To", urn(first, payload)), ("WARC-Profile", PROFILE)], b""))
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    # As an Arrow table: rows would be made in further Python workers.
    done = plan_records(pages, small).mapInArrow(write, "path string, n_records long").toArrow()
    return pages.sparkSession.createDataFrame(done)


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each
    response and revisit in ``archives`` (path), a task per file; repeated paths count once.

    Length and digest are of the full payload, of a response as it was read: the block, or the
    body of an HTTP message. A response that differs from its header's digest or length is a fault
    (ValueError), as is a file cut short. Of archives by other writers page_id and refers_to are
    null, and so is what a revisit's header doesn't say; digests other than SHA-1 are not held
    against the payload. A record without a URL has an empty one.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def row(path: str, h: dict[str, str], block: bytes) -> list:
        kind, said, size = h["warc-type"], sha1_hex(h.get("warc-payload-digest")), h.get("x-payload-length")
        payload, size, first = b"", int(size) if size else None, None
        if kind == "response":
            payload, plain = payload_of(h, block)
            digest = hashlib.sha1(payload).hexdigest()
            if (plain and said not in (None, digest)) or size not in (None, len(payload)):
                raise ValueError(f"{path}: a payload differs from its header")
            said, size = digest, len(payload)
        else:
            first = page_of(h.get("warc-refers-to", ""))
        url = h.get("warc-target-uri", "").encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return [page_of(h.get("warc-record-id", "")), url, size, said, kind, first, *[payload] * payloads]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(it):
        for b in it:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as f:
                    for h, block in read_records(f):
                        if h.get("warc-type") in ("response", "revisit"):
                            rows.append(row(path, h, block))
                            held += len(rows[-1][1]) + (len(rows[-1][-1]) if payloads else 0)
                        if len(rows) == READ_ROWS or held >= READ_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # Few rows: without coalesce each shuffle partition would write a file with a path or two.
    return dealt(archives.select("path").distinct().coalesce(8)).mapInArrow(read, schema)
