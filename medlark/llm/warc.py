"""WARC archives through a table of chunks.

Writing: each record streams through the compressor in slices of CHUNK bytes into a gzip member of its own, so no record
is ever built as a whole. Reading gives the chunk table: one row for every (record, chunk number), with a SHA-1 that runs
along, so that the row of a record's last chunk holds the digest of the whole payload and nothing has to be regrouped.

Payloads equal in SHA-256 and length, of at least `least` bytes, are stored once: the record with the largest page_id is
the response, others are revisits that name it. Null payloads are empty; records with null page_id are written as such
and come after all others as candidates for the response. Repeated rows each give a record; if they share the largest
page_id, each of them is a response. An empty table gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, screen, written

CHUNK = 64 << 10
#: Fixed values of the format.
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def with_decisions(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds payload, payload_bytes, digest and refers_to (the response of a revisit, else null).

    Groups are counted with map-side sums, so a payload that a third of all pages share costs a row a task. Only pages of
    groups of two or more (and a few that a screen lets pass) are shuffled, to meet their group's row; a hot payload's pages
    are split by the engine (a skewed sort-merge join). All others go on where they were read."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long"))
    keyed = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.concat_ws(":", F.sha2("payload", 256), F.col("payload_bytes"))))
    groups = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").select("key", "keeper")
    groups = written(groups, "groups")
    passes = screen(groups.select(F.xxhash64("key").alias("h")), "h")
    shared = F.col("key").isNotNull() & passes(F.xxhash64("key"))
    met = keyed.where(shared).join(groups, "key", "left")
    columns = ["page_id", "url", "payload", "payload_bytes"]
    alone = keyed.where(~shared).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(met.select(*columns, F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to")))


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _head(fields: list[tuple[str, object]]) -> bytes:
    return (f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _record(page_id, url, payload: memoryview, refers_to) -> Iterator[bytes | memoryview]:
    """The pieces of a record, none longer than CHUNK."""
    sha = hashlib.sha1()
    for at in range(0, len(payload), CHUNK):
        sha.update(payload[at : at + CHUNK])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "revisit" if refers_to is not None else "response"
    block = len(http) + (0 if kind == "revisit" else len(payload))
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{RECORD_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", block),
    ]
    yield _head(fields)
    yield http
    if kind == "response":
        for at in range(0, len(payload), CHUNK):
            yield payload[at : at + CHUNK]
    yield b"\r\n\r\n"


def write_archives(decided: DataFrame, folder: str, per_file: int = 64 << 20, level: int = 1) -> DataFrame:
    """Writes archives of about per_file bytes of payload under folder; a table of (file, records, bytes), one row each.

    A task writes to names of its own attempt and only its result names them, so a task that is run again, after a lost
    executor or twice at a time, leaves no archive that is read twice."""

    def run(batches):
        store, root = _files(folder)
        store.create_dir(root, recursive=True)
        sink = name = None
        records = size = 0
        for b in batches:
            for i in range(b.num_rows):
                if sink is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = memoryview(b.column("payload")[i].as_buffer() or b"")
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in _record(b.column("page_id")[i].as_py(), b.column("url")[i].as_py(), payload, b.column("refers_to")[i].as_py()):
                    sink.write(member.compress(piece))
                sink.write(member.flush())
                records, size = records + 1, size + len(payload)
                if size >= per_file:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "records": records, "bytes": size}])
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "records": records, "bytes": size}])

    return written(decided.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "warc-index")


def _inflated(stream) -> Iterator[bytes]:
    """What the gzip members of a stream hold, in pieces of at most CHUNK bytes."""
    member, rest = zlib.decompressobj(31), b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        if piece := member.decompress(rest, CHUNK):
            yield piece
        rest = member.unconsumed_tail
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(31)


class _Reader:
    """Lines and counted bytes out of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def fill(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def head(self) -> bytes | None:
        """Up to an empty line."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                return None
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        """At least one and at most n bytes."""
        if not self.held and not self.fill():
            raise EOFError("the archive ends within a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def parse(stream, data: bool = True) -> Iterator[dict]:
    """Chunk rows of an archive: page_id, record_type, refers_to, chunk, offset, data, sha1 so far, last, declared digest.
    A payload of no bytes, and a revisit, give one row."""
    reader = _Reader(_inflated(stream))
    while (head := reader.head()) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        http = reader.head()
        left = int(fields["Content-Length"]) - len(http) - 4
        told = int(re.search(rb"Content-Length: (\d+)", http)[1])
        page, refers = (re.search(rf"<{RECORD_ID}(-?\d*)>", fields.get(k, ""))  for k in ("WARC-Record-ID", "WARC-Refers-To"))
        row = {"page_id": int(page[1]) if page and page[1] else None, "record_type": fields["WARC-Type"], "refers_to": int(refers[1]) if refers else None, "payload_bytes": told}
        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if row["record_type"] == "revisit":
            yield row | {"chunk": 0, "offset": 0, "data": b"" if data else None, "sha1": declared, "last": True}
        else:
            sha, number, offset = hashlib.sha1(), 0, 0
            while True:
                piece = b""
                while left and len(piece) < CHUNK:
                    got = reader.take(min(left, CHUNK - len(piece)))
                    piece, left = piece + got, left - len(got)
                sha.update(piece)
                if not left and sha.hexdigest() != declared:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
                yield row | {"chunk": number, "offset": offset, "data": piece if data else None, "sha1": sha.hexdigest(), "last": not left}
                number, offset = number + 1, offset + len(piece)
                if not left:
                    break
        reader.head()  # the two line ends behind a record


CHUNK_ROWS = "page_id long, record_type string, refers_to long, payload_bytes long, chunk long, offset long, data binary, sha1 string, last boolean"


def read_chunks(spark: SparkSession, index: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the archives that an index names; data=False leaves the bytes out."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("chunk", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("sha1", pa.string()), ("last", pa.bool_())])

    def run(batches):
        for b in batches:
            for uri in b.column("file").to_pylist():
                store, path = _files(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in parse(stream, data):
                        rows.append(row)
                        size += len(row["data"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = max(1, min(index.count(), 10_000))
    return index.select("file").repartition(files).mapInArrow(run, CHUNK_ROWS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes all pages as archives in the shared folder and gives what the archives hold, a row for each record."""
    index = write_archives(with_decisions(pages, least), new_path(spark, "warc"))
    return read_chunks(spark, index, data=False).where("last").select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
