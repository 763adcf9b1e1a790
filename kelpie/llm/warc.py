"""WARC archives: a writer with one gzip member per record and a sequential reader.

Writing: each task rolls its records into files of about file_mb under a shared folder and reports each finished
file in a manifest. A file gets its final name only when complete, and carries the attempt in its name, so a lost
or repeated task leaves at most orphans that no manifest lists. Reading: each file is streamed in chunks through
one zlib decompressor per member; records are framed by Content-Length and their digests verified.

Records with equal payloads: the one of the smallest page id is the response, the others are revisits that refer
to it (the payload is stored once). Payloads are matched by SHA-1; a thin (id, digest) table is shuffled, never
the pages' bodies.

Defined results: null html is an empty payload; null urls are written as empty; rows that repeat the smallest
page_id of a payload are all responses, and share a record id; a null page_id is written as empty and never a revisit;
a very long payload is one record, held in memory while it is written or read; an empty table gives no file and no
record; page_id has to be an integer. Only page_id, url and html are read, so other columns cannot clash. A damaged
record raises ValueError. The archives are the operator's output and stay in their folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, integer_id, shared_dir, sized, text_or_empty, to_batch

CHUNK = 1 << 18
MANIFEST = "file string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits: pages whose payload a smaller page_id also has, of min_bytes or more.

    sha1 is native; only ids and digests move. Only digests seen twice are joined back, so a payload that a
    third of all pages share is one row on one side, and the other side can be split where it is skewed.
    """
    body = text_or_empty("html")
    digests = pages.where(F.octet_length(body) >= min_bytes).select("page_id", F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return digests.join(first, "digest").where(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def record_id(page_id, sha: str) -> uuid.UUID:
    """Of the page and its payload, so that a revisit can name the response wherever that is written."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{sha}")


def header(page_id, url: str, kind: str, body: bytes, sha: str, size: int, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, sha)}>"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}"]
    lines += ["X-Page-Id: " + ("" if page_id is None else str(page_id))]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, sha)}>", f"X-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode()


def member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str, revisits: DataFrame | None = None, file_mb: int = 64, level: int = 4, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """Writes every page as a record; returns the manifest of the files, computed once and kept."""
    base = pages.select(integer_id(pages, "page_id").alias("page_id"), text_or_empty("url").alias("url"), text_or_empty("html").cast("binary").alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha1("html")))
    if revisits is not None:
        # bodies are moved only if there are too many revisits to send to all tasks
        base = base.join(sized(cut(revisits), broadcast_bytes), ["page_id", "digest"], "left")
    else:
        base = base.withColumn("refers_to", F.lit(None).cast("long"))
    limit = file_mb << 20
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        out, name, n, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            fs.move(f"{root}/{name}.open", f"{root}/{name}")
            done.append((f"{root}/{name}", n, size))

        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                sha = base64.b32encode(digest).decode()
                kind, stored = ("revisit", b"") if refers_to is not None else ("response", body)
                gz = member(header(page_id, url, kind, stored, sha, len(body), refers_to) + stored + b"\r\n\r\n", level)
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.open", compression=None)
                out.write(gz)
                n, size = n + 1, size + len(gz)
                if size >= limit:
                    close()
                    out = None
        if out is not None:
            close()
        yield to_batch(done, schema)

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return cut(base.mapInArrow(run, MANIFEST))


def members(stream) -> Iterator[bytes]:
    """The records of a stream of gzip members, decompressed piece by piece, one at a time."""
    rest = b""
    while True:
        z, record, fed = zlib.decompressobj(31), [], False
        while not z.eof:
            data = rest or stream.read(CHUNK)
            rest = b""
            if not data:
                if fed:
                    raise ValueError("a member ends early")
                return
            fed = True
            while data and not z.eof:
                record.append(z.decompress(data, CHUNK))
                data = z.unconsumed_tail
            rest = z.unused_data
        yield b"".join(record)


def parse_record(record: bytes) -> tuple:
    """A row of RECORD; checks the framing by Content-Length and the payload's digest."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(fields["Content-Length"])
    if not sep or not lines[0].startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record is not framed by its Content-Length")
    payload, kind = rest[:length], fields["WARC-Type"]
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"page {fields['X-Page-Id']}: the payload does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], kind, number("X-Payload-Length"), sha, number("X-Refers-To"), payload if kind == "response" else None


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's files, in the order of each file. A file is one task's unit."""
    columns = RECORD if payloads else RECORD.removesuffix(", payload binary")
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, path = open_fs(file)
                rows, held, n = [], 0, 0
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as stream:
                    for record in members(stream):
                        rows.append(parse_record(record)[: len(schema)])
                        held, n = held + (len(record) if payloads else 256), n + 1
                        if held > 8 << 20:
                            yield to_batch(rows, schema)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{file}: {n} records, {expected} were written")
                if rows:
                    yield to_batch(rows, schema)

    return manifest.select("file", "records").mapInArrow(run, columns)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives under the shared folder and reads them back, without the payloads."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, record_types(pages, min_bytes)), payloads=False)
