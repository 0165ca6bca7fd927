"""WARC archives: write, normalise a monolithic gzip, index, read back.

``write_archives`` writes one whole-file gzip stream per archive (all records
in one member), as many tools leave them. ``normalise`` inflates each stream
once, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets, so that a record can be read alone. ``read_records`` reads
records by that index.

Files go to shared storage through pyarrow's file systems (file, hdfs, s3,
gs), under a name that holds the task attempt, and are moved into place when
complete; a lost task is run again and writes the same file.

Edge cases: a null or empty payload is a record of 0 bytes; repeated rows
(same id and payload) are records of their own, one of them the response; a
null id sorts before every other; line breaks in a URL are percent-encoded;
an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage

#: Payload bytes after which a task closes an archive and opens the next.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
_GZIP = 31          # zlib window bits: gzip header and trailer

INDEX_SCHEMA = "path string, offset bigint, length bigint, record_id string"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _move_into_place(fs, tmp: str, path: str) -> None:
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type != FileType.NotFound:     # another attempt of this task was first
        fs.delete_file(path)
    fs.move(tmp, path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text)


def record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps digest and length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[:int(headers["content-length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a stream of bytes, one at a time, by their content length."""
    buf = bytearray()
    need = 0
    for chunk in chunks:
        buf += chunk
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                for line in bytes(buf[:end]).split(b"\r\n"):
                    if line[:15].lower() == b"content-length:":
                        need = end + 4 + int(line[15:]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = 0


def inflate(f) -> Iterator[bytes]:
    """A gzip file of one or more members, in pieces of bounded size."""
    z = zlib.decompressobj(_GZIP)
    while data := f.read(READ_BYTES):
        while data:
            yield z.decompress(data, 4 * READ_BYTES)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(_GZIP)
    yield z.flush()


def roles(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Pages with ``record_id``, ``refers_to`` (null: a response) and payload.

    The response of equal payloads is found among narrow rows (id, digest) by
    an aggregate with partial sums; the payloads themselves are shuffled once,
    by id and digest, so a payload that a third of the pages share is spread.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = lambda i: F.concat(F.lit("urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"))
    keyed = (pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
             .withColumn("name", name(F.col("page_id"))))
    best = (keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1")
            .agg(F.max("page_id").alias("best"), F.lit(True).alias("shared")))
    ids = stage(keyed.select("name", "sha1").distinct().join(best, "sha1", "left")
                .select("name", F.when(F.col("shared"), name(F.col("best"))).alias("first")), folder, "roles")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("url"))
    refers = F.when((F.col("name") != F.col("first")) | (F.col("nth") > 1), F.concat("first", F.lit(":1")))
    return (keyed.join(ids, "name").withColumn("nth", nth)
            .select("url", "payload", F.concat("name", F.lit(":"), F.col("nth").cast("string")).alias("record_id"),
                    refers.alias("refers_to")))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (record_id, url, payload, refers_to) as whole-file gzip
    streams below ``folder``; returns their paths."""

    def run(batches):
        ctx = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(f"{base}/whole", recursive=True)
        n, out, size = 0, None, 0

        def close():
            nonlocal n, out
            out.write(z.flush())
            out.close()
            name = f"whole/part-{ctx.partitionId():06d}-{n:04d}.warc.gz"
            _move_into_place(fs, tmp, f"{base}/{name}")
            n, out = n + 1, None
            return {"path": [f"{folder}/{name}"]}

        for b in batches:
            for rid, url, payload, refers in zip(b["record_id"], b["url"], b["payload"], b["refers_to"]):
                if out is None:
                    tmp, size, z = f"{base}/whole/.{ctx.taskAttemptId()}-{n}.tmp", 0, zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                    out = fs.open_output_stream(tmp, compression=None)
                out.write(z.compress(record("response" if refers is None else "revisit", rid, url, payload, refers)))
                size += len(payload) + 600
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return map_batches(rows.select("record_id", "url", "payload", "refers_to"), run, "path string")


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """One gzip member per record, and a sidecar index beside each archive;
    returns the index. A stream is inflated once, in bounded memory."""

    def run(batches):
        ctx = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(f"{base}/records", recursive=True)
        for b in batches:
            for uri in b["path"]:
                name = uri.rsplit("/", 1)[1]
                source, at = file_system(uri)
                tmp, entries, offset = f"{base}/records/.{ctx.taskAttemptId()}-{name}", [], 0
                with source.open_input_stream(at, compression=None) as f, fs.open_output_stream(tmp, compression=None) as out:
                    for raw in split_records(inflate(f)):
                        member = zlib.compress(raw, 6, _GZIP)
                        out.write(member)
                        entries.append((offset, len(member), parse(raw)[0]["warc-record-id"].strip("<>")))
                        offset += len(member)
                with fs.open_output_stream(f"{tmp}.cdxj", compression=None) as out:
                    for o, n, rid in entries:
                        out.write(json.dumps({"offset": o, "length": n, "id": rid}).encode() + b"\n")
                _move_into_place(fs, f"{tmp}.cdxj", f"{base}/records/{name}.cdxj")
                _move_into_place(fs, tmp, f"{base}/records/{name}")
                for i in range(0, len(entries), 10_000):
                    o, n, rid = zip(*entries[i:i + 10_000])
                    yield {"path": [f"{folder}/records/{name}"] * len(o), "offset": list(o), "length": list(n), "record_id": list(rid)}

    return map_batches(paths.select("path"), run, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """Read every indexed record alone, from its own member.
    ``payload_ok``: a response's payload has the length and digest its header names."""

    def run(batches):
        fs, last, f = None, None, None
        for b in batches:
            out = {k: [] for k in ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")}
            for path, offset, length in zip(b["path"], b["offset"], b["length"]):
                if path != last:
                    if f is not None:
                        f.close()
                    fs, at = file_system(path)
                    last, f = path, fs.open_input_file(at)
                f.seek(offset)
                head, block = parse(zlib.decompress(f.read(length), _GZIP))
                payload, kind = block.partition(b"\r\n\r\n")[2], head["warc-type"]
                size, sha = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size_read, sha_read = len(payload), digest(payload)
                else:
                    size_read, sha_read = size, sha
                for k, v in (("record_id", head["warc-record-id"].strip("<>")), ("payload_bytes", size_read), ("payload_digest", sha_read),
                             ("record_type", kind), ("refers_to", head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None),
                             ("payload_ok", size_read == size and sha_read == sha)):
                    out[k].append(v)
            yield out
        if f is not None:
            f.close()

    return map_batches(index.select("path", "offset", "length"), run,
                       "record_id string, payload_bytes bigint, payload_digest string, record_type string, "
                       "refers_to string, payload_ok boolean")


def page_of(record_id: str) -> F.Column:
    """The page id in a record id."""
    return F.expr(f"try_cast(split({record_id}, ':')[2] AS BIGINT)")


def archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all ``pages`` (page_id, url, html)."""
    whole = stage(write_archives(roles(pages, folder, least_bytes), folder), folder, "whole-paths")
    # One archive per task: a task inflates a stream of bounded size.
    n = max(1, min(whole.count(), 100_000))
    index = stage(normalise(whole.repartitionByRange(n, "path"), folder), folder, "index")
    return read_records(index).withColumns({"page_id": page_of("record_id"), "refers_to": page_of("refers_to")})
