"""WARC archives: written by tasks, read back sequentially.

Writing: every page is one record in its own gzip member.  Of records with
equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that refer to it
and hold no payload.  Which payloads repeat is found on their digests alone;
pages whose digest a Bloom filter clears go to the writer without a shuffle.
A task writes files of about ``FILE_BYTES`` below a folder that all executors
share (through pyarrow's filesystems, by URI), each under a name of its own
attempt first and then moved to its final name, so a repeated attempt
replaces the same file.

Reading: a file is read in sequence with bounded memory.  Each gzip member is
inflated step by step, the record's header gives the length of its block, and
the block's and the payload's SHA-256 are checked against the header; a
mismatch, a short block or bytes after a record are an error.

Cases: a null html is an empty payload; smaller payloads are always responses;
null page_ids sort after all others; rows that repeat a page_id with the same
payload are each a response or a revisit like the first of that id; an empty
table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialise

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20  # of records before compression
STEP = 1 << 16
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture


def with_decisions(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    url = F.col("`url`").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{key}`").alias("id"), url.alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256))
    digests = materialise(rows.select("id", digest.alias("digest")).where("digest is not null"))
    hashed = digests.withColumn("h", F.xxhash64("digest"))
    maybe = bloom.probe(hashed, "h", bloom.repeats_filter(hashed, "h"), "maybe")
    groups = materialise(maybe.where("maybe").groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    flagged = bloom.probe(rows.withColumn("digest", F.sha2("payload", 256))
                          .withColumn("h", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.xxhash64("digest"))),
                          "h", bloom.keys_filter(groups.select(F.xxhash64("digest").alias("h")), "h"), "maybe")
    columns = ["id", "url", "payload", "digest"]
    alone = flagged.where(~F.col("maybe")).select(*columns, F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    again = flagged.where("maybe").join(groups.withColumnRenamed("digest", "known"), F.col("digest") == F.col("known"), "left")
    again = again.select(*columns, F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return alone.unionAll(again)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, before compression."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Files:
    """The archive files of one task."""

    def __init__(self, folder: str, partition: int):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.partition, self.made, self.out = partition, [], None

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.partition:06d}-{len(self.made):05d}.warc.gz"
            self.own = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.raw, self.records = self.fs.open_output_stream(self.own, compression=None), 0, 0
        self.out.write(member(raw))
        self.raw += len(raw)
        self.records += 1
        if self.raw >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.own, f"{self.folder}/{self.name}")
            self.made.append((self.name, self.records))
            self.out = None


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Writes the archives; returns (name, records) of the files.  The result
    is checkpointed, so the files are written by this call and once."""

    def write(batches):
        from pyspark import TaskContext

        files = _Files(folder, TaskContext.get().partitionId())
        for batch in batches:
            for k in range(batch.num_rows):
                files.write(record(*(batch.column(c)[k].as_py() for c in range(5))))
        files.close()
        if files.made:
            names, records = zip(*files.made)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.int64())], names=["name", "records"])

    return materialise(with_decisions(pages, key, html).mapInArrow(write, "name string, records long"))


class MemberStream:
    """Bytes of the current gzip member, inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.raw, self.z, self.held = source, b"", None, b""

    def next_member(self) -> bool:
        if self.z is not None and (self.held or self._more()):
            raise ValueError("bytes after the record in a gzip member")
        if not self.raw:
            self.raw = self.source.read(STEP)
        self.z = zlib.decompressobj(31)
        return bool(self.raw)

    def _more(self) -> bool:
        while not self.held and not self.z.eof:
            if not self.raw:
                self.raw = self.source.read(STEP)
                if not self.raw:
                    raise ValueError("a gzip member ends early")
            self.held = self.z.decompress(self.raw, STEP)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return bool(self.held)

    def line(self) -> bytes:
        out = b""
        while not out.endswith(b"\r\n"):
            if not self._more():
                raise ValueError("a record's header ends early")
            k = self.held.find(b"\n")
            k = len(self.held) if k < 0 else k + 1
            out, self.held = out + self.held[:k], self.held[k:]
        return out[:-2]

    def take(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self._more():
                raise ValueError("a record's block ends early")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def read_records(source, with_payload: bool = False):
    """(page id, type, refers to, payload bytes, payload digest, payload) of
    each record of an open archive; ids are strings, the payload None unless asked for."""
    stream = MemberStream(source)
    while stream.next_member():
        if stream.line() != b"WARC/1.1":
            raise ValueError("no WARC record where one should start")
        head = {}
        while line := stream.line():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block, payload = hashlib.sha256(), hashlib.sha256()
        n, seen, http, kept, length = int(head["Content-Length"]), 0, b"", [], None
        for piece in stream.take(n):
            block.update(piece)
            if length is None:
                http += piece
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    continue
                fields = dict(x.split(b": ", 1) for x in http[:end].split(b"\r\n")[1:])
                length, piece = int(fields[b"Content-Length"]), http[end + 4:]
            payload.update(piece)
            seen += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        if f"sha256:{block.hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {head['WARC-Record-ID']} differs")
        if kind == "response" and (payload.hexdigest() != digest or seen != length):
            raise ValueError(f"payload digest of {head['WARC-Record-ID']} differs")
        own, other = (head.get(x, "").strip("<>").removeprefix(ID) or None for x in ("WARC-Record-ID", "WARC-Refers-To"))
        yield own, kind, other, length, digest, b"".join(kept) if with_payload and kind == "response" else None


def read_warc(files: DataFrame, folder: str, key_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Records of the files named in ``files``; each of its partitions reads
    its own files one after the other."""
    schema = "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string" + \
        (", payload binary" if with_payload else "")
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    n = 6 if with_payload else 5

    def read(batches):
        fs, top = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as source:
                    for r in read_records(source, with_payload):
                        rows.append(r)
                        held += len(r[5] or b"")
                        if len(rows) == 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:n], kinds)], names=names[:n])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:n], kinds)], names=names[:n])

    out = files.select("name").mapInArrow(read, schema)
    return out.withColumn("page_id", F.col("page_id").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))
