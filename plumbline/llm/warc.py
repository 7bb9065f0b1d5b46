"""WARC archives: written as whole gzip streams, normalised to a member for each record with an offset index, read back.

Payloads that are equal are stored once: the record of the largest page id is the response, the others are revisits
that refer to it and keep its digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.runtime import materialize, release, scratch_path
from plumbline.sources.store import delete, open_input, open_output

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that are inflated at a time; deflate makes 1032 times as many at most.
PIECE = 1 << 16
#: An entry of the sidecar index: offset and length of the member, length of the inflated record.
ENTRY = struct.Struct("<QQQ")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.rsplit(":", 1)[1].rstrip(">")
    return None if name == "none" else int(name)


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def header_value(text: str | None) -> str:
    """A header's value in one line: what could end the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def build_record(page_id, url, digest: str, length: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """A response record with the payload, or, without one, a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, dict, bytes]:
    """(record's headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def records_in(stream):
    """The records, as bytes, of a gzip file of one or more members: one pass, holding one record at a time."""
    inflate, held, ended = zlib.decompressobj(31), bytearray(), False
    while not ended or held:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            at = held.find(b"\r\nContent-Length: ", 0, end)
            size = end + 4 + int(held[at + 18 : held.find(b"\r\n", at + 18)]) + 4
            if len(held) >= size:
                yield bytes(held[:size])
                del held[:size]
                continue
        if ended:
            raise ValueError("the archive ends within a record")
        data = stream.read(PIECE)
        ended = not data
        while data:
            held += inflate.decompress(data)
            data = b""
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)


def normalise(source: str, target: str, level: int = 4) -> tuple[int, int]:
    """Inflate a whole gzip archive once, write every record as a member of its own and the index beside it.

    Returns (records, bytes). The index, target + ".idx", has an ENTRY for each record.
    """
    n = at = 0
    with open_input(source) as stream, open_output(target) as out, open_output(target + ".idx") as index:
        for record in records_in(stream):
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = deflate.compress(record) + deflate.flush()
            out.write(member)
            index.write(ENTRY.pack(at, len(member), len(record)))
            at += len(member)
            n += 1
    return n, at


def read_member(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return zlib.decompress(file.read(length), 31)


def read_index(uri: str):
    with open_input(uri + ".idx") as f:
        return list(ENTRY.iter_unpack(f.read()))


FACTS = "page_id long, url string, sha1 string, length long, spool string, at long, size long"


def spool_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """FACTS of every page, written: its payload's SHA-1 and length, and where the payload lies, deflated, in a file of
    its task in the shared store. So payloads stay where they were read, and only facts move between executors. Ids are whole
    numbers; any other type is a ValueError."""
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    folder = scratch_path(pages.sparkSession, "spool")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    body = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))

    def run(batches):
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.z"
        out, at = None, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out = out or open_output(path)
                rows = []
                for data in part.column(2):
                    data = data.as_py()
                    held = zlib.compress(data, 1)
                    out.write(held)
                    rows.append((hashlib.sha1(data).hexdigest(), len(data), path, at, len(held)))
                    at += len(held)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=[x.split()[0] for x in FACTS.split(", ")])
        if out is not None:
            out.close()

    return materialize(body.mapInArrow(run, FACTS), "page-facts")


def page_records(facts: DataFrame, min_bytes: int = 0) -> DataFrame:
    """FACTS with keep and stored: what each record holds. Equal payloads of min_bytes at least are found by SHA-1 and
    length; keep is their largest page id, and only its records are stored with their payload."""
    kept = facts.where(F.col("length") >= min_bytes).groupBy("sha1", "length").agg(F.max("page_id").alias("keep"))
    # written before it is joined: then both sides are plain shuffles, whose hot digests can be split
    kept = materialize(kept, "kept")
    told = facts.join(kept, ["sha1", "length"], "left")
    stored = (F.col("length") < min_bytes) | F.col("page_id").eqNullSafe(F.col("keep"))
    return told.withColumn("stored", stored)


MANIFEST = "path string, n long, bytes long"


def write_archives(records: DataFrame, level: int = 1) -> DataFrame:
    """Write the records of each spool file as one gzip stream; the manifest of the archives, written too. The spool
    files go."""
    folder = scratch_path(records.sparkSession, "warc")
    columns = ["page_id", "url", "length", "sha1", "keep", "stored", "spool", "at", "size"]

    def run(batches):
        source = spool = path = out = deflate = None
        n = size = 0

        def end():
            data = deflate.flush()
            out.write(data)
            out.close()
            spool.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size + len(data)])], names=["path", "n", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, length, sha1, keep, stored, own, at, held = (batch.column(j)[i].as_py() for j in range(9))
                if own != source:
                    if out is not None:
                        yield end()
                    source, spool = own, open_input(own)
                    path = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
                    out, deflate, n, size = open_output(path), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                payload = None
                if stored:
                    spool.seek(at)
                    payload = zlib.decompress(spool.read(held))
                data = deflate.compress(build_record(page_id, url, base32_sha1(sha1), length, payload, keep))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            yield end()

    # a task for each spool file, if their names fall so; without a number so small a table would go to one task
    files = max(1, records.select("spool").distinct().count())
    dealt = records.select(*columns).repartition(files, "spool").sortWithinPartitions("spool", "at")
    out = materialize(dealt.mapInArrow(run, MANIFEST), "warc-whole")
    _remove(records.select(F.col("spool").alias("path")).distinct())
    return out


def _remove(paths: DataFrame) -> None:
    """Delete the files; a task that runs twice finds some gone, which is no error."""

    def remove(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                delete(source)
            yield batch

    paths.select("path").mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()


def _spread(manifest: DataFrame) -> DataFrame:
    """The paths, over as many tasks as there are files: without a number, so small a table would go to one task."""
    return manifest.select("path").repartition(max(1, manifest.count()), "path")


def normalise_archives(manifest: DataFrame, level: int = 4) -> DataFrame:
    """Normalise every archive of a manifest, one to a task; the new manifest, written too. The whole streams go."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = source.replace("/whole-", f"/records-{uuid.uuid4().hex}-")
                n, size = normalise(source, target, level)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n]), pa.array([size])], names=["path", "n", "bytes"])

    out = materialize(_spread(manifest).mapInArrow(run, MANIFEST), "warc-records")
    _remove(manifest)
    return out


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, found by their index: READ, payload null for revisits or without payloads.

    The digest of a stored payload is computed anew and must be the one in the header.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    entries = read_index(path)
                    for s in range(0, len(entries), 256):
                        yield of([read_member(file, offset, length) for offset, length, _ in entries[s : s + 256]])

    def of(records):
        out = []
        for data in records:
            headers, http, payload = parse_record(data)
            kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
            length = int(http["Content-Length"])
            stored = kind == "response"
            if stored and (base32_sha1(hashlib.sha1(payload).hexdigest()) != digest or len(payload) != length):
                raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
            refers = page_of(headers["WARC-Refers-To"]) if not stored else None
            out.append((page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], length, digest, kind, refers, payload if stored and payloads else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in READ.split(", ")])

    return _spread(manifest).mapInArrow(run, READ)


def archive_pages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives of pages, normalise them and return the manifest of the normalised files.

    Nulls: a null html is an empty payload, a null url an empty URI; a null page id is kept and never the largest
    beside others. Rows that repeat the largest page id and its payload are all responses. Empty table: no archive.
    A payload is held whole by a task; a file is not. Other columns are not read.
    """
    facts = spool_pages(pages, id_col, url_col, html_col)
    told = materialize(page_records(facts, min_bytes), "page-records")
    release(pages.sparkSession, facts)
    whole = write_archives(told)
    release(pages.sparkSession, told)
    return normalise_archives(whole)
