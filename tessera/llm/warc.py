"""WARC archives compressed record by record with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records to archive. Each file begins with a skippable frame that
holds it, and each record is a frame of its own, so a reader needs the file alone and can seek to any record. Equal
payloads are archived once: the row of the smallest id is the response, the others are revisits that refer to it.

Every task writes the records of its partition to one file, under a name of its own that it renames when the file
is whole, and returns the file's row of the manifest; a task that runs again replaces its file. Readers take the
files that the manifest names. Paths are opened through Arrow's file systems, as the shared folder's URI says.

Null payloads are empty (and equal to each other); null URLs are left out of the record. Rows without an id are
archived, never referred to unless no equal row has an id (then the reference is null). Repeated rows: those of the
smallest id are responses each. An empty table gives no files and no rows. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, qualified, stored, table

#: Fixed value: magic number of the skippable frame that holds a file's dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Rows the dictionary is built from, the longest part of a record it takes, and its size in bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 64 << 10
LEVEL = 3
#: A file is closed beyond this size and another begun, so that readers can take a file as a whole.
FILE_BYTES = 64 << 20


def sha1_base32(payload: bytes) -> str:
    """The payload's digest as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers and its payload as far as it has one; a response's payload is checked with its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(field: str) -> int | None:
        text = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To") if kind == "revisit" else None,
    }


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; empty where they are too few or too small for one."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, ``refers_to`` and ``revisit`` of the rows whose payload a row of a smaller id has as well.

    Only ids and digests are grouped; a digest's smallest id is combined before it is moved, and written before it is
    joined, so that a frequent digest's rows can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = stored(pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("size")), "digests")
    first = stored(marks.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return marks.where(F.col("size") >= min_revisit_bytes).join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes page_id, url and html of all rows to files under ``path``, in the file system that Spark takes it to be
    in; returns the manifest: file, records, bytes."""
    path = qualified(pages.sparkSession, path)
    revisits = plan_records(pages, min_revisit_bytes).withColumnsRenamed({"page_id": "own_id", "digest": "own_digest"})
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    chosen = [r.page_id for r in pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    rows = pages.where(F.col("page_id").isin(chosen)).select("page_id", "url", F.substring(payload, 1, SAMPLE_BYTES).alias("part")).limit(2 * SAMPLE).collect() if chosen else []
    rows.sort(key=lambda r: (r.page_id is not None, r.page_id or 0, r.part))
    dictionary = build_dictionary([record(r.page_id, r.url, bytes(r.part), sha1_base32(bytes(r.part)), None, False) for r in rows])
    digest = F.unhex(F.sha1(payload))
    joined = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest")).join(
        revisits, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left"
    ).select("page_id", "url", "payload", "digest", "refers_to", F.col("own_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(path)
        system.create_dir(top, recursive=True)
        context = TaskContext.get()
        made, out, name, held, count = [], None, "", 0, 0
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)

        def close() -> None:
            out.close()
            system.move(f"{top}/{name}.{context.taskAttemptId()}", f"{top}/{name}")
            made.append((name, count, held))

        for batch in batches:
            for page_id, url, body, mark, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{len(made):03d}.warc.zst"
                    out, held, count = system.open_output_stream(f"{top}/{name}.{context.taskAttemptId()}"), 0, 0
                    held += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                held += out.write(packer.compress(record(page_id, url, body, base64.b32encode(mark).decode(), refers_to, revisit)))
                count += 1
                if held >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return stored(joined.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def read_file(raw: bytes) -> Iterator[bytes]:
    """The records of a file."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]) if size else None)
    rest, at = memoryview(raw), 8 + size
    while at < len(raw):
        one, step, data = unpacker.decompressobj(), 1 << 15, b""
        while not one.eof:
            if at >= len(raw):
                raise ValueError("the last record is cut off")
            data += one.decompress(rest[at : at + step])
            at = min(len(raw), at + step) - len(one.unused_data)
        yield data


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files: page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    path = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(path)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{top}/{name}") as f:
                    raw = f.read()
                held, size, seen = [], 0, 0
                for one in read_file(raw):
                    held.append(parse(one))
                    size += len(one)
                    seen += 1
                    if size > 8 << 20:
                        yield _batch(held, kinds)
                        held, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} of {records} records")
                if held:
                    yield _batch(held, kinds)

    # a number of partitions that is named isn't coalesced by the few bytes that names of files have
    files = max(1, manifest.count())
    return manifest.select("file", "records").repartition(files, "file").mapInArrow(run, schema)


def _batch(rows: list[dict], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(rows[0], kinds, strict=True)], names=list(rows[0]))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Archives all pages and returns what the archives hold."""
    path = fresh_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
