"""WARC archives with one Zstandard dictionary each.

Every task packs its records into archives. An archive starts with a skippable frame that holds a
dictionary built from that archive's own records; each record after it is one Zstandard frame of its own,
so a reader can start at any record. Files go to the shared folder through Arrow's file systems and count
only once the manifest that names them is written, so a retried task leaves no half archive behind.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from termwright.llm.runtime import materialize, new_dir, partitions

#: The skippable frame of a WARC dictionary, and its record separator.
DICT_MAGIC = 0x184D2A5D
END = b"\r\n\r\n"
#: Payloads smaller than this are never revisits.
MIN_REVISIT = 100
ARCHIVE_BYTES = 24 << 20
DICT_BYTES = 32 << 10
#: Bytes of records a dictionary is built from, spread over the archive.
DICT_SAMPLE = 1 << 20
DICT_PART = 16 << 10


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response); only the ids and digests of payloads are shuffled by digest."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    light = materialize(rows.where(F.length("payload") >= min_revisit).select("page_id", "digest"), "digests")
    first = materialize(light.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n"), "first-records")
    again = light.join(first, "digest").where("page_id is null or page_id > first_id").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first_id").alias("refers_to")).distinct()
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Target-URI: {' '.join((url or _uri(page_id)).split())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    return "\r\n".join(head).encode() + END + body + END


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary from parts spread evenly over the archive; where there is too little to train on, the parts themselves are the dictionary."""
    every = max(1, sum(map(len, records)) // DICT_SAMPLE)
    parts = [r[i : i + DICT_PART] for r in records for i in range(0, len(r), DICT_PART)][::every]
    try:
        return zstd.train_dictionary(DICT_BYTES, parts)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(parts)[-DICT_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    if not records:
        return b""
    d = dictionary(records)
    packer = zstd.ZstdCompressor(level=level, dict_data=d)
    return struct.pack("<II", DICT_MAGIC, len(d.as_bytes())) + d.as_bytes() + b"".join(map(packer.compress, records))


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view, at, d = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        d = zstd.ZstdCompressionDict(bytes(view[8:at]))
    reader = zstd.ZstdDecompressor(**({"dict_data": d} if d else {}))
    while at < len(data):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(view[at : at + 65536]))
            at += 65536
        at = min(at, len(data)) - len(one.unused_data) if at <= len(data) else len(data) - len(one.unused_data)
        yield b"".join(out)


def parse(rec: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type, refers_to; a response's payload must match its digest."""
    head, _, rest = rec.partition(END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(END)
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:")) else None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write(resolved: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below folder; returns the written manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)

        def flush(recs: list[bytes]) -> pa.RecordBatch:
            data, path = archive(recs), f"{base}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(recs)], "bytes": [len(data)]})

        recs, size = [], 0
        for b in batches:
            for x in b.to_pylist():
                recs.append(record(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"], date))
                size += len(recs[-1])
                if size >= archive_bytes:
                    yield flush(recs)
                    recs, size = [], 0
        if recs:
            yield flush(recs)

    return materialize(resolved.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives a manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path) as f:
                    rows = list(map(parse, records_of(f.read())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages as archives and returns (manifest, folder).

    A null payload counts as empty; a null url becomes the record's own URI. Of equal payloads of at least
    100 bytes the smallest page_id is the response and rows with larger or null ids revisit it; a group with
    null ids only stays responses. Rows that repeat page_id and payload are all responses or all revisits.
    An empty table gives no archives. Other columns are ignored.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    return write(resolve(pages, id_col, url_col, payload_col), folder), folder
