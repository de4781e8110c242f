"""A WARC writer with a Zstandard dictionary, and its reader.

Every page becomes a WARC record.  Of records with equal payloads of at least
``min_bytes`` bytes, the one with the smallest page id is a response, which holds the
payload; the others are revisits, which point at it.  An archive (``.warc.zst``)
begins with a skippable frame that embeds the dictionary; then every record is a
Zstandard frame of its own, so that any record can be read alone.

The dictionary is trained on a bounded sample of the records: ``SAMPLE_RECORDS`` of them
by a hash, of each the header and the first ``SAMPLE_CHARS`` characters of the payload (what
pages share stands there), ``SAMPLE_BYTES`` in all.  Only training sees a sample; records
are written whole.  Where a table is too small to train on, archives have none.

Archives are written by the tasks themselves to the shared folder, each under a name
of its own attempt; the stored manifest lists only those of attempts that succeeded.

Defined cases: a null html is an empty payload; a null url is left out; repeated rows
with the smallest id are responses all; a null id is a record without id, last in
order; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm.common import cut, fresh_path, hash_sample

MIN_BYTES = 0
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 4 << 20
SAMPLE_CHARS = 4 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
ROLL_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed value: the skippable frame's magic number for dictionaries in WARC files.
DICTIONARY_MAGIC = 0x184D2A5D

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool, sha1: str) -> bytes:
    """The bytes of one WARC record.  A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    if is_revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(revisits)}")
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or nothing where the samples are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _sample(pages: DataFrame) -> list[bytes]:
    """Records to train on: the first by a hash of their ids, within all three bounds."""
    head = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("html")
    picked = hash_sample(pages.select("page_id", head), SAMPLE_RECORDS, pages.count(), "page_id")
    out, size = [], 0
    for r in picked.collect():
        out.append(record(r["page_id"], None, r["html"].encode(), None, False, digest(b"")))
        size += len(out[-1])
        if size > SAMPLE_BYTES:
            break
    return out


class Archive:
    """Writes records to one file, each in a frame of its own."""

    def __init__(self, stream: BinaryIO, trained: bytes):
        self.stream, self.size = stream, 0
        data = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        if trained:
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        info = b"software: topiloom\r\nformat: WARC File Format 1.1\r\n"
        name = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.add(name.encode() + info + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))


def read_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC header fields, block) of every record of an archive."""
    head = stream.read(8)
    trained, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        trained, rest = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1])), b""
    plain = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(_Joined(rest, stream), read_across_frames=True)
    held = b""
    while True:
        while b"\r\n\r\n" not in held:
            more = plain.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("an archive ends within a record")
                return
            held += more
        head, _, held = held.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        parts = [held]
        have = len(held)
        while have < size + 4:
            more = plain.read(max(1 << 16, size + 4 - have))
            if not more:
                raise ValueError("an archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        if held[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield fields, held[:size]
        held = held[size + 4 :]


class _Joined:
    """Some bytes already read, then the rest of a stream."""

    def __init__(self, first: bytes, stream: BinaryIO):
        self.first, self.stream = first, stream

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.stream.read(n)


def references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, sha1, response_id) of each distinct page id and payload."""
    own = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"), (F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).alias("_large")).distinct()
    first = own.where("_large").groupBy(F.col("sha1").alias("_sha1")).agg(F.min("page_id").alias("response_id"))
    on = (F.col("sha1") == F.col("_sha1")) & F.col("_large")
    return own.join(first, on, "left").select("page_id", "sha1", F.coalesce("response_id", "page_id").alias("response_id"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives in ``folder``; gives the stored
    manifest (path, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    trained = spark.sparkContext.broadcast(dictionary(_sample(rows)))
    refs = references(rows, min_bytes).select(F.col("page_id").alias("_page"), "sha1", "response_id").hint("shuffle_hash")
    keyed = rows.withColumn("_own", F.sha1(F.coalesce("html", F.lit(""))))
    typed = keyed.join(refs, keyed["page_id"].eqNullSafe(refs["_page"]) & (keyed["_own"] == refs["sha1"])).select("page_id", "url", "html", "sha1", "response_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = []
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive, stream = None, None

        def close() -> None:
            stream.close()
            files[-1][2] = archive.size

        for batch in batches:
            for page_id, url, html, sha1, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.size > ROLL_BYTES:
                    if archive is not None:
                        close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    stream = store.open_output_stream(f"{base}/{name}")
                    archive = Archive(stream, trained.value)
                    files.append([f"{folder}/{name}", 0, 0])
                is_revisit = page_id != response_id
                sha = base64.b32encode(bytes.fromhex(sha1)).decode()
                archive.add(record(page_id, url, (html or "").encode(), response_id, is_revisit, sha))
                files[-1][1] += 1
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files) if files else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(typed.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as stream:
                    out = []
                    for fields, block in read_archive(stream):
                        if fields["WARC-Type"] != "warcinfo":
                            out.append(_described(fields, block))
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, schema)

    # A task for every file: the number is given, so that adaptive execution does not join
    # them, and names are random, so that ranges of them part the files one from another.
    files = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(run, READ)


def _described(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    is_revisit = fields["WARC-Type"] == "revisit"
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not is_revisit and (digest(payload) != own or len(payload) != size):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _id(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": own if is_revisit else digest(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": _id(fields["WARC-Refers-To"]) if is_revisit else None,
    }


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages to a fresh folder and reads them back."""
    return read(write(pages, fresh_path(pages.sparkSession, "warc")))
