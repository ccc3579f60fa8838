"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing: each task fills archives of about ``roll_bytes`` in the shared folder and
reports them in a manifest; a file from a task attempt that was lost isn't in the
manifest and so is never read.  Reading: a task opens the archives of its manifest rows
as streams, loads the dictionary, decodes frame after frame, and raises on a bad magic
number, header, length, digest or frame border.

The dictionary is trained on the first bytes of a sample of payloads, SAMPLE_ROWS in the order
of a hash of their ids, so it is the same whenever the table is.

Payloads may be null (taken as empty) and of any length; a worker holds a payload and its
compressed frame, and 256 rows at a time.  Record ids may repeat or be null; repeated rows each
get a record.  Further columns, whatever their names, are ignored.  An empty table gives no
archives and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of the format.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2000-01-01T00:00:00Z"

#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100

#: The dictionary is trained on so many payloads at most, so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 32768


class WarcError(ValueError):
    """An archive breaks the format."""


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A Zstandard dictionary; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p[:SAMPLE_BYTES] for p in payloads if p]).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **given)


def record(record_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record; a revisit has the headers of its response but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = quote(uri or "", safe="!#$%&'()*+,/:;=?@[]~")
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {STAMP}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; raises :class:`WarcError` where header or lengths don't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION or not gap:
        raise WarcError(f"not a record: {raw[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing or not fields["content-length"].isdigit():
        raise WarcError(f"header lacks {sorted(missing)} or a length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block should have {length} bytes and an empty line after it")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise WarcError("the block has no HTTP header")
    said = int(dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:])[b"content-length"])
    kind, (algorithm, _, digest) = fields["warc-type"], fields["warc-payload-digest"].partition(":")
    if algorithm != "sha256" or kind not in ("response", "revisit"):
        raise WarcError(f"unknown digest or type: {algorithm}, {kind}")
    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit has a payload or refers to nothing")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x[len("<urn:page:") : -1] else None
    return {
        "record_id": number(fields["warc-record-id"]),
        "uri": fields.get("warc-target-uri", ""),
        "payload": payload if kind == "response" else None,
        "payload_bytes": said,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def read_archive(stream, chunk: int = 1 << 16) -> Iterator[dict]:
    """The records of one archive, read front to back; memory holds one record and one chunk."""
    head = stream.read(8)
    if len(head) != 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
        raise WarcError("the archive doesn't begin with a skippable frame")
    size = struct.unpack("<II", head)[1]
    packed = stream.read(size)
    if len(packed) != size:
        raise WarcError("the dictionary is cut off")
    if packed[:4] == struct.pack("<I", FRAME):
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    if packed and packed[:4] != struct.pack("<I", DICTIONARY):
        raise WarcError("not a Zstandard dictionary")
    reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(packed)} if packed else {}))
    rest = b""
    while rest or (rest := stream.read(chunk)):
        while len(rest) < 4 and (more := stream.read(chunk)):
            rest += more
        if rest[:4] != struct.pack("<I", FRAME):
            raise WarcError(f"no frame where one should begin: {rest[:4]!r}")
        one, parts, data = reader.decompressobj(), [], rest
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                break
            if not (data := stream.read(chunk)):
                raise WarcError("the last frame is cut off")
        rest = one.unused_data
        yield parse_record(b"".join(parts))


def with_revisits(records: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``records`` (record_id, uri, payload) with digest, bytes and refers_to.

    Of equal payloads of at least ``least`` bytes the smallest record_id is the
    response, and every record with another id refers to it.
    """
    body = F.coalesce(F.encode(F.col("payload"), "utf-8"), F.lit(b""))
    rows = records.select("record_id", "uri", body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    slim = rows.where(F.col("bytes") >= least).select("record_id", "digest")
    first = slim.groupBy("digest").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = slim.join(first.drop("n"), "digest").where("record_id is null or record_id <> first").select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    on = rows.record_id.eqNullSafe(again._id) & (rows.digest == again._digest)
    return rows.join(again, on, "left").select("record_id", "uri", "payload", "digest", F.col("first").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, dictionary: bytes, roll_bytes: int = 1 << 24) -> DataFrame:
    """Writes (record_id, uri, payload, digest, refers_to); the manifest: path, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, head = _compressor(dictionary), dictionary_frame(dictionary)
        store, base = pafs.FileSystem.from_uri(folder)
        out, path, count, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count, size))
                out = None

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256).to_pydict()
                for number, uri, payload, refers_to, digest in zip(*(part[c] for c in ("record_id", "uri", "payload", "refers_to", "digest")), strict=True):
                    frame = packer.compress(record(number, uri, payload, refers_to, digest))
                    if out is None:
                        path, count, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, len(head)
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(path)
                        out.write(head)
                    out.write(frame)
                    count, size = count + 1, size + len(frame)
                    if size >= roll_bytes:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["path", "records", "bytes"]), preserve_index=False)

    return records.mapInArrow(write, "path string, records long, bytes long")


RECORDS = "record_id long, uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, columns: str = RECORDS) -> DataFrame:
    """The records of the archives that ``manifest`` lists; ``columns`` may leave out some fields, such as the payload."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in columns.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, said in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for x in read_archive(stream):
                        rows.append({c: x[c] for c in names})
                        seen, size = seen + 1, size + (len(x["payload"] or b"") if "payload" in names else 0)
                        if len(rows) >= 4096 or size > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if seen != said:
                    raise WarcError(f"{path} has {seen} records, not {said}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path", "records").repartition("path").mapInArrow(read, columns)


def sample_of(records: DataFrame) -> list[bytes]:
    """The first bytes of SAMPLE_ROWS payloads at most, of different ids, in the order of a hash of the id; only hashes below a bound that leaves some half more go to the driver."""
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(records.count(), 1))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(3), "record_id"), 2)
    head = F.coalesce(F.substring("payload", 1, SAMPLE_BYTES), F.lit(""))
    found = records.select(order.alias("order"), head.alias("head")).where(F.col("order") <= int(share * (1 << 62)))
    rows = found.groupBy("order").agg(F.min("head").alias("head")).collect()
    return [r.head.encode() for r in sorted(rows, key=lambda r: r.order)[:SAMPLE_ROWS]]


def round_trip(records: DataFrame, columns: str = RECORDS) -> DataFrame:
    """Writes ``records`` (record_id, uri, payload string) as archives and reads them back."""
    scratch = Scratch(records.sparkSession, "warc")
    sample = sample_of(records)
    folder = f"{scratch.path}/archives"
    manifest = scratch.write(write_archives(with_revisits(records), folder, train_dictionary(sample)), "manifest")
    return read_archives(manifest, folder, columns)


def decode_bytes(data: bytes) -> list[dict]:
    """The records of an archive held in memory."""
    return list(read_archive(io.BytesIO(data)))
