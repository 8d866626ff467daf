"""WARC archives in Zstandard: one dictionary frame, then one frame per record.

Pages are written as ``response`` records, or as ``revisit`` records where an
equal payload is stored elsewhere, each compressed as a frame of its own with a
dictionary that leads the archive in a skippable frame. The reader loads that
dictionary, decodes frame after frame, and checks versions, headers, lengths
and digests; a damaged archive raises ``WarcError`` with its path and position.

Archives are written by the tasks to the folder that the cluster shares. A
repeated task writes files of other names, and only the files named in the
stored manifest count, so a lost executor leaves no half archive behind.

Defined cases: a null html is the empty payload; of records with equal payloads
of ``REVISIT_BYTES`` at least, that with the largest ``page_id`` is the response
and the others revisit it (rows that repeat this id and payload are responses
too); smaller payloads are always responses; a null url leaves the target out; a
null id is written as such and never refers or is referred to unless alone; an
empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deeptime.llm.common import fresh_path, hash_share, id_text, stored

#: Fixed values of the Zstandard and WARC formats: the dictionary's skippable frame, a data frame, the version line.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: The dictionary is trained on this many pages at most, and their first bytes up to the second figure.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4096, 32 << 10

RECORDS_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _open(path: str, mode: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_stream(inner)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages, chosen by their id's hash; empty if too few."""
    import zstandard

    n = pages.count()
    share = 1.0 if n <= SAMPLE_PAGES else 2.0 * SAMPLE_PAGES / n
    rows = (
        pages.filter(hash_share("page_id", share))
        .select(F.xxhash64(id_text("page_id")).alias("h"), F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("t"))
        .orderBy("h", "t")
        .limit(SAMPLE_PAGES)
        .collect()
    )
    samples = [r.t.encode() for r in rows if r.t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 50 else b""
    except zstandard.ZstdError:  # too little or too uniform to learn from
        return b""


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with payload length, digest, record type and the response that a revisit refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"), html.alias("html")
    )
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = stored(large.filter("n > 1").drop("n"), "repeated-payloads")
    joined = rows.join(repeated, "payload_digest", "left")
    again = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), "html"
    )


def record_uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """The uncompressed bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The checked parts of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name in fields:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name] = value
    try:
        length = int(fields["Content-Length"])
        kind, uri, digest = fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Payload-Digest"]
    except (KeyError, ValueError) as e:
        raise WarcError(f"missing or bad header: {e}") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"content length {length} does not fit the record")
    http, sep, body = rest[:length].partition(b"\r\n\r\n")
    lengths = [line[16:] for line in http.decode().split("\r\n") if line.lower().startswith("content-length: ")]
    if not sep or len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError("bad HTTP header")
    size = int(lengths[0])
    if kind == "response":
        if size != len(body) or f"sha1:{hashlib.sha1(body).hexdigest()}" != digest:
            raise WarcError("payload differs from its length or digest")
    elif kind != "revisit" or body or "WARC-Refers-To" not in fields:
        raise WarcError(f"bad record of type {kind!r}")
    number = lambda u: int(u[10:-1]) if u[10:-1] else None
    return {
        "page_id": number(uri), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest.removeprefix("sha1:"),
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "html": body.decode() if kind == "response" else None,
    }


def read_frames(stream, step: int = 1 << 20):
    """Decoded frames of an archive read as a stream, one at a time."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise WarcError(f"leading frame is {magic:#x}, not a dictionary")
    raw = stream.read(size)
    if len(raw) != size:
        raise WarcError("dictionary is cut short")
    if raw[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    reader = zstandard.ZstdDecompressor(**options)
    data, count = stream.read(step), 0
    while data:
        while len(data) < 4 and (more := stream.read(step)):
            data += more
        if data[:4] != FRAME_MAGIC:
            raise WarcError(f"record {count}: no frame")
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(step)):
                raise WarcError(f"record {count}: frame is cut short")
        yield b"".join(parts)
        count += 1
        data = data or stream.read(step)


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"") -> DataFrame:
    """Write ``plan_records`` rows as archives; the stored manifest ``(path, n_records, n_bytes)``."""

    def run(batches):
        import zstandard

        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **options)
        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            html = batch.column(6)
            rows = zip(*(batch.column(k).to_pylist() for k in range(6)))
            for k, (page_id, url, _, digest, kind, refers_to) in enumerate(rows):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    out = _open(path, "w")
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                frame = packer.compress(build_record(page_id, url, html[k].as_py().encode(), digest, kind, refers_to))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return stored(records.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_html: bool = True) -> DataFrame:
    """The records of the archives in ``manifest(path, n_records, n_bytes)``, checked; as many tasks read as there are archives."""
    schema = RECORDS_SCHEMA if with_html else RECORDS_SCHEMA.rpartition(",")[0]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def run(batches):
        for batch in batches:
            for path, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, n = [], 0, 0
                with _open(path, "r") as stream:
                    try:
                        for data in read_frames(stream):
                            rows.append(parse_record(data))
                            n, held = n + 1, held + len(data)
                            if held > 4 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                    except WarcError as e:
                        raise WarcError(f"{path}, record {n}: {e}") from e
                if want != n:
                    raise WarcError(f"{path}: {n} records, {want} in the manifest")
                yield batch_of(rows)

    # a manifest's rows are tiny, so only a stated number of partitions keeps them apart: one archive for each task
    return manifest.select("path", "n_records").coalesce(1).repartition(max(1, manifest.count())).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives under ``folder`` and return their manifest."""
    spark: SparkSession = pages.sparkSession
    return write_archives(plan_records(pages), folder or fresh_path(spark, "warc"), train_dictionary(pages))


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM w
"""
