"""WARC archives with a Zstandard dictionary.

Each archive is a .warc.zst file: a skippable frame that holds the dictionary, then one Zstandard frame a record,
all compressed with that dictionary. The dictionary is trained on records of the archive itself; where they are too few
for that it is made of their own text, so every archive has one. Records have ids of their own, also where pages share
a page_id, which stands in a header of its own. Files go to the
shared folder through the file system that its path names; a task gives each file a name of its own and reports
it only when it is complete, and readers open reported files alone, so a lost or repeated task does no harm.

Of records with equal payloads of at least MIN_BYTES bytes, that with the least page_id is a response and the
others revisit it. The least ids combine on the map side; only payloads that occur more than once are joined back.

Defined cases: a null html is an empty payload; very long pages are one record each; rows that repeat the least
page_id of their payload are all responses; a null page_id comes after all others, and a response if its payload
has no other id; a null url is empty; an empty table writes nothing and gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, stored

MIN_BYTES = 0
#: Payload bytes after which a task begins the next archive, and what it holds in memory at most besides one record.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES, DICT_RECORDS, LEVEL = 64 << 10, 400, 6
#: Of a record as many bytes at most are shown to the dictionary builder.
DICT_RECORD_BYTES = 16 << 10

# fixed values of the WARC formats
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are named in this space of UUIDs.
NAMESPACE = uuid.NAMESPACE_URL


def _open(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "0", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record, told from all others by the archive and place in it, and of which page it is by a header of its own."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{place}')}>",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records: a trained one, or, where they are too few or too alike to train one, pieces of their own text.

    Either way it isn't empty: a frame's content may be any bytes, which compressors take as text that came before.
    """
    step = max(1, len(records) // DICT_RECORDS)
    shown = [r[:DICT_RECORD_BYTES] for r in records[::step]]
    if len(shown) >= 8:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, shown)) // 4), shown).as_bytes()
        except zstandard.ZstdError:
            pass
    # what is near the end is the cheapest to refer to, so the first record's beginning, which all share, comes last
    share = max(8, DICT_BYTES // len(shown))
    return b"".join(r[:share] for r in reversed(shown))[-DICT_BYTES:]


def archive(records: list[bytes]) -> bytes:
    """A skippable frame that holds the dictionary, then each record compressed with it, alone."""
    made = dictionary(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_MAGIC, len(made)) + made)
    pack = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(made))
    for r in records:
        out.write(pack.compress(r))
    return out.getvalue()


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open file."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    data = zstandard.ZstdCompressionDict(source.read(size))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=data).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) into folder; the archives (path, records) that are complete."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    long = F.octet_length("payload") >= min_bytes
    again = base.where(long).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    again = stored(again.select(F.col("sha").alias("_sha"), "first"), "repeated")
    joined = base.join(broadcast_if_small(again), (F.col("sha") == F.col("_sha")) & long, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = joined.select("page_id", "url", "payload", refers.alias("refers_to"))

    def save(records: list[bytes], name: str):
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        name = f"{name}.warc.zst"
        with system.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(archive(records))
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})

    def run(batches):
        held, size, name = [], 0, uuid.uuid4().hex
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for x in b.slice(at, 64).to_pylist():
                    held.append(record(x["page_id"], x["url"], x["payload"], x["refers_to"], f"{name}/{len(held)}", date))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield save(held, name)
                        held, size, name = [], 0, uuid.uuid4().hex
        if held:
            yield save(held, name)

    return stored(rows.mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record in the archives listed."""

    def number(told: str | None) -> int | None:
        return int(told) if told not in (None, "null") else None

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = _open(path)
                out: list[tuple] = []
                with system.open_input_file(place) as source:
                    for h, block in read_archive(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, told = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
                        if kind == "response" and (len(payload) != size or _digest(payload) != told):
                            raise ValueError(f"{path}: record {h['WARC-Record-ID']} is damaged")
                        out.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], size, told, kind, number(h.get("X-Refers-To-Page"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(spread).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10(pages: DataFrame) -> DataFrame:
    made = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
