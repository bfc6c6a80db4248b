"""Dictionary-compressed WARC archives, and their reader.

An archive (``.warc.zst`` layout) begins with a skippable frame (magic
0x184D2A5D) that holds a Zstandard dictionary trained on a sample of the
archive's own records; then every record is a frame of its own, compressed
with that dictionary. The last eight bytes open a skippable frame of one byte:
the newline that Spark's text writer puts after a row. So archives are written
by Spark's own committer to any file system it knows, and a lost executor's
files are written anew.

Of records with equal payloads the one with the largest id is a ``response``;
the others are ``revisit`` records that refer to it and carry no payload.

Defined cases: a null html is an empty payload; a null url has no target URI;
a null id is a revisit wherever an id has its payload, else a response; ids
on several rows, and null ones, get record ids of their own for each row;
repeated rows with the largest id are all responses; an empty table gives an
empty archive set and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, read_table, stored

DICTIONARY_FRAME = 0x184D2A5D
CLOSING = struct.pack("<II", 0x184D2A50, 1)
#: Raw bytes of an archive, of its dictionary's sample, and of the dictionary.
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
#: Length of a chunk of the sample.
CHUNK_BYTES = 4096
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, nth: str = "") -> str:
    """The id of a page's record; ``nth`` tells the records of a page id that several rows have apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{nth}')}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, nth: str = "", told: bool = True) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit, which names that record's id where one record is ``told`` by it."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, nth)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", _PROFILE)] + [("WARC-Refers-To", record_id(refers_to))] * told + [("X-Refers-To-Page-Id", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def sampled(records: list[bytes]) -> list[bytes]:
    """The records, or where they exceed SAMPLE_BYTES chunks of them, evenly spread over all their bytes."""
    total = sum(map(len, records))
    if total <= SAMPLE_BYTES:
        return records
    n = max(1, SAMPLE_BYTES // CHUNK_BYTES)
    out, k, start = [], 0, 0
    for r in records:
        while k < n and k * total // n < start + len(r):
            at = k * total // n - start
            out.append(r[at : at + CHUNK_BYTES])
            k += 1
        start += len(r)
    return out


def trained(records: list[bytes]) -> bytes:
    """A dictionary from a sample of the records; too few to train on are used as they are."""
    total, sample = sum(map(len, records)), sampled(records)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 20)), sample, k=64, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:4096]


def archive(records: list[bytes]) -> bytes:
    words = trained(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    info = b"software: corpusloom\r\nformat: WARC file version 1.1\r\n"
    first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (
        str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(words).hexdigest())).encode(), DATE.encode(), len(info)) + info + b"\r\n\r\n"
    head = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words
    return head + b"".join(packer.compress(r) for r in [first, *records]) + CLOSING


def read_archive(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    stream = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    reader = io.BufferedReader(stream, 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := reader.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = reader.read(int(head["Content-Length"]))
        reader.read(4)
        yield head, block


def with_reference(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``_to``: the id that a page's record refers to, null for responses; ``_many`` and ``_to_many``: whether the page's id and that one are on several rows (a null id is)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_bytes"))
    often = keyed.where(F.col("_bytes") >= least_bytes).groupBy("_sha").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
    often = stored(often.where("_n > 1").select("_sha", "_top"), "warc-copies")
    to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_top")), F.col("_top"))
    rows = keyed.join(often, "_sha", "left").select("page_id", "url", "html", to.alias("_to"))
    many = stored(keyed.where("page_id is not null").groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("_id")), "warc-ids")
    on = lambda c: many.select(F.col("_id").alias(c), F.lit(True).alias(c + "_many"))
    rows = rows.join(on("_to"), "_to", "left").join(on("page_id"), "page_id", "left")
    return rows.select("page_id", "url", "html", "_to", (F.col("page_id").isNull() | F.col("page_id_many").isNotNull()).alias("_many"), F.col("_to_many").isNotNull().alias("_to_many"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``, one file each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n, context = [], 0, 0, TaskContext.get()
        part = context.partitionId() if context else 0
        for batch in batches:
            ids, tos = batch["page_id"].tolist(), batch["_to"].tolist()
            for page_id, url, html, to, many, to_many in zip(ids, batch["url"], batch["html"], tos, batch["_many"], batch["_to_many"]):
                page_id, to = (None if x is None or x != x else int(x) for x in (page_id, to))
                n += 1
                held.append(record(page_id, url, (html or "").encode(), to, f":{part}:{n}" if many else "", not to_many))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"blob": [archive(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"blob": [archive(held)]})

    blobs = with_reference(pages, least_bytes).mapInPandas(run, "blob binary")
    # the cast keeps the bytes as they are; one row is one file
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, block in read_archive(data):
                    kind = head["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError("a payload differs from its digest")
                    rows.append((number(head.get("X-Page-Id")), head.get("WARC-Target-URI"), size, digest, kind, number(head.get("X-Refers-To-Page-Id"))))
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInPandas(run, schema)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


#: DuckDB has SHA-1 as hex only; base 32 is taken from its bits, five at a time.
ORACLE = """
with p as (
  select page_id, coalesce(octet_length(encode(html)), 0)::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
m as (select *, max(page_id) over (partition by h) as top from p),
d as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' order by k) as payload_digest from (
  select h, k, sum(case when (instr('0123456789abcdef', substr(h, (5 * k + b) // 4 + 1, 1)) - 1) & (8 >> ((5 * k + b) % 4)) > 0 then 16 >> b else 0 end)::int as v
  from (select distinct h from p), range(32) r(k), range(5) q(b) group by h, k) group by h)
select m.page_id, m.payload_bytes, d.payload_digest, case when m.page_id = top then 'response' else 'revisit' end as record_type,
  case when m.page_id = top then null else top end as refers_to
from m join d using (h)
"""
