"""WARC archives of pages: a deterministic sharded writer and the reader that checks it.

Records are sorted by page and written as one gzip member each; a file is closed when its compressed size
reaches ROLL_BYTES. Of pages with equal payloads (of MIN_BYTES or more) the one with the smallest id is
stored as a response, the others as revisits of it that hold the HTTP header only. All headers, lengths
and digests are made anew from the payload, and the date is a parameter, so equal input gives equal files.

Defined cases: a null html is an empty payload; a null url leaves out the target; a page without an id
sorts first, can be a revisit, and is the response of no other page; rows that repeat id and payload are
alike: all are responses where the id is the smallest; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import shards
from topicloom.llm.common import table
from topicloom.llm.registry import query
from topicloom.session import materialize, maybe_broadcast

ROLL_BYTES = 8 << 20
MIN_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
READ_BYTES = 1 << 20
RECORDS_PER_BATCH = 2000

RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
                    ("offset", pa.int64())])
RESULT_DDL = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "file string, offset long")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, (kind, *parts))))}>"


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def one_line(url: str | None) -> str | None:
    """A url without the characters that would end a header line."""
    return None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info_record(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", DATE),
                   ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                   ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + END


def page_record(page_id, url, payload: bytes | None, size: int, sha1: str, refers_to, copy: int = 0) -> bytes:
    """``payload`` None: a revisit of page ``refers_to``. ``copy`` numbers records of equal page and payload, so
    that each has an id of its own."""
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = head + (payload or b"")
    revisit = payload is None
    return header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id("page", page_id, sha1, copy)),
        ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("X-Page-Id", page_id),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", record_id("page", refers_to, sha1, 0) if revisit else None),
        ("X-Refers-To-Page", refers_to), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block))]) + block + END


def base32_of_hex(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _write(batches, out: shards.ShardWriter, roll_bytes: int) -> None:
    shard, data, records, last, copy = None, bytearray(), 0, None, 0

    def close():
        nonlocal records
        if records:
            out.add(shard, ".warc.gz", bytes(data), records, records)
        data.clear()
        records = 0

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                close()
                shard = row["shard"]
            if not records:
                data += member(info_record(f"{shard:08d}-{out.parts.get(shard, 0):06d}.warc.gz"))
            payload = row["payload"]
            sha1 = digest(payload) if payload is not None else base32_of_hex(row["sha1"])
            copy = copy + 1 if (row["page_id"], sha1) == last else 0
            last = (row["page_id"], sha1)
            data += member(page_record(row["page_id"], row["url"], payload, row["size"], sha1, row["refers_to"], copy))
            records += 1
            if len(data) >= roll_bytes:
                close()
    close()


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """Folder and manifest of the archives of (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    facts = materialize(rows.select("page_id", "sha1", "size"), "warc-pages")
    first = (facts.filter(F.col("size") >= MIN_BYTES).groupBy("sha1")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
             .filter("copies > 1 AND first IS NOT NULL").select("sha1", "first"))
    rows = rows.join(maybe_broadcast(materialize(first, "warc-copies")), "sha1", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False))
    # A revisit takes no payload along.
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn(
        "payload", F.when(~revisit, F.col("payload"))).drop("first")
    rows, count = shards.with_shard(rows, facts, "page_id", "size", F.xxhash64("sha1"))
    return shards.write_shards(rows, count, ["page_id", "sha1", "url"],
                               partial(_write, roll_bytes=ROLL_BYTES), "warc")


def members(file):
    """(offset, bytes) of each gzip member of a file, read piece by piece."""
    offset, unpack, parts, rest = 0, zlib.decompressobj(31), [], b""
    used = 0
    while rest or (rest := file.read(READ_BYTES)):
        parts.append(unpack.decompress(rest))
        used += len(rest) - len(unpack.unused_data)
        rest = unpack.unused_data
        if unpack.eof:
            yield offset, b"".join(parts)
            offset += used
            used, parts, unpack = 0, [], zlib.decompressobj(31)
    if used:
        raise ValueError(f"the archive ends within a record at {offset}")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + len(END) or not rest.endswith(END):
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _read(row, file):
    found = []
    for offset, data in members(file):
        fields, block = parse(data)
        if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"{row['name']} at {offset}: the block differs from its digest")
        if fields["WARC-Type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and digest(payload) != sha1:
            raise ValueError(f"{row['name']} at {offset}: the payload differs from its digest")
        found.append({"page_id": _number(fields.get("X-Page-Id")), "payload_bytes": int(http["Content-Length"]),
                      "payload_digest": sha1, "record_type": fields["WARC-Type"],
                      "refers_to": _number(fields.get("X-Refers-To-Page")), "file": row["name"],
                      "offset": offset})
        if len(found) >= RECORDS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(found, schema=RESULT)
            found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema=RESULT)


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per page record, from the files."""
    return shards.read_shards(folder, manifest, _read, RESULT_DDL)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h,
        min(page_id) OVER (PARTITION BY sha1(html)) AS head FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''),
        lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111',
          4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT
    + 4 * substr(bits, 5 * i::INT + 3, 1)::INT + 2 * substr(bits, 5 * i::INT + 4, 1)::INT
    + substr(bits, 5 * i::INT + 5, 1)::INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM b
"""


@query("op10_warc", ORACLE)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back from the files."""
    return read_archives(*write_archives(table(spark, sf_dir, "pages"))).drop("file", "offset")
