"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: one uncompressed WARC file a task through Spark's text writer, whose line separator is
the record separator, so commits are atomic and any Hadoop file system does. Of records with
equal payloads the one with the smallest page_id is the ``response``, the others are ``revisit``
records that refer to it.

Reading: files are cut into blocks. For every place in a block that looks like a record header a
task emits the chain of record to successor until it leaves the block; pointer jumping from the
start of each file then tells which of these entries are real, which rejects headers that lie
inside payloads; at last each block is parsed from its real entry on.

Null html is the empty payload; null urls are left out; a null page_id is kept as null and never
is the response if another row has an equal payload. Rows equal in page_id and payload are all
responses. A table without rows gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import partitions, scratch, written

SEPARATOR = "\r\n\r\n"
#: Bytes of a block; bytes read beyond it at first; longest header.
BLOCK, AHEAD, HEADER = 8 << 20, 64 << 10, 1 << 20
#: Rows of the table of repeated payloads up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000

# The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)


def base32(hex40):
    """A 40-digit hexadecimal column in base32: 20 bits, four letters, at a time."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 1 + 5 * g, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) to WARC files under ``path``.

    Payloads of at least ``min_bytes`` bytes are deduplicated.
    """
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("n", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    repeated = written(
        given.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first"), "warc-repeats"
    )
    small = repeated.count() <= BROADCAST_ROWS
    joined = given.join(F.broadcast(repeated) if small else repeated, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), page("page_id"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page("first"))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(F.concat(http, body)).cast("string"), F.lit("\r\n\r\n"),
    )
    joined.select(F.concat(head, http, body).alias("value")).write.option("lineSep", SEPARATOR).text(path)


class _File:
    """Ranges of a file; local paths are opened, others go through pyarrow's file systems."""

    def __init__(self, uri: str):
        if uri.startswith("file:") or "://" not in uri:
            self.file = open("/" + uri.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(path)

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _header(buffer: bytes, at: int, more) -> tuple[int, int] | None:
    """Length of the header at ``at`` in ``buffer`` and the content's length; ``more(n)`` gives the n bytes from ``at`` on."""
    end = buffer.find(b"\r\n\r\n", at)
    if end < 0:
        buffer, at = more(HEADER), 0
        end = buffer.find(b"\r\n\r\n")
        if end < 0:
            return None
    found = LENGTH.search(buffer, at, end + 2)
    return (end + 4 - at, int(found[1])) if found else None


def _candidates(block: int):
    """A task function giving (path, block, at, leaves): for each possible record of a block where its chain leaves the block, -1 if it breaks."""

    def rows(batches):
        for b in batches:
            out = []
            for path, length, start in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("block").to_pylist()):
                with _File(path) as f:
                    stop = min(start + block, length)
                    data = f.read(start, min(stop + AHEAD, length))
                    leaves: dict[int, int] = {}
                    for at in reversed([m.start() for m in MAGIC.finditer(data) if m.start() < stop - start]):
                        found = _header(data, at, lambda n, at=at: f.read(start + at, min(start + at + n, length)))
                        if found is None:
                            continue
                        follow = start + at + found[0] + found[1] + len(SEPARATOR)
                        if follow <= length:
                            leaves[start + at] = follow if follow >= stop else leaves.get(follow, -1)
                    out += [(path, start, at, to, length) for at, to in leaves.items()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", "block", "at", "leaves", "length"])

    return rows


def _reachable(links: DataFrame) -> DataFrame:
    """path, block and at of the block entries that lie on the chain from the start of each file.

    Each round joins the entries known so far with the jumps, and the jumps with themselves, so
    the number of rounds is the logarithm of the blocks of the longest file.
    """
    targets = links.where("leaves >= 0 and leaves < length").select("path", F.col("leaves").alias("at")).distinct()
    nodes = written(links.where("at = 0").unionByName(links.where("at > 0").join(targets, ["path", "at"], "left_semi")), "warc-links")
    jumps = nodes.where("leaves >= 0 and leaves < length").select("path", "at", "leaves")
    reach = nodes.where("at = 0").select("path", "at")
    known = reach.count()
    while True:
        step = reach.join(jumps, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        reach = written(reach.union(step).distinct(), "warc-reach")
        size = reach.count()
        if size == known:
            return nodes.select("path", "block", "at").join(reach, ["path", "at"], "left_semi")
        known = size
        far = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("_to"))
        jumps = written(jumps.join(far, ["path", "leaves"]).select("path", "at", F.col("_to").alias("leaves")), "warc-jumps")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(value: str | None) -> int | None:
    name = (value or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def _parse(head: bytes, block: bytes) -> tuple:
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} has digest {own}, not {digest}")
        size = len(payload)
    else:
        size = int(LENGTH.search(http + b"\r\n")[1])
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")), payload


def read_archive(spark: SparkSession, path: str, with_payload: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """The records of the WARC files under ``path``; a chain that breaks before the end of its file is an error."""
    fields = RECORD + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("block")).repartition(partitions(spark), "path", "block")
    links = written(blocks.mapInArrow(_candidates(block_bytes), "path string, block long, at long, leaves long, length long"), "warc-candidates")

    def records(batches):
        for b in batches:
            for path, block, at, length in zip(*(b.column(c).to_pylist() for c in ("path", "block", "at", "length"))):
                out = []
                with _File(path) as f:
                    stop = min(block + block_bytes, length)
                    data, base = f.read(at, min(stop + AHEAD, length)), at
                    while at < stop:
                        if not MAGIC.match(data, at - base) or (found := _header(data, at - base, lambda n, at=at: f.read(at, min(at + n, length)))) is None:
                            raise ValueError(f"{path}: no record at {at}")
                        end = at + found[0] + found[1]
                        record = data[at - base : end - base] if end - base <= len(data) else f.read(at, end)
                        out.append(_parse(record[: found[0]], record[found[0] :])[: 6 + with_payload])
                        at = end + len(SEPARATOR)
                columns = list(zip(*out)) or [()] * (6 + with_payload)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in fields.split(", ")])

    entries = _reachable(links).join(links.select("path", "block", "at", "length"), ["path", "block", "at"]).repartition(partitions(spark), "path", "block")
    return entries.mapInArrow(records, fields)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path, with_payload, block_bytes)


#: DuckDB SQL for the rows that the round trip gives with ``min_bytes`` 0.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, regexp_replace(url, '[\\x00-\\x20\\x7f]', ' ', 'g') AS url, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(p.h, (1 + (i // 4) * 5)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
