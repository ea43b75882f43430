"""Operator 8: WARC archives of one gzip member a record, read back by boundary chains.

Writing: one record per page; of pages with equal payloads of at least ``min_revisit`` bytes those with the
smallest page_id become ``response`` records and the others ``revisit`` records without payload, which name
the response and carry length and digest of the full payload. A task makes each record a gzip member of its
own and starts a new archive when the one at hand would exceed ``archive_bytes`` before compression, so an
archive is as large as that or as its only record. Spark's text writer puts the members down; its line
separator is the zero byte that ends a member of less than 16 MiB (a larger one is followed by a zero byte).

Reading: every archive is searched for all places where the version line stands with a readable
header, and for each of them the offset of its successor (header, block, two line ends) is
emitted. These candidates also hold version lines inside payloads. Pointer jumping from offset 0
(each candidate's successor doubles its reach in every round) then marks what is reachable from
the file's start, and only that is kept; bytes after a broken link are not records.

Defined cases: a null html is an empty payload; pages with a null page_id are responses unless an
equal payload has a page with an id; rows that repeat the smallest page_id are all responses; white space
and control characters in a url are percent-encoded; a null url is left out; an empty
table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, work_dir

VERSION = b"WARC/1.1\r\n"
MIN_REVISIT = 100
#: Bytes of an archive before compression; what one reading task holds.
ARCHIVE_BYTES = 1 << 26
_BAD = re.compile("[\x00-\x20\x7f-\x9f\u2028\u2029]")


def revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, first): ``first`` is the page that a revisit refers to, null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    # the first page of each payload: pre-aggregated, one row a digest
    first = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    own = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", own.cast("long").alias("first"))


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, first: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if first is not None else http + html
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Target-URI": None if url is None else _BAD.sub(lambda m: quote(m[0], safe=""), url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": None if first is None else f"<urn:page:{first}>",
        "WARC-Profile": None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items() if value is not None)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(pages: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, member): gzip members without the zero byte at their end; archives are numbered in each task."""

    def run(batches):
        archive, held = 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, first in zip(*(batch.column(i) for i in range(5))):
                record = _record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py())
                if held and held + len(record) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(record)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                rows.append((archive, (press.compress(record) + press.flush()).removesuffix(b"\0")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["archive", "member"])

    return revisits(pages, min_revisit).mapInArrow(run, "archive bigint, member binary")


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes archives below ``path``, in one folder for each number of archives in a task."""
    rows = members(pages, min_revisit, archive_bytes).select("archive", F.col("member").cast("string").alias("value"))
    rows.write.partitionBy("archive").option("lineSep", "\0").text(path)


_CANDIDATES = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()),
     ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _candidates(path: str, data: bytes, payloads: bool) -> Iterator[dict]:
    """Every place of a version line with a readable header, and where its record would end."""
    for m in re.finditer(re.escape(VERSION), data):
        end = data.find(b"\r\n\r\n", m.end())
        if end < 0:
            continue
        head = {}
        for line in data[m.end() : end].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon:
                break
            head.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
        if not head.get("content-length", "").isdigit():
            continue
        start, length = end + 4, int(head["content-length"])
        successor = start + length + 4
        if successor > len(data) or data[start + length : successor] != b"\r\n\r\n":
            continue
        block = data[start : start + length]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if head.get("warc-type") == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
            said = re.search(rb"(?i)content-length:\s*(\d+)", http)
            size = int(said[1]) if said else 0
        yield {
            "path": path, "offset": m.start(), "successor": successor, "size": len(data), "record_type": head.get("warc-type"),
            "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if payloads else None,
        }


def _reached(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates a chain from offset 0 reaches, by pointer jumping; offsets ascend."""
    n = len(offset)
    to = np.searchsorted(offset, successor)
    to[(to < n) & (offset[np.minimum(to, n - 1)] != successor)] = n  # leads to no candidate
    to = np.append(to, n)
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and offset[0] == 0
    for _ in range(max(1, n.bit_length() + 1)):
        mark[to[mark]] = True  # what is marked marks the end of its jump
        to = to[to]
    return mark[:n]


def _inflated(data: bytes) -> bytes:
    """An archive's bytes: all gzip members one after the other, or the data itself where it is not compressed.

    Zero bytes between members are passed over.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, member = [], 0, None
    while at < len(data):
        if member is None and not data[at]:
            at += 1  # padding between members
            continue
        member = member or zlib.decompressobj(31)
        piece = data[at : at + 65536]  # small ones, as what follows a member is copied
        out.append(member.decompress(piece))
        at += len(piece) - len(member.unused_data)
        member = None if member.eof else member
    if member:
        raise ValueError("archive ends within a gzip member")
    return b"".join(out)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*") -> DataFrame:
    """The records of all archives below ``path`` whose name fits ``pattern``, without those that only payloads contain."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def scan(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                # offsets are those of the archive's own bytes, before compression
                rows = list(_candidates(name, _inflated(data.as_py()), payloads))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CANDIDATES)

    schema = "path string, offset long, successor long, size long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
    found = files.mapInArrow(scan, schema)

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        keep = _reached(rows["offset"].to_numpy(), rows["successor"].to_numpy())
        return rows.filter(pa.array(keep))

    # a group is one archive, whose size the writer bounds
    return found.groupBy("path").applyInArrow(chain, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, payloads=False, pattern="part-*")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return back.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


SQL = f"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
firsts AS (
  SELECT *, sha256(html) AS digest, CASE WHEN n >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY html) END AS f FROM rows)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM firsts
"""
