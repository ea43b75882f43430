"""Archives and mails as trees of files: unpacked in place, member by member, under a cap of bytes.

Each row is one member or one refusal. A member is read in blocks and given up as soon as the tree has unpacked more
than its cap, so a small archive that unpacks without end costs the cap and no more. Equal members of
all files are one file: the first by path keeps it, the others refer to it.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAP, DEPTH, BLOCK = 64 << 20, 3, 1 << 16
MEMBER = "path string, member string, depth int, size long, sha256 string, status string, content binary"


class _Full(Exception):
    """The tree has unpacked its cap."""


class _Tree:
    def __init__(self, cap: int, depth: int):
        self.left, self.depth = cap, depth

    def open(self, name: str, data: bytes, depth: int) -> Iterator[tuple]:
        """(member, depth, bytes or None, status) of a file and all that is in it, depth first."""
        inside = self._members(name, data)
        if inside is None:
            yield name, depth, data, "ok"
        elif depth >= self.depth:
            yield name, depth, None, "too deep"
        else:
            for member, own, status in inside:
                if status == "ok":
                    yield from self.open(f"{name}!{member}", own, depth + 1)
                else:
                    yield f"{name}!{member}", depth + 1, None, status

    def _members(self, name: str, data: bytes) -> Iterator[tuple] | None:
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            return self._zip(data)
        if name.lower().endswith(".eml"):
            return self._mail(data)
        return None

    def _take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise _Full

    def _zip(self, data: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, NotImplementedError) as e:
            yield "", None, f"broken: {e}"
            return
        for info in archive.infolist():
            parts = info.filename.replace("\\", "/").split("/")
            if info.is_dir():
                continue
            if info.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                yield info.filename, None, "unsafe path"
            elif info.external_attr >> 28 == 0xA:  # the file type of a link
                yield info.filename, None, "link"
            elif info.flag_bits & 1:
                yield info.filename, None, "encrypted"
            else:
                out = bytearray()
                try:
                    with archive.open(info) as f:
                        while block := f.read(BLOCK):
                            self._take(len(block))
                            out += block
                except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError) as e:
                    yield info.filename, None, f"broken: {e}"
                    continue
                yield info.filename, bytes(out), "ok"

    def _mail(self, data: bytes) -> Iterator[tuple]:
        mail = email.message_from_bytes(data, policy=email.policy.default)
        for i, part in enumerate(mail.iter_attachments()):
            if part.get_content_type() == "message/rfc822":
                name, own = part.get_filename() or f"mail-{i}.eml", part.get_content().as_bytes()
            else:
                name, own = part.get_filename() or f"part-{i}", part.get_payload(decode=True) or b""
            self._take(len(own))
            if "/" in name or "\\" in name or name.startswith(".."):
                yield name, None, "unsafe path"
            else:
                yield name, own, "ok"


def expand(files: DataFrame, cap: int = CAP, depth: int = DEPTH) -> DataFrame:
    """(path, content binary) -> MEMBER: every file of every tree; ``status`` is ok or says why there is no content.

    A file that is no container is its own only member. When the cap is reached, what was unpacked so far stays and the last
    row says ``cap``. Null contents are empty files.
    """

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = _Tree(cap, depth)
                found = tree.open((path or "").rsplit("/", 1)[-1], data or b"", 0)
                while True:  # a row at a time: what follows is not unpacked before
                    try:
                        row = next(found, None)
                    except _Full:
                        row = ("", 0, None, "cap")
                    if row is None:
                        break
                    member, level, own, status = row
                    sha = None if own is None else hashlib.sha256(own).hexdigest()
                    yield pa.RecordBatch.from_pylist(
                        [{"path": path, "member": member, "depth": level, "size": None if own is None else len(own), "sha256": sha, "status": status, "content": own}],
                        pa.schema([("path", pa.string()), ("member", pa.string()), ("depth", pa.int32()), ("size", pa.int64()), ("sha256", pa.string()), ("status", pa.string()), ("content", pa.binary())]),
                    )
                    if status == "cap":
                        break

    return files.select("path", "content").mapInArrow(run, MEMBER)


def first_copies(members: DataFrame) -> DataFrame:
    """``members`` with ``copy_of``: of equal contents the first by path and member, null for that one and for refusals."""
    named = members.withColumn("full", F.concat_ws("!", "path", "member"))
    first = named.filter("sha256 is not null").groupBy("sha256").agg(F.min("full").alias("first"))
    return named.join(first, "sha256", "left").withColumn("copy_of", F.expr("if(first <> full, first, null)")).select(*members.columns, "copy_of")


def scan_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, sha256, kind) of all files below a folder, with real hashes; kind by the first bytes, else the suffix."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    magic = [(b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg")]
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    for head, name in reversed(magic):
        kind = F.when(F.substring("content", 1, len(head)) == F.lit(head), name).otherwise(kind)
    return rows.select(F.url_decode("path").alias("path"), F.url_decode(F.substring_index("path", "/", -1)).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a ``key``, the last by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
