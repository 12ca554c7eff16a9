"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Archives are gzip members, one for each record, whose extra field names the member's
length. A reader's tasks take byte ranges of files, so they cannot trust a magic: a
payload may hold it. Every place with the magic is a candidate, and its header names the
place where its successor must begin. Tasks emit candidates with their successors; the
candidates of a range are reduced to where their chains leave it, and pointer jumping
over these exits finds where the chain from each file's start enters each range. Only
candidates on that chain are records. No file and no record need lie within one task.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm import common

#: Payloads shorter than this are stored in full each time.
LEAST_REVISITED = 100
#: Bytes in which a record's header must end.
MOST_HEADER = 1 << 16
CRLF = "\r\n"
MEMBER = struct.Struct("<3sBIBBHccHII")  # magic, flags, time, level, system, extra's size, its name, size, member's and content's length
RECORD = "page_id bigint, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
SCANNED = "path string, block bigint, at bigint, successor bigint, total bigint, cut boolean, " + RECORD
FOUND = RECORD + ", file string, offset bigint, whole boolean, cut boolean, successor bigint"


class Format(NamedTuple):
    """How records lie in a file: what they begin with, how long one is, and what it holds.

    ``size`` gets the bytes from a magic on and whether more can come; it gives the
    record's length, 0 if it is none, or None if that takes more bytes.
    """

    magic: bytes
    size: Callable[[memoryview, bool], int | None]
    content: Callable[[bytes], bytes]


def member(record: bytes) -> bytes:
    """One gzip member with its lengths in the extra field ``sl``."""
    packer = zlib.compressobj(6, wbits=-15)
    body = packer.compress(record) + packer.flush()
    head = MEMBER.pack(b"\x1f\x8b\x08", 4, 0, 0, 255, 12, b"s", b"l", 8, MEMBER.size + len(body) + 8, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_size(data: memoryview, more: bool) -> int | None:
    if len(data) < MEMBER.size:
        return None if more else 0
    _, flags, _, _, _, extra, s, l, n, size, _ = MEMBER.unpack_from(data)
    return size if (flags, extra, s, l, n) == (4, 12, b"s", b"l", 8) and size >= MEMBER.size + 10 else 0


def plain_size(data: memoryview, more: bool) -> int | None:
    start = bytes(data[:MOST_HEADER])
    end = start.find(b"\r\n\r\n")
    if end < 0:
        return None if more and len(start) < MOST_HEADER else 0
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", start[:end])
    return end + 4 + int(size[1]) + 4 if size and re.match(rb"WARC/1\.[01]\r\n", start) else 0


GZIP = Format(b"\x1f\x8b\x08", member_size, lambda data: zlib.decompress(data, wbits=31))
PLAIN = Format(b"WARC/1.", plain_size, bytes)
#: An empty member; it stands between two records, which standard readers skip.
SEPARATOR = member(b"").decode("latin-1")


def header(data: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = data.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def parse(data: bytes) -> tuple | None:
    """What RECORD names of one record's bytes; all null for nothing, None if it is no record."""
    if not data:
        return (None,) * 6
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = header(head)
    if not found or not head.startswith(b"WARC/1.") or not fields.get("content-length", "").isdigit() or len(rest) != int(fields["content-length"]) + 4:
        return None
    block, kind = rest[:-4], fields.get("warc-type")
    page, refers = fields.get("x-page-id"), re.search(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    revisit = kind == "revisit" and "x-payload-length" in fields and "warc-payload-digest" in fields
    size = int(fields["x-payload-length"]) if revisit else len(block)
    digest = fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(block).hexdigest()
    return int(page) if page else None, fields.get("warc-target-uri"), size, digest, kind, int(refers[1]) if refers else None


class Range:
    """The candidates of one byte range, found while its pieces between magics come in.

    Offsets are relative to where the range's first piece begins. Of the bytes, only
    those from the first candidate that is not complete are held.
    """

    def __init__(self, form: Format, path: str, block: int) -> None:
        self.form, self.path, self.block = form, path, block
        self.at, self.start, self.held = -len(form.magic), 0, bytearray()
        self.open: list[int] = []

    def feed(self, piece: bytes) -> list[tuple]:
        begins = self.block > 0 or self.at >= 0  # what comes before a file's first magic follows none
        if begins:
            if not self.open:
                self.held, self.start = bytearray(), self.at
            self.open.append(self.at)
        if self.open:
            self.held += self.form.magic + piece
        self.at += len(piece) + len(self.form.magic)
        return self.settle(True)

    def settle(self, more: bool) -> list[tuple]:
        """Rows of the candidates that can be judged now."""
        rows, still, data = [], [], memoryview(self.held)
        for at in self.open:
            own = data[at - self.start :]
            size = self.form.size(own, more)
            if size is None or (size > len(own) and more):
                still.append(at)
            elif size > len(own):
                rows.append((self.path, self.block, at, at + size, None, True, *(None,) * 6))
            elif size:
                fields = self.read(bytes(own[:size]))
                if fields is not None:
                    rows.append((self.path, self.block, at, at + size, None, False, *fields))
        data.release()
        self.open = still
        if not still:
            self.held = bytearray()
        return rows

    def read(self, data: bytes) -> tuple | None:
        try:
            return parse(self.form.content(data))
        except zlib.error:
            return None

    def finish(self) -> list[tuple]:
        """What is left, and one row with the bytes that the range's pieces span."""
        total = self.at + len(self.form.magic)
        return [*self.settle(False), (self.path, self.block, None, None, total, False, *(None,) * 6)]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


RECORD_FIELDS = [("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
SCANNED_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("successor", pa.int64()), ("total", pa.int64()), ("cut", pa.bool_()), *RECORD_FIELDS])
FOUND_SCHEMA = pa.schema([*RECORD_FIELDS, ("file", pa.string()), ("offset", pa.int64()), ("whole", pa.bool_()), ("cut", pa.bool_()), ("successor", pa.int64())])


def scan(form: Format):
    """Arrow function from the pieces of byte ranges to candidates with successors, and each range's span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Range | None = None
        for batch in batches:
            rows: list[tuple] = []
            for path, block, piece in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("piece")):
                if now is None or (now.path, now.block) != (path, block):
                    rows += now.finish() if now else []
                    now = Range(form, path, block)
                rows += now.feed(piece.as_py())
            yield from table_of(rows, SCANNED_SCHEMA).to_batches()
        if now:
            yield from table_of(now.finish(), SCANNED_SCHEMA).to_batches()

    return run


def exits(magic: int):
    """Function on one range's candidates: where the chain from each leaves the range (null if it breaks)."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("exit", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        end, found = max(x for x in rows.column("total").to_pylist() if x is not None) - magic, {}
        chain = sorted((a, s) for a, s in zip(rows.column("at").to_pylist(), rows.column("successor").to_pylist()) if a is not None)
        for at, successor in reversed(chain):
            found[at] = successor if successor >= end else found.get(successor)
        path, block = rows.column("path")[0].as_py(), rows.column("block")[0].as_py()
        return table_of([(path, block, at, out) for at, out in found.items()], schema)

    return run


def follow(magic: int):
    """Function on one range's candidates and its entry: the records on the chain."""

    def run(rows: pa.Table, entry: pa.Table) -> pa.Table:
        if not len(entry) or not len(rows):
            return table_of([], FOUND_SCHEMA)
        (at,), (base,), (whole,) = (entry.column(c).to_pylist() for c in ("entry", "base", "whole"))
        names = [n for n, _ in RECORD_FIELDS]
        held = {r["at"]: r for r in rows.to_pylist() if r["at"] is not None}
        out = []
        while r := held.get(at):
            if r["record_type"] is not None or r["cut"]:  # else it is an empty member
                out.append((*(r[n] for n in names), r["path"], base + at, whole, r["cut"], base + r["successor"]))
            at = r["successor"]
        return table_of(out, FOUND_SCHEMA)

    return run


def pieces(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """What lies between the magics of all files, each with its file and byte range, in order within a range."""
    files = spark.read.options(lineSep=form.magic.decode("latin-1"), encoding="ISO-8859-1", pathGlobFilter="[!_.]*").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def read_archives(spark: SparkSession, path: str, form: Format = GZIP) -> DataFrame:
    """All records of the archives in a folder, as RECORD with ``file``, ``offset`` and ``whole``.

    ``form`` is GZIP for what :func:`write_archives` writes or PLAIN for archives without
    compression. Of a file whose chain breaks, the records before the break come with
    ``whole`` false; other files are not concerned. Places off the chain give nothing,
    whatever they look like. An empty folder gives no rows.
    """
    magic = len(form.magic)
    rows = common.materialize(pieces(spark, path, form).mapInArrow(scan(form), SCANNED), "candidates")
    ranges = rows.where("total is not null").select("path", "block", "total")
    bases = common.materialize(ranges.withColumn("base", F.sum("total").over(Window.partitionBy("path").orderBy("block")) - F.col("total")), "ranges")
    ends = bases.groupBy("path").agg((F.sum("total") - magic).alias("end"), F.count("*").alias("ranges"))
    leaves = rows.groupBy("path", "block").applyInArrow(exits(magic), "path string, block bigint, at bigint, exit bigint")
    leaves = leaves.join(bases, ["path", "block"]).select("path", "block", "base", "at", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("exit")).alias("exit"))
    leaves = common.materialize(leaves, "exits")
    # places where a chain may enter a range, with where it leaves again: few for each range
    starts = ends.select("path", F.lit(0).cast("bigint").alias("offset"))
    doors = common.materialize(leaves.where("exit is not null").select("path", F.col("exit").alias("offset")).union(starts).distinct().join(leaves, ["path", "offset"]), "doors")
    reached, jump = common.materialize(starts, "reached"), doors.select("path", "offset", "exit")
    for _ in range((ends.agg(F.max("ranges")).first()[0] or 1).bit_length()):
        # after round k the pointers lead 2**k ranges ahead
        there = reached.join(jump, ["path", "offset"]).where("exit is not null").select("path", F.col("exit").alias("offset"))
        reached = common.materialize(reached.union(there).distinct(), "reached")
        twice = jump.select("path", F.col("exit").alias("offset"), F.col("offset").alias("from")).join(jump, ["path", "offset"])
        jump = common.materialize(twice.select("path", F.col("from").alias("offset"), "exit"), "jump")
    whole = ends.join(reached.withColumnRenamed("offset", "end"), ["path", "end"], "left_semi").select("path", F.lit(True).alias("whole"))
    entries = doors.join(reached, ["path", "offset"]).join(whole, "path", "left").select("path", "block", "base", F.col("at").alias("entry"), F.coalesce("whole", F.lit(False)).alias("whole"))
    found = rows.groupBy("path", "block").cogroup(entries.groupBy("path", "block")).applyInArrow(follow(magic), FOUND)
    found = common.materialize(found, "records")
    return with_cut(spark, path, form, found, bases).select("page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "whole")


def with_cut(spark: SparkSession, path: str, form: Format, found: DataFrame, bases: DataFrame) -> DataFrame:
    """Read the records that reach beyond their range, at most one a range, from the pieces of all their ranges."""
    cut = [tuple(r) for r in found.where("cut").select("file", "offset", "successor").collect()]
    if not cut:
        return found
    wanted = {f: sorted((a, b) for g, a, b in cut if g == f) for f in {f for f, _, _ in cut}}
    base = {(r["path"], r["block"]): r["base"] for r in bases.where(F.col("path").isin(*wanted)).collect()}
    magic = form.magic

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            rows = []
            for p, block, piece in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("piece")):
                if p not in wanted:
                    continue
                if key != (p, block):
                    key, at = (p, block), base[p, block] - len(magic)
                data = magic + piece.as_py()
                rows += [(p, a, at, data) for a, b in wanted[p] if a <= at < b]
                at += len(data)
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "offset", "at", "data"])

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        f, a = (x.as_py() for x in key)
        size = dict(wanted[f])[a] - a
        data = b"".join(rows.sort_by("at").column("data").to_pylist())[:size]
        fields = Range(form, f, 0).read(data) if len(data) == size else None
        return table_of([(*fields, f, a)] if fields else [], pa.schema([*RECORD_FIELDS, ("file", pa.string()), ("offset", pa.int64())]))

    parts = pieces(spark, path, form).mapInArrow(gather, "file string, offset bigint, at bigint, data binary")
    read = parts.groupBy("file", "offset").applyInArrow(joined, RECORD + ", file string, offset bigint")
    places = found.where("cut").select("file", "offset", "whole")
    return found.where("not cut").drop("cut", "successor").unionByName(read.join(places, ["file", "offset"]).where("record_type is not null"))


def field(name: str, value: Column) -> Column:
    """One header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def with_references(pages: DataFrame) -> DataFrame:
    """Add digest, size and, where an equal payload has a smaller page_id, ``refers_to``.

    The first page of each payload is found from digests alone. Rows join it on digest
    and size, so a payload that very many pages share is split by the engine. A row
    without page_id refers to the first page that has one; repeated rows of the first
    page are responses all.
    """
    keyed = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"),
    )
    long = keyed.where(F.col("size") >= LEAST_REVISITED)
    first = long.select("page_id", "digest", "size").groupBy("digest").agg(F.min("page_id").alias("first"), F.first("size").alias("size"))
    short = keyed.where(F.col("size") < LEAST_REVISITED).withColumn("refers_to", F.lit(None).cast("bigint"))
    joined = long.join(first, ["digest", "size"]).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")
    return joined.unionByName(short)


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function from records to their gzip members."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            packed = [member(r.as_py().encode()) for r in batch.column("record").slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record for each row as WARC files of gzip members.

    The text writer writes the members' bytes as they are and puts an empty member
    behind each, so a part file is an archive that any gzip reader takes. Line breaks in
    a URL are written as blanks.
    """
    revisit = F.col("refers_to").isNotNull()
    record = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("X-Payload-Length", F.col("size")),
        field("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        field("Content-Length", F.when(revisit, 0).otherwise(F.col("size"))),
        F.lit(CRLF),
        F.when(revisit, "").otherwise(F.col("html")),
        F.lit(CRLF * 2),
    )
    packed = with_references(pages).select(record.alias("record")).mapInArrow(members, "member binary")
    packed.select(F.col("member").cast("string")).write.options(lineSep=SEPARATOR, encoding="ISO-8859-1").text(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives and read them back."""
    path = common.fresh_path(spark, "warc")
    write_archives(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
